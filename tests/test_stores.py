import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clusters as C
from tidemark.operators import quality_gate as Q
from tidemark.operators import records as P
from tidemark.operators import sentiment as M
from tidemark.operators import service as S
from tidemark.operators import vectors as V
from tidemark.sources import artifacts, readers, sinks, synthetic


def test_artifacts(spark, tmp_path):
    (tmp_path / "model.bin").write_bytes(b"weights")
    path = str(tmp_path / "model.bin")
    good = hashlib.sha256(b"weights").hexdigest()
    assert artifacts.verified(spark, path, good.upper()) == path and artifacts.bounded(spark, path) == path
    with pytest.raises(ValueError, match="digest"):
        artifacts.verified(spark, path, "0" * 64)
    with pytest.raises(ValueError, match="more than 3"):
        artifacts.bounded(spark, path, 3)
    (tmp_path / "empty").write_bytes(b"")
    with pytest.raises(ValueError, match="empty"):
        artifacts.bounded(spark, str(tmp_path / "empty"))
    assert artifacts.missing(spark, [path, str(tmp_path / "none")]) == [str(tmp_path / "none")]
    (tmp_path / "a.csv").write_text("review_index,theme,cluster_id\n0,x,1\n1,y,z\n")
    assert sorted(map(tuple, artifacts.read_assignments(spark, str(tmp_path / "a.csv")).collect())) == [(0, 1, "x"), (1, None, "y")]


def test_zipped_tables(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            for k in range(2):
                z.writestr(f"{k}.csv", f'id,text,more\n{n}{k},"a, b\nc",z\n')
    got = artifacts.read_zipped(spark, str(tmp_path), ["text", "id"])
    assert got.columns == ["text", "id"] and sorted(r.id for r in got.collect()) == ["00", "01", "10", "11"] and {r.text for r in got.collect()} == {"a, b\nc"}


def test_older_uploads(spark):
    rows = [(0, "It broke, but ok", "5.0", "x"), (1, "mail a@b.co", "9", None), (2, " ", "1", "x"), (3, "NaN", "1", "x"), (4, "fine", "bad", "x")]
    got = artifacts.parse_legacy(spark.createDataFrame(rows, "row_index long, my_comment string, star_rating string, product string")).orderBy("id").collect()
    assert [(r.id, r.product_name, r.rating, r.ground_truth_label, r.redacted_text) for r in got] == [("REV-USER-00001", "x", 5, "POSITIVE", "It broke, but ok"), ("REV-USER-00002", "Custom Item", 3, "NEUTRAL", "mail [REDACTED_EMAIL]"), ("REV-USER-00005", "x", 3, "NEUTRAL", "fine")]
    with pytest.raises(ValueError, match="review text"):
        artifacts.parse_legacy(spark.createDataFrame([(1, 2)], "row_index long, my_text int"))


def test_tickets_and_training_sets(spark, tmp_path):
    schema, path = "id string, created_at string", str(tmp_path / "t")
    assert sinks.tickets(spark, path, schema).collect() == []
    for i in range(3):
        sinks.save_ticket(spark.createDataFrame([(f"T{i}", f"2024-01-0{i + 1}")], schema), path)
    assert [r.id for r in sinks.tickets(spark, path, schema).collect()] == ["T2", "T1", "T0"]
    assert not sinks.insert_if_empty(spark, spark.createDataFrame([("x", "y")], schema), path) and sinks.insert_if_empty(spark, spark.createDataFrame([("x", "y")], schema), str(tmp_path / "u"))
    df = spark.createDataFrame([("a", "COMPLAINT", "train"), ("b", "NOISE", "val"), ("c", "NOISE", "val")], "text string, label string, split string")
    assert sorted(map(tuple, sinks.write_training_set(df, str(tmp_path / "s"), "label", "split").collect())) == [("COMPLAINT", "train", 1), ("NOISE", "val", 2)]
    assert spark.read.option("header", True).csv(str(tmp_path / "s/csv")).count() == 3


def test_first_by_arrival_wins(spark, tmp_path):
    df = spark.createDataFrame([(2, "a", "d", "z"), (1, "a", "d", "zz"), (3, "b", "d", "y")], "n int, id string, domain string, v string")
    sinks.upsert(spark, df, str(tmp_path / "p"), "id", "domain", order="n")
    assert sorted((r.id, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", "zz"), ("b", "y")]
    sinks.upsert(spark, df.limit(0).union(spark.createDataFrame([(9, "c", "d", "n")], df.schema)), str(tmp_path / "p"), "id", "domain", overwrite=True)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["c"]


def test_cached_vectors(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "t string")
    path, encode = str(tmp_path / "c"), lambda c: F.array(F.length(c).cast("double"))
    for more in (df, df.union(spark.createDataFrame([("zzz",)], "t string"))):
        got = sinks.cached(more, "t", encode, path, "array<double>").collect()
        assert all(r.vector == [float(len(r.t))] for r in got) and len(got) == more.count()
    assert spark.read.parquet(path).count() == 3


def test_connector(spark):
    facts = spark.createDataFrame([("a", 1, True, 0.5)], "Review_ID string, Rating int, Is_Actionable boolean, Score double")
    assert json.loads(sinks.connector("http://h:1/"))["connections"][0]["details"]["url"] == "http://h:1/api/reports/reviews.csv"
    assert '{"Rating", Int64.Type}' in sinks.import_script("http://h", facts) and "Columns = 4" in sinks.import_script("http://h", facts)


def test_positions_must_agree(spark):
    a, b = (spark.createDataFrame([(i, f"{x}{i}") for i in range(5)], f"i int, {x} string") for x in "ab")
    with pytest.raises(ValueError, match="differ"):
        P.by_position(a, b, "i", ("a", "b"))
    with pytest.raises(ValueError, match="5 rows against 4"):
        P.by_position(a, b.filter("i > 0"), "i")
    assert P.by_position(a, b, "i").count() == 5


def test_titles_are_given_once(spark):
    rows = [(0, "A", 0.9), (0, "B", 0.8), (1, "A", 0.95), (1, "B", 0.5), (2, "A", 0.7), (2, "C", 0.4), (-1, "C", 0.6)]
    got = {r.c: r.title for r in C.titles_of(spark.createDataFrame(rows, "c int, title string, similarity double"), "c").collect()}
    assert got == {-1: "C", 0: "A", 1: "B"}
    assert C.titles_of(spark.createDataFrame([], "c int, title string, similarity double"), "c").collect() == []


def test_clusters_of_points(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(5 * (i % 3), 0.1), rng.gauss(-5 * (i % 3), 0.1)], i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "i int, v array<double>, truth int")
    own = C.clustered(df, "v", 3, {"density": lambda *_: (_ for _ in ()).throw(ImportError)}, "density")
    assert own.groupBy("cluster_id").agg(F.count_distinct("truth").alias("n")).filter("n > 1").isEmpty()
    assert C.clustered(df, "v", 3, {"none": lambda d, v, k: d.withColumn("cluster_id", F.lit(7))}, "none").select("cluster_id").distinct().collect()[0][0] == 7
    sweep = V.k_sweep(df, "v", (2, 3))
    assert sweep[1][1] < sweep[0][1] and sweep[1][3:] == (30, 30)
    far = V.with_distance(own, V.centroids(own, "cluster_id", "v"), "cluster_id", "v")
    assert 3 <= V.outliers(far, "cluster_id").filter("cluster_id = -1").count() <= 6
    assert [r.n for r in V.centroids(own, "cluster_id", "v", True).collect()] and all(abs(sum(x * x for x in r.centroid) - 1) < 1e-9 for r in V.centroids(own, "cluster_id", "v", True).collect())


def test_sentiment_model(spark):
    r = synthetic.reviews(spark, 1500).withColumnRenamed("review_text", "text")
    own = M.split(r, "review_id")
    assert 0.15 < own.filter("held_out").count() / 1500 < 0.25
    model = M.fit(own.filter("not held_out"), "text", "sentiment")
    told = M.predict(model, own.filter("held_out"), "text")
    right = told.filter("prediction = sentiment").count() / told.count()
    assert right > 0.95 and all(abs(sum(x.probabilities.values()) - 1) < 1e-9 for x in told.limit(5).collect())
    rows = [(p, int(random.Random(i).random() < p * p)) for i, p in enumerate([k / 400 for k in range(1, 400)] * 5)]
    a, b = M.platt(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    assert a < 0 and 1 / (1 + 2.718281828 ** (a * 0 + b)) < 0.5  # 0.5 is true in a quarter of the cases


def test_templates(spark):
    train, gold = synthetic.halves(synthetic.GOOD)
    assert not set(train) & set(gold) and set(train) | set(gold) == set(synthetic.GOOD)
    assert [r.text for r in synthetic.expanded(spark, ("{} x", "{} y"), ("a", "b"), 3).collect()] == ["a x", "b x", "a y"]


def test_domains_are_kept_apart(spark):
    df = spark.createDataFrame([("a", "X"), ("b", "y")], "domain string, t string")
    assert [r.t for r in S.matching(df, ["t"], None, domain="A").collect()] == ["X"] and S.matching(df, ["t"], " x ", domain="all").count() == 1 and S.matching(df, ["t"], "", domain=None).count() == 2
    with pytest.raises(ValueError, match="missing"):
        readers.required(df, ("domain", "rating"), "t")


def test_spam_of_every_length(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaaaaaab c!é🙂"[: rng.randint(1, 13)]) for _ in range(rng.randint(0, 24))) for _ in range(1500)] + ["a" * 5000 + "b" * 1000, ". . . . . . ."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", Q.spam(Q.normal(F.col("t"))).alias("s")).collect():
        s = texts[r.i].strip().lower()
        assert r.s == (len(s) >= 8 and max(map(s.count, set(s))) / len(s) >= 0.75), texts[r.i]


def test_repairs(spark):
    rows = [("x" * 10, "4.6", "1990-01-01"), ("y", "bad", "2024-05-05"), ("z", "3", None)]
    got = Q.repaired(spark.createDataFrame(rows, "t string, r string, d string"), "t", "r", "d", most=5, as_of=F.lit("2024-06-01").cast("timestamp")).collect()
    assert [(r.t, r.r, str(r.d.date()), r.warnings) for r in got] == [("xxxxx", 5, "2024-06-01", 3), ("y", 3, "2024-05-05", 1), ("z", 3, "2024-06-01", 1)]


def test_runs_refuse_what_is_no_number(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, "x")], "id string, v double, raw_text string")
    sinks.write_run({"r": df}, str(tmp_path), "1", "json")
    assert [tuple(r) for r in sinks.read_latest(spark, str(tmp_path), "r", "json").select("id", "v").collect()] == [("a", 1.5)]
    with pytest.raises(Exception, match="isn't a number"):
        sinks.write_run({"r": df.withColumn("v", F.lit(float("nan")))}, str(tmp_path), "2")
    made = sinks.bootstrap(spark, str(tmp_path / "db"), {"t": "id string, domain string"}, "domain")
    assert made == ["t"] and sinks.bootstrap(spark, str(tmp_path / "db"), {"t": "id string, domain string"}, "domain") == []
