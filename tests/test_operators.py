import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import quality_gate as Q
from tidemark.operators import severity as S
from tidemark.operators import vectors as V
from tidemark.sources import readers, sinks, synthetic


def fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    p = {x: Fraction(math.comb(row, x) * math.comb(n - row, col - x), math.comb(n, col)) for x in range(max(0, col - n + row), min(row, col) + 1)}
    return float(sum(v for x, v in p.items() if x >= a)), float(sum(v for v in p.values() if v <= p[a] * Fraction(1 + 10**9, 10**9)))


def test_fisher(spark):
    tables = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (30, 470, 12, 488), (0, 0, 4, 5), (1, 0, 0, 0), (200, 1800, 150, 1850)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long").repartition(1)
    got = df.select("a", "b", "c", "d", D.fisher(*map(F.col, "abcd")).alias("p"), D.fisher(*map(F.col, "abcd"), True).alias("q")).collect()
    for r in got:
        assert (r.p, r.q) == pytest.approx(fisher(r.a, r.b, r.c, r.d), abs=1e-9)


def test_psi_of_equal_cohorts_is_zero(spark):
    rows = [(b, t, "NEGATIVE") for b in ("1", "2") for t in "xyz" for _ in range(50)] + [("3", "x", "POSITIVE")] * 120 + [("4", "y", "NEUTRAL")] * 5
    got = {r.batch: (r.psi, r.status) for r in D.timeline(spark.createDataFrame(rows, "batch string, theme string, sentiment string")).collect()}
    assert got["1"] == (0.0, "BASELINE") and got["2"] == (0.0, "STABLE") and got["3"][1] == "CRITICAL_DRIFT" and got["4"] == (None, "INSUFFICIENT_DATA")


def test_gate(spark):
    rows = ["A good long text.", "a  GOOD long text.", "nan", "aaaaaaaaaa", "ok", None, "…", "été à la mer", "x" * 5000 + " y" * 2000]
    got = Q.gate(spark.createDataFrame(list(enumerate(rows)), "row_index long, review_text string")).orderBy("row_index").collect()
    assert [r.rejection_code for r in got] == [None, "DUPLICATE_TEXT", "EMPTY_TEXT", "REPETITIVE_CHARACTER_SPAM", "DEGENERATE_SHORT_TEXT", "EMPTY_TEXT", "DEGENERATE_SHORT_TEXT", None, None]
    assert len(got[8].review_text) == 4000 and got[8].truncated
    one = Q.manifest(Q.gate(spark.createDataFrame(list(enumerate(rows)), "row_index long, review_text string"))).first()
    assert (one.total, one.passed, one.quarantined, one.duplicates, one.warnings) == (9, 3, 6, 1, 1)
    assert one.quality_score == round(100 * (1 - 0.5 * 6 / 9 - 0.3 / 9 - 0.2 / 9), 2)


def test_ratings(spark):
    values = ["★★★★", "4 out of 5", "3/5", "rating: 2", "none", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, r string")
    assert [r.rating for r in Q.normalize_ratings(df, "r").orderBy("i").collect()] == [4, 4, 3, 2, 3, 3]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["0", "50", "100"])], "i int, r string")
    assert [r.rating for r in Q.normalize_ratings(df, "r").orderBy("i").collect()] == [1, 3, 5]


def test_mapping():
    got = Q.map_columns(["Review ID", "Review Text", "Star-Rating", "App.Version", "Created At", "Store"])
    assert {k: v[0] for k, v in got.items()} == {"review_text": "Review Text", "rating": "Star-Rating", "batch_or_version": "App.Version", "created_at": "Created At", "channel": "Store"}
    with pytest.raises(ValueError, match="review text"):
        Q.map_columns(["id", "score"])


def test_severity_tables(spark):
    rows = [(0.36, 600, 0.1, 0, 0, "CRITICAL"), (0.36, 10, 0.1, 0, 0, "HIGH"), (0.21, 10, 0.1, 0, 0, "MEDIUM"), (0.12, 120, 0.03, 0, 0, "HIGH"), (0.05, 30, 0.03, 0, 0, "MEDIUM"), (0.01, 5, 0.1, 1, 0, "HIGH"), (0.01, 30, 0.1, 1, 0, "CRITICAL"), (0.01, 5, 0.1, 0, 1, "MEDIUM"), (0.01, 5, 0.1, 0, 5, "HIGH"), (0.0, 5, 0.1, 0, 0, "LOW")]
    df = spark.createDataFrame(rows, "f double, v int, b double, p0 int, p1 int, want string")
    got = df.select("want", S.theme_severity(*map(F.col, ("f", "v", "b", "p0", "p1"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_vectors(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 0, [1.0, 0.0]), (4, 1, [0.0, 5.0]), (5, 1, None)], "k int, c int, v array<double>")
    centers = V.centroids(df, "c", "v")
    assert {r.c: r.centroid for r in centers.collect()} == {0: [1.0, 0.0], 1: [0.0, 5.0]}
    assert {r.c: r.k for r in V.medoids(df.filter("v is not null"), centers, "c", "v", "k").collect()} == {0: 3, 1: 4}
    assert {r.k: r.c for r in V.nearest(df, centers, "c", "v", "k").collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: -1}
    assert [V.adaptive_k(n) for n in (1, 6, 20, 80, 250, 1000, 10_000)] == [1, 2, 3, 5, 8, 9, 18]


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;text;x\n1;b, c;d\n", encoding="utf-8")
    (tmp_path / "b.json").write_text('{"data": [{"id": 1, "text": "x"}, {"id": 2, "text": "y"}]}')
    (tmp_path / "c.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "d.csv").write_bytes("id,text\n1,caf\xe9\n".encode("latin-1"))
    (tmp_path / "e.json").write_text('[{"id": 7}]')
    rows = lambda name: [tuple(r) for r in readers.read_any(spark, str(tmp_path / name))[0].collect()]
    assert rows("a.csv") == [("1", "b, c", "d")]
    assert rows("b.json") == [(1, "x"), (2, "y")] and rows("c.jsonl") == [(1,), (2,)] and rows("d.csv") == [("1", "café")] and rows("e.json") == [(7,)]
    (tmp_path / "f.json").write_text("id,text\n3,not json\n")
    (tmp_path / "g.xlsx").write_text("id,text\n4,\"two\nlines\"\n")
    assert rows("f.json") == [("3", "not json")] and rows("g.xlsx") == [("4", "two\nlines")]
    assert [r.row_index for r in readers.indexed(spark.range(10).repartition(3)).orderBy("row_index").collect()] == list(range(10))
    with pytest.raises(ValueError, match="rows"):
        readers.guarded(spark.range(5))


def test_synthetic_spike(spark):
    r = synthetic.reviews(spark, 4000)
    share = {x.batch_or_version: x.s for x in r.groupBy("batch_or_version").agg(F.avg((F.col("sentiment") == "NEGATIVE").cast("int")).alias("s")).collect()}
    assert share["2024-Q3"] > 0.5 and max(v for k, v in share.items() if k != "2024-Q3") < 0.3
    assert r.exceptAll(synthetic.reviews(spark, 4000)).isEmpty()


def test_runs_and_upserts(spark, tmp_path):
    df = spark.createDataFrame([("a", "d1", "x"), ("a", "d1", "y"), ("b", "d2", "z")], "id string, domain string, raw_text string")
    sinks.write_run({"reviews": df}, str(tmp_path / "runs"), "1")
    sinks.write_run({"reviews": df.limit(1)}, str(tmp_path / "runs"), "2")
    latest = sinks.read_latest(spark, str(tmp_path / "runs"), "reviews")
    assert latest.count() == 1 and "raw_text" not in latest.columns
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.upsert(spark, df, path, "id", "domain")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b"]
