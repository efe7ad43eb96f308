import duckdb
import pytest

from tidemark.llm.common import Scratch
from tidemark.llm.mixing import DIMS, mix, mix_sql, rake

SCHEMA = "doc_id long, text string, source string, lang string, rate string, __n int"


def docs(spark):
    rows = []
    for i in range(600):
        kind = ["plain words of prose", "all rights under license 2", "write to a@b.c now", "odd $$$ text"][i * i % 7 % 4]
        rows.append((i, (kind + " ") * (1 + i % 5), ["a", "a", "b", "c"][i % 4], ["en", "de"][i % 3 % 2], "x", 1))
    rows += [(None, "one two", None, None, "x", 1), (900, None, "a", "en", "x", 1), (901, "", None, "de", "x", 1), (5, "again", "a", "en", "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_marginals_are_met(spark):
    cells = spark.createDataFrame([(s, g, t, float(1 + 7 * i + 3 * j + 11 * k * i)) for i, s in enumerate("ab") for j, g in enumerate("xyz") for k, t in enumerate("pq")], "source string, lang string, topic string, tokens double")
    goal = {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 1, "z": 2}, "topic": {"p": 0.5, "q": 0.5}}
    got = rake(cells, Scratch(spark, "test"), goal, sweeps=60).collect()
    for d in DIMS:
        total = sum(goal[d].values())
        for v, w in goal[d].items():
            assert sum(r.weight for r in got if r[d] == v) == pytest.approx(w / total, abs=1e-9)


@pytest.mark.parametrize("one_task", [True, False])
def test_equals_its_sql(spark, monkeypatch, one_task):
    if not one_task:
        monkeypatch.setattr("tidemark.llm.mixing.ONE_TASK", 0)
    df = docs(spark)
    documents = df.toPandas()  # noqa: F841  DuckDB reads it by name
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    sql = duckdb.sql(mix_sql())
    names = ["doc_id", "n_tokens", "topic", "rate", "sampled"]
    want = sorted(([r[sql.columns.index(n)] for n in names] for r in sql.fetchall()), key=repr)
    got = sorted(([r[n] for n in names] for r in mix(df).collect()), key=repr)
    assert [[x[0], *x[1:3], round(x[3], 7), x[4]] for x in got] == [[x[0], *x[1:3], round(x[3], 7), x[4]] for x in want]


def test_columns_rates_and_empty_table(spark):
    out = mix(docs(spark))
    assert out.columns == ["doc_id", "text", "source", "lang", "__n", "topic", "n_tokens", "rate", "sampled"]
    rows = out.collect()
    assert max(r.rate for r in rows) == 1.0 and all(0 <= r.rate <= 1 for r in rows)
    assert mix(docs(spark).limit(0)).collect() == []


def test_values_without_weight_are_never_sampled(spark):
    rows = mix(docs(spark), {"lang": {"en": 1}}).collect()
    assert not any(r.sampled for r in rows if r.lang != "en") and any(r.sampled for r in rows)


def test_sampled_tokens_follow_the_targets(spark):
    import random

    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(5, 40))), rng.choice("aaaab"), rng.choice(("en", "de"))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mix(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.75, "de": 0.25}}).filter("sampled").groupBy("source", "lang").agg({"n_tokens": "sum"}).collect()
    total = sum(r[2] for r in got)
    assert abs(sum(r[2] for r in got if r.source == "a") / total - 0.5) < 0.04 and abs(sum(r[2] for r in got if r.lang == "en") / total - 0.75) < 0.04
    own = mix(docs.withColumn("area", docs.lang), {"topic": {"en": 1.0}}, topic_col="area")
    assert own.filter("sampled and topic != 'en'").isEmpty() and not own.filter("sampled").isEmpty()


def test_one_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "a", "en"), (2, "x" * 3_000_000, "b", "en"), (3, "", "b", "en")], "doc_id long, text string, source string, lang string")
    assert {r.doc_id: r.n_tokens for r in mix(docs).collect()} == {1: 400_000, 2: 1, 3: 0}
