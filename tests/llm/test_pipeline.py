from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_line_dedup import in_common_blocks
from tests.llm.test_near_dedup import brute
from tidemark.llm import quality
from tidemark.llm import queries as q
from tidemark.llm.mixing import mix_sql

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, SF)
        rows = now.collect()
        kept = {r.doc_id for r in rows}
        assert kept <= ids and len(rows) <= before
        if name == "tokens":
            assert kept == ids and all(len(r.ids) == r.n_tokens for r in rows)
            break
        assert now.columns == columns
        if name == "line_dedup":
            seen: set[str] = set()
            for r in sorted(rows, key=lambda r: r.doc_id):
                own = {x for x in r.text.split("\n") if len(x.split()) >= 50}
                assert not own & seen
                seen |= own
        if name != "mixing":
            assert len(rows) >= 0.5 * before
        docs, ids, before = spark.createDataFrame(rows, now.schema), kept, len(rows)


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert out.filter(F.size("ids") != F.col("n_tokens")).isEmpty()


def test_names_of_queries():
    assert [int(n[2:].split("_")[0]) for n in q.QUERIES] == list(range(1, 11))


def test_near_dedup_decides_per_row(spark):
    some = lambda name: " ".join(f"{name}{i}" for i in range(40))
    a, b, c, d = map(some, "abcd")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, c), (7, c), (8, d), (None, d), (None, d), (9, ""), (9, ""), (9, None), (9, b)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in rows], "doc_id long, lang string, text string")
    out = corpus_pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    expected = [(1, a), (5, b), (6, c), (8, d), (None, d), (None, d), (9, ""), (9, None)]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(expected, key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, docs.orderBy("doc_id").collect()


def test_quality_against_a_second_version(spark, tables):
    docs, rows = tables
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if crc32(str(r.doc_id).encode()) % 4 != 2]
    texts = {r.doc_id: r.text for r in rows}
    own = sorted((F_order(spark, [r.doc_id for r in labels])[r.doc_id], r.doc_id, r.quality) for r in labels if len((texts[r.doc_id] or "").encode()) <= 16384)
    table = quality.train([texts[d] for _, d, _ in own], [y for _, _, y in own]).astype(np.float64)
    z = {d: table[quality.features(t)].mean() for d, t in texts.items()}
    want = {d for d in texts if 1 / (1 + np.exp(-z[d])) >= 0.7}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == want and 0 < len(want) < len(rows)


def F_order(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return {r.id: r.o for r in df.select("id", F.xxhash64("id", F.lit(5)).alias("o")).collect()}


def test_line_dedup_against_all_pairs(spark, tables):
    docs, rows = tables
    lines = [[x.strip() for x in (r.text or "").split("\n")] for r in rows]
    want = {}
    for i, r in enumerate(rows):
        words, cut = [len(x.split()) for x in lines[i]], set()
        for e in range(i):
            if set(lines[e]) & {x for x, n in zip(lines[i], words, strict=True) if n}:
                cut |= in_common_blocks(lines[e], lines[i], words, 50)
        left = "\n".join(x for k, x in enumerate((r.text or "").split("\n")) if k not in cut)
        if not cut or left.strip():
            want[r.doc_id] = left if cut else r.text
    got = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for d, r in got.items() if r.text != next(x.text for x in rows if x.doc_id == d))


def test_near_dedup_against_all_pairs(spark, tables):
    docs, rows = tables
    found = brute([(r.doc_id, r.text) for r in rows])
    want = {d for d, _, c in found if d == c}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want and len(want) < len(rows)


def test_mixing_against_sql(spark, tables):
    docs, _ = tables
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {d for d, s in con.sql(f"SELECT doc_id, sampled FROM ({mix_sql()})").fetchall() if s}
    assert {r.doc_id for r in corpus_pipeline.mixing(spark, docs, SF).collect()} == want


def test_tokens_against_the_library(spark, tables):
    docs, rows = tables
    t = Tokenizer.from_file(q.tokenizer())
    t.no_truncation()
    got = {r.doc_id: r.ids for r in corpus_pipeline.tokens(spark, docs, SF).collect()}
    assert all(got[r.doc_id] == t.encode(r.text or "", add_special_tokens=False).ids for r in rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of labels, and documents with nulls, repeated ids and rows, a long text and columns that the operators use themselves."""
    top = str(tmp_path_factory.mktemp("odd"))
    good, poor = "the plain words of a clean text. ", "buy!! buy!! $$$ "
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    rows = [(i, (good if i % 2 else poor) * (5 + i) + f" n{i}", "s", "en", 1, 0.5, "t") for i in range(40)]
    rows += [(None, good * 9, "s", "en", 1, 0.5, "t"), (41, None, None, None, None, None, None), (42, "", "s", "en", 0, 0.1, "t"), (43, good * 4000, "s", "en", 1, 0.2, "t"), (43, good * 7 + "other", "s", "en", 1, 0.2, "t"), (43, good * 7 + "other", "s", "en", 1, 0.2, "t"), (44, " \t", "s", "", 1, 0.3, "t")]
    return top, spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score double, topic string")


def test_odd_rows_pass_every_stage(spark, odd):
    top, docs = odd
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, docs, top)
        rows = now.collect()
        assert (now.columns == docs.columns) == (name != "tokens")
        if name == "quality":
            assert rows and all("buy" not in (r.text or "") for r in rows)
        elif name == "line_dedup":
            assert {r.doc_id for r in rows} >= {None, 41, 42, 44}
        elif name == "near_dedup":
            assert [r.doc_id for r in rows].count(None) == 1 and {41, 42, 44} <= {r.doc_id for r in rows}
        elif name == "tokens":
            assert len(rows) == docs.count() and all(r.ids == [] for r in rows if r.doc_id in (41, 42, 44))
        assert stage(spark, docs.limit(0), top).collect() == []


def test_no_labels_and_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
