import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.token_store import cut, each, read_store, write_store

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    out, start = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_cut_covers_and_finds_passages_again():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 49000, 20_000)
    ends = cut(a)
    assert ends[-1] == len(a) and all(x < y for x, y in zip(ends, ends[1:], strict=False)) and max(np.diff(ends)) <= 4096
    b = np.concatenate([rng.integers(0, 49000, 77), a])
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *cut(x)[:-1]], cut(x), strict=True)}
    assert len(chunks(a) & chunks(b)) > 0.9 * len(chunks(a))
    assert cut(np.array([1])) == [1]


@pytest.mark.parametrize("rows", [40, 10_000])
def test_round_trip(spark, tmp_path, rows):
    rng = random.Random(7)
    words = ["the", "and", "ing", "Ether", "12", "é", "$$"]
    base = " ".join(rng.choice(words) + rng.choice(words) for _ in range(3000))
    texts = [None, "", base, base, base + " end", "x " + base, "<|endoftext|> x", "H̱ ͸"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 300))) for _ in range(150)]
    data = [(3 * i, t) for i, t in enumerate(texts)]
    mixed = data[:]
    rng.shuffle(mixed)
    top = f"file://{tmp_path}/store"
    write_store(spark.createDataFrame([(d, t, "x", 1) for d, t in mixed], "doc_id long, text string, data string, pack int").repartition(5), PATH, top, rows=rows)
    got = sorted(tuple(r) for r in read_store(spark, top, ids=True).collect())
    assert got == expected(data)
    names = spark.read.parquet(f"{top}/data").select(F.explode(each(F.col("names")))).distinct().count()
    stored = spark.read.parquet(f"{top}/data").filter("place is null").count()
    assert stored == spark.read.parquet(f"{top}/data").filter("place is null").select("name").distinct().count() < names


def test_repeated_and_null_ids_and_empty_table(spark, tmp_path):
    text = "the and of " * 200
    rows = [(1, text), (1, text), (None, "x"), (1, "b"), (None, text)]
    schema = "doc_id long, text string"
    write_store(spark.createDataFrame(rows, schema), PATH, f"file://{tmp_path}/a")
    got = read_store(spark, f"file://{tmp_path}/a").collect()
    assert sorted((r.doc_id is not None, r.n_tokens) for r in got) == sorted((d is not None, len(e[4])) for (d, _), e in zip(rows, expected(rows), strict=True))
    assert sorted(r.start for r in got)[0] == 0
    write_store(spark.createDataFrame([], schema), PATH, f"file://{tmp_path}/b")
    assert read_store(spark, f"file://{tmp_path}/b").collect() == []


def test_a_changed_store_fails(spark, tmp_path):
    write_store(spark.createDataFrame([(i, f"the text {i} " * 50) for i in range(5)], "doc_id long, text string"), PATH, f"file://{tmp_path}/a")
    data = spark.read.parquet(f"file://{tmp_path}/a/data")
    data.withColumn("data", F.when(F.col("doc_id") == 3, F.concat(F.expr("substring(data, 3)"), F.expr("substring(data, 1, 2)"))).otherwise(F.col("data"))).write.parquet(f"file://{tmp_path}/b/data")
    spark.read.parquet(f"file://{tmp_path}/a/manifest").write.parquet(f"file://{tmp_path}/b/manifest")
    with pytest.raises(Exception, match="differs from its root"):
        read_store(spark, f"file://{tmp_path}/b").collect()


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(rng.choice(["the", "and", "ing", "Ether", "12,", "é", "don't"]) + rng.choice("abc") for _ in range(400_000))
    rows = [(1, long), (2, "x" * 300_000), (3, long + " end"), (4, "\n" * 50_000)]
    write_store(spark.createDataFrame(rows, "doc_id long, text string"), PATH, f"file://{tmp_path}/s")
    got = sorted(tuple(r) for r in read_store(spark, f"file://{tmp_path}/s").collect())
    assert got == [e[:4] for e in expected(rows)]
