import random
from zlib import crc32

from tidemark.llm.quality import classify, features


def rows(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ing", "ha"]) for _ in range(rng.randint(1, 3)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 60))]
        kind = i % 4
        bad = [" ".join(w.upper() + "!!" for w in words), " ".join(w + "$$$" for w in words), " ".join(w for w in words for _ in range(8))]
        out.append((i, bad[kind - 1] if kind else " ".join(words), int(not kind)))
    return out


def test_held_out_accuracy(spark):
    data = rows(400)
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q) for d, _, q in data], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    truth = {d: q for d, _, q in data}
    assert {r.doc_id for r in got if r.held_out} == {d for d in truth if crc32(str(d).encode()) % 4 == 2}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_held_out_labels_are_not_used(spark):
    data = rows(120)
    docs = spark.createDataFrame([(d, t) for d, t, _ in data], "doc_id long, text string")
    held = lambda d: crc32(str(d).encode()) % 4 == 2
    a, b = (spark.createDataFrame([(d, 1 - q if held(d) and flip else q) for d, _, q in data], "doc_id long, quality int") for flip in (False, True))
    assert {(r.doc_id, r.score) for r in classify(docs, a).collect()} == {(r.doc_id, r.score) for r in classify(docs, b).collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "the an"), (3, "x" * 3_000_000), (3, "the an"), (4, "the an")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, None), (2, 7)], "doc_id long, quality int")
    got = classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert classify(docs.limit(0), labels).collect() == []
    assert {r.score for r in classify(docs, labels.limit(0)).collect()} == {0.5}


def test_features_of_blocks():
    text = "ab cd " * 300_000
    assert abs(len(features(text)) / 300_000 - len(features("ab cd " * 300)) / 300) < 0.1


def test_held_out_accuracy_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = classify(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    good, poor = ([r.score for r in got if r.quality == q] for q in (1, 0))
    assert len(got) > 60 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert sum(a > b for a in good for b in poor) >= 0.97 * len(good) * len(poor)


def test_an_id_that_repeats_is_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"text {i} the an") for i in range(300)] + [(2, "x z q")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, quality int")
    assert classify(docs, labels, held=9).count() == 301
