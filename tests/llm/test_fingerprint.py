import random
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from tidemark.llm.fingerprint import combined, fingerprints, likeness, summed

SCHEMA = "doc_id long, text string, k string, next int"


def run(spark, data, **more):
    return fingerprints(spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA).repartition(3), **more).collect()


def text(rng, lines):
    return "\n".join(" ".join(f"w{rng.randrange(10**5)}." for _ in range(rng.randint(1, 12))) for _ in range(lines))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(1)
    rows = [(7 * i, text(rng, rng.randint(1, 40))) for i in range(120)] + [(5000, None), (5001, ""), (5002, "é🙂x"), (9000, "last one")]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for size in (10, 1000):
        got = {r.doc_id: r for r in run(spark, shuffled, rows=size)}
        assert len(got) == len(rows)
        for i, (d, t) in enumerate(rows):
            t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if edited == t:
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1.0
        long = [r for r in got.values() if r.n_chars > 400]
        assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_order_insertion_and_deletion(spark):
    rng = random.Random(2)
    lines = [text(rng, 1) for _ in range(30)]
    texts = ["\n".join(lines), "\n".join(reversed(lines)), "\n".join(lines[:10]), "\n".join(lines[10:]), "\n".join(lines[:-1] + ["other"])]
    df = summed(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), ["k"], "t")
    lanes = {r.k: r.lanes for r in df.collect()}
    assert lanes[0] == lanes[1] != lanes[4]
    two = spark.createDataFrame([(lanes[2], lanes[3], lanes[0])], "a array<long>, b array<long>, c array<long>")
    r = two.select(combined(F.col("a"), F.col("b")).alias("s"), combined(F.col("c"), F.col("b"), -1).alias("d"), likeness(F.col("a"), F.col("c")).alias("l")).first()
    assert r.s == lanes[0] and r.d == lanes[2] and 0.3 < r.l < 0.9


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "a. b"), (1, "a. b"), (1, "c"), (None, "a. b"), (2, "a. b")]
    got = run(spark, rows)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 4}) == 1
    assert run(spark, []) == []


def test_one_document_is_its_own_next(spark):
    r = run(spark, [(3, "abcd")])[0]
    assert r.edited_sha256 == sha256(b"abab").hexdigest() and r.near_next == 1.0


def test_very_long_text(spark):
    r = run(spark, [(1, "word. " * 200_000), (2, "x")])
    assert {x.n_chars for x in r} == {1_200_000, 1}


def test_likeness_of_very_many_sentences(spark):
    some = lambda name, n: ". ".join(f"{name}{i}" for i in range(n))
    texts = [some("a", 150_000), some("b", 150_000), some("a", 75_000), "one\n" * 70_000, "two\n" * 70_000, "one\n" * 60_000]
    df = summed(spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(6), ["k"], "t")
    lanes = {r.k: r.lanes for r in df.collect()}
    pairs = spark.createDataFrame([(i, j, lanes[i], lanes[j]) for i, j in ((0, 1), (0, 2), (3, 4), (3, 5))], "i int, j int, a array<long>, b array<long>")
    got = {(r.i, r.j): r.l for r in pairs.select("i", "j", likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    assert got[0, 1] < 0.4 and 0.5 < got[0, 2] < 0.9 and got[3, 4] < 0.4 and got[3, 5] > 0.99


def second_lanes(text):
    """The lanes of a text by the library of the hash, paragraph by paragraph."""
    import re
    from struct import pack

    from xxhash import xxh64_intdigest

    seeded = lambda i, x: xxh64_intdigest(x.encode(), xxh64_intdigest(pack("<i", i), 42))
    lanes = [0] * 137
    for p in text.split("\n"):
        for i in range(8):
            lanes[i] += seeded(i, p)
    for x in re.split(r"\n|(?<=[.!?]) ", text):
        lanes[8] += 1
        for i in range(2):
            h = seeded(100 + i, x)
            for k in range(32):
                for s, by in enumerate((0, 32)):
                    lanes[9 + 64 * i + 2 * k + s] += h >> (k + by) & 1
    return [x & 0xFFFFFFFF for x in lanes]


def second_likeness(a, b):
    if a == b:
        return 1.0
    u, v = ([2 * x - lanes[8] for x in lanes[9:]] for lanes in (a, b))
    over = (sum(x * x for x in u) * sum(x * x for x in v)) ** 0.5
    return max(0.0, min(1.0, sum(x * y for x, y in zip(u, v, strict=True)) / over)) if over else 0.0


def test_fingerprints_and_likenesses_by_a_second_version(spark):
    rng = random.Random(6)
    rows = [(3 * i, text(rng, rng.randint(0, 12))) for i in range(40)] + [(400, ""), (401, None), (402, "é. ü! 🙂? x\n\ny"), (403, "a. b. c.")]
    for r in run(spark, rows, rows=9):
        place = next(i for i, (d, _) in enumerate(rows) if d == r.doc_id)
        own, after = rows[place][1] or "", rows[(place + 1) % len(rows)][1] or ""
        half = len(own) // 2
        a, e, n = map(second_lanes, (own, own[: len(own) - half] + after[:half], after))
        hexed = lambda lanes: "".join(f"{x:08X}" for x in lanes)
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(a), hexed(e))
        assert abs(r.near_edited - second_likeness(a, e)) < 1e-9 and abs(r.near_next - second_likeness(a, n)) < 1e-9
