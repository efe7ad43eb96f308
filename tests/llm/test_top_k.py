import math
import random

import pytest

from tidemark.llm.top_k import top_k

SCHEMA = "vec_id long, embedding array<double>, v string, block int"


def brute(rows, k=5, every=50):
    own = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in own:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in own if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("kind", "rows", "queries"), [("unit", 64, 4), ("lengths", 64, 4), ("lengths", 2048, 256), ("copies", 50, 3), ("far", 64, 8)])
def test_equals_brute_force(spark, kind, rows, queries):
    rng = random.Random(kind)
    data = []
    for i in range(700):
        v = [rng.gauss(0, 1) for _ in range(8)]
        n = math.sqrt(sum(x * x for x in v))
        scale = {"unit": 1, "lengths": math.exp(rng.gauss(0, 1.5)), "copies": 1, "far": 1e5 * rng.random()}[kind]
        data.append((i, [x / n * scale for x in v]))
    if kind == "copies":
        data = [(i, data[0][1] if i % 3 else v) for i, v in data]
    data += [(800, None), (850, [1.0, None] + [0.0] * 6), (900, [float("nan")] * 8), (950, [float("inf")] * 8), (None, [1.0] * 8), (1000, [0.0] * 8), (1050, [1.0, 2.0]), (1051, [3.0, -1.0]), (1100, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in top_k(df, rows=rows, queries=queries).collect())
    assert got == brute(data)


def test_repeated_rows_and_empty_table(spark):
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    assert sorted(tuple(r) for r in top_k(df).collect()) == [(0, 1, 1, 65536), (0, 2, 2, 32768)]
    assert top_k(df.limit(0)).collect() == []
