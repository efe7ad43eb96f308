import random

import pytest

from pyspark.sql import functions as F

from tidemark.llm.common import Ranges, Scratch, components, shared_dir, spread_join


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_components_of_paths_stars_and_loops(spark, one_task):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(300, 301), (301, 302), (302, 300), (302, 302)] + [(-5, 7)]
    edges += [(b, a) for a, b in edges[::3]]
    rng.shuffle(edges)
    got = components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long"), one_task)
    want = {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(200, 260), 200), **dict.fromkeys((300, 301, 302), 300), -5: -5, 7: -5}
    assert {r.node: r.comp for r in got.collect()} == want


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_no_edges(spark, one_task):
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long"), one_task).collect() == []


def test_ranges_of_ids(spark):
    ids = [None, *range(0, 4000, 7), 10, 10, 10]
    df = spark.createDataFrame([(i, "x") for i in ids], "k long, p string").repartition(3)
    ranges = Ranges(Scratch(spark, "test"), df, "k", 50)
    got = ranges.add(df, "n", "head").orderBy("k").collect()
    numbers = [r.n for r in got]
    assert numbers == sorted(numbers) and 8 < ranges.last + 1 < 16 and numbers[0] == 0 and numbers[-1] == ranges.last
    least = {}
    for r in got[1:]:
        least.setdefault(r.n, r.k)
    assert all(r.head == (r.n > 0 and r.k == least[r.n]) for r in got[1:])
    assert max(numbers.count(n) for n in set(numbers)) < 120
    none = Ranges(Scratch(spark, "test"), df.limit(0), "k", 50)
    assert none.last == 0 and none.add(df, "n", "head").filter("n > 0 or head").isEmpty()


def test_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_spread_join_equals_a_join(spark):
    rng = random.Random(2)
    many = [(rng.choice([0, 0, 0, 1, *range(2, 300)]), i) for i in range(3000)]
    count = {k: sum(x == k for x, _ in many) for k, _ in many}
    few = spark.createDataFrame([(k, n, f"v{k}") for k, n in count.items() if k % 7 != 5], "k int, n int, v string")
    got = spread_join(spark.createDataFrame(many, "k int, i int"), few, "k", "n", F.col("i"))
    assert sorted(got.columns) == ["i", "k", "n", "v"]
    assert sorted((r.k, r.i, r.v) for r in got.collect()) == sorted((k, i, f"v{k}") for k, i in many if k % 7 != 5)
    assert spread_join(got.select("k", "i"), few.limit(0), "k", "n", F.col("i")).collect() == []
