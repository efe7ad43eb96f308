"""Seeded synthetic reviews, with a defect that one cohort has more of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOOD = ("The {} works well and feels great.", "I love the {}, it is excellent.", "Perfect {}, highly recommend it.")
POOR = ("The {} broke after a week.", "The {} leaked in the box and is useless.", "Terrible {}, it stopped working.")
PLAIN = ("The {} arrived on time.", "I bought the {} last month.", "The {} is what the picture shows.")
DOMAINS = {"cosmetics": (("serum", "cream", "cleanser", "pump"), ("2024-Q1", "2024-Q2", "2024-Q3", "2024-Q4"), "2024-Q3"), "software": (("login page", "report view", "sync", "search"), ("v1.0", "v1.1", "v1.2", "v2.0"), "v2.0")}


def pick(values: tuple[str, ...], seed: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(seed, F.lit(len(values))) + 1).cast("int"))


def halves(templates: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Disjoint templates to train on and to test with."""
    n = (len(templates) + 1) // 2
    return templates[:n], templates[n:]


def reviews(spark: SparkSession, n: int, domain: str = "cosmetics", seed: int = 42, spike: int = 60, usual: int = 20) -> DataFrame:
    """n reviews of a domain; spike and usual are the percentages of complaints in its bad cohort and in the others."""
    items, batches, bad = DOMAINS[domain]
    h = lambda k: F.xxhash64(F.col("id"), F.lit(seed), F.lit(k))
    batch, item = pick(batches, h(1)), pick(items, h(2))
    draw = F.pmod(h(3), F.lit(100))
    cut = F.when(batch == bad, spike).otherwise(usual)
    kind = F.when(draw < cut, "NEGATIVE").when(draw < cut + (100 - cut) * 0.75, "POSITIVE").otherwise("NEUTRAL")
    text = F.when(kind == "NEGATIVE", pick(POOR, h(4))).when(kind == "POSITIVE", pick(GOOD, h(4))).otherwise(pick(PLAIN, h(4)))
    return spark.range(n).select(F.format_string("REV-%s-%05d", F.lit(domain[:3].upper()), "id").alias("review_id"), item.alias("product_name"), batch.alias("batch_or_version"), F.replace(text, F.lit("{}"), item).alias("review_text"), kind.alias("sentiment"), F.when(kind == "NEGATIVE", 1 + F.pmod(h(5), F.lit(2))).when(kind == "POSITIVE", 4 + F.pmod(h(5), F.lit(2))).otherwise(3).cast("int").alias("rating"))


def expanded(spark: SparkSession, templates: tuple[str, ...], fillers: tuple[str, ...], n: int) -> DataFrame:
    """The first n of all templates filled with all fillers."""
    t, f = (spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x string") for v in (templates, fillers))
    both = t.toDF("i", "template").crossJoin(F.broadcast(f.toDF("j", "filler")))
    return both.orderBy("i", "j").limit(n).select(F.replace("template", F.lit("{}"), F.col("filler")).alias("text"))
