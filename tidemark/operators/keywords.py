"""Keyword weights per group of texts; three variants that differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def grams(tokens: Column, most: int = 2) -> Column:
    """All 1- to most-grams, words joined by a space; each length from the one before, so a text is walked most times."""
    out = [tokens]
    for n in range(2, most + 1):
        out.append(F.zip_with(out[-1], F.slice(tokens, n, F.greatest(F.size(tokens), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.array_compact(F.concat(*out))


def term_counts(texts: DataFrame, group: str, tokens: Column, stop: list[str], most: int = 2, features: int = 3000, least_groups: int = 1) -> DataFrame:
    """(group, term, tf) of the most frequent terms of the corpus that at least so many groups have, ties to the lesser term."""
    kept = F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens
    words = texts.select(group, kept.alias("__t"))
    cell = words.select(group, F.explode(grams(F.col("__t"), most)).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    # a term's row holds its groups, which are a dimension (clusters, sources), so texts are read once
    top = cell.groupBy("term").agg(F.sum("tf").alias("all"), F.collect_list(F.struct(group, "tf")).alias("cells")).filter(F.size("cells") >= least_groups).orderBy(F.desc("all"), "term").limit(features)
    return top.select("term", F.explode("cells").alias("c")).select(f"c.{group}", "term", "c.tf")


def class_tfidf(counts: DataFrame, group: str) -> DataFrame:
    """(1 + ln tf) * ln(1 + A / f): f is the number of groups with the term, A its mean over terms."""
    terms = counts.groupBy("term").agg(F.collect_list(F.struct(group, "tf")).alias("cells"))
    mean = terms.withColumn("a", F.avg(F.size("cells")).over(W.partitionBy()))  # one row for each term, of which there are a few thousand
    weight = (1 + F.ln("c.tf")) * F.ln(1 + F.col("a") / F.col("f"))
    return mean.select("term", "a", F.size("cells").alias("f"), F.explode("cells").alias("c")).select(f"c.{group}", "term", weight.alias("weight"))


def tfidf(counts: DataFrame, group: str, sublinear: bool = False) -> DataFrame:
    """tf * (ln((1 + n) / (1 + df)) + 1) with rows of length 1; n is the number of groups; sublinear: 1 + ln tf."""
    terms = counts.groupBy("term").agg(F.collect_list(F.struct(group, "tf")).alias("cells"))
    own = terms.select("term", F.size("cells").alias("df"), F.explode("cells").alias("c")).select(f"c.{group}", "term", "c.tf", "df")
    # the number of groups: each cell is one of its group's number of cells
    n = F.sum(F.lit(1.0) / F.col("size")).over(W.partitionBy())
    sized = own.withColumn("size", F.count("*").over(W.partitionBy(group))).withColumn("n", F.round(n))
    tf = 1 + F.ln("tf") if sublinear else F.col("tf")
    raw = sized.withColumn("w", tf * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(group)))).select(group, "term", "weight")


def top_terms(weights: DataFrame, group: str, top: int = 8) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.round("weight", 9)), "term"))
    return weights.filter("weight > 0").withColumn("rank", rank).filter(F.col("rank") <= top).select(group, "rank", "term", F.round("weight", 6).alias("weight"))
