"""Aggregates over reviews, each one grouped plan; columns are named by parameters with the canonical names as defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTIMENTS = ("NEGATIVE", "NEUTRAL", "POSITIVE")


def rate(part: Column, whole: Column, places: int = 1) -> Column:
    """A percentage, 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, places)).otherwise(0.0)


def counted(column: str, values: tuple[str, ...] = SENTIMENTS) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(f"{v.lower()}_count") for v in values]


def sentiment_summary(reviews: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    out = reviews.agg(F.count("*").alias("total"), *counted(sentiment))
    return out.withColumns({"positive_rate": rate(F.col("positive_count"), F.col("total")), "negative_rate": rate(F.col("negative_count"), F.col("total"))})


def dense(counts: DataFrame, key: str, values: list, spark: SparkSession, kind: str) -> DataFrame:
    """counts with a row for each of the values, 0 where there was none."""
    grid = spark.createDataFrame([(v,) for v in values], f"{key} {kind}")
    return grid.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rating_distribution(reviews: DataFrame, rating: str = "rating") -> DataFrame:
    """Stars 1 to 5 with count and percentage of all rows, rated or not."""
    counts = reviews.groupBy(F.col(rating).cast("int").alias("star")).agg(F.count("*").alias("n"))
    total = reviews.agg(F.count("*").alias("total"))
    return dense(counts, "star", [1, 2, 3, 4, 5], reviews.sparkSession, "int").crossJoin(F.broadcast(total)).select("star", "n", rate(F.col("n"), F.col("total")).alias("percent"))


def sentiment_by(reviews: DataFrame, key: str, sentiment: str = "sentiment", missing: str = "Direct") -> DataFrame:
    out = reviews.groupBy(F.coalesce(key, F.lit(missing)).alias("label")).agg(F.count("*").alias("n"), *counted(sentiment))
    return out.select("label", "n", *(rate(F.col(f"{s.lower()}_count"), F.col("n"), 2).alias(s[:3].lower()) for s in SENTIMENTS))


def theme_summary(reviews: DataFrame, theme: str = "theme", sentiment: str = "sentiment") -> DataFrame:
    out = reviews.groupBy(theme).agg(F.count("*").alias("review_count"), *counted(sentiment))
    return out.withColumn("negative_rate", rate(F.col("negative_count"), F.col("review_count")))


def first_rows(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group, in an order that should be total."""
    return rows.withColumn("turn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("turn") <= n)


def product_matrix(reviews: DataFrame, product: str = "product_name", rating: str = "rating", bad: str = "sentiment = 'NEGATIVE'", batch: str = "batch", least: int = 15) -> DataFrame:
    """Per product of at least so many reviews: count, mean rating, share of complaints, first three cohorts with one, risk tier."""
    complaint = F.expr(bad)
    out = reviews.groupBy(product).agg(F.count("*").alias("n"), F.round(F.avg(rating), 2).alias("avg_rating"), F.count_if(complaint).alias("complaints"), F.slice(F.array_sort(F.collect_set(F.when(complaint, F.col(batch)))), 1, 3).alias("cohorts"))
    share = rate(F.col("complaints"), F.col("n"))
    tier = F.when(share >= 40, "HIGH").when(share >= 20, "MEDIUM").otherwise("LOW")
    return out.filter(F.col("n") >= least).select(product, "n", "avg_rating", "complaints", share.alias("defect_pct"), F.array_join("cohorts", ",").alias("cohorts"), tier.alias("risk"))


def rating_divergence(reviews: DataFrame, rating: str = "rating", bad: str = "sentiment = 'NEGATIVE'") -> DataFrame:
    """Per star its rows and complaints; and the share of the complaints that stand at 4 stars or more."""
    counts = reviews.groupBy(F.col(rating).alias("star")).agg(F.count("*").alias("n"), F.count_if(F.expr(bad)).alias("complaints"))
    hidden = counts.agg(F.sum(F.when(F.col("star") >= 4, F.col("complaints"))).alias("hidden"), F.sum("complaints").alias("all_complaints"))
    return counts.crossJoin(F.broadcast(hidden)).select("star", "n", "complaints", rate(F.col("hidden"), F.col("all_complaints")).alias("hidden_pct"))


def cohort_stats(reviews: DataFrame, side: Column, rating: str = "rating", sentiment: str = "sentiment") -> DataFrame:
    """Both sides of a comparison in one pass; a missing rating counts as 3."""
    value = F.coalesce(F.col(rating), F.lit(3))
    out = reviews.withColumn("side", side).filter("side is not null").groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg(value), 2).alias("avg_rating"), *counted(sentiment), *(F.count_if(value == s).alias(f"stars_{s}") for s in range(1, 6)))
    return out.select("side", "n", "avg_rating", *(rate(F.col(f"{s.lower()}_count"), F.col("n")).alias(f"{s.lower()}_pct") for s in SENTIMENTS), *(f"stars_{s}" for s in range(1, 6)))


def topic_shifts(reviews: DataFrame, side: Column, theme: str = "theme", top: int = 6) -> DataFrame:
    """The themes whose share moves most from side A to side B: difference, ratio, direction at 1.5 points."""
    own = reviews.withColumn("side", side).filter("side is not null")
    sums = own.groupBy(theme).agg(F.count_if(F.col("side") == "A").alias("a"), F.count_if(F.col("side") == "B").alias("b"))
    both = sums.crossJoin(F.broadcast(own.agg(F.count_if(F.col("side") == "A").alias("na"), F.count_if(F.col("side") == "B").alias("nb"))))
    pa, pb = F.round(F.col("a") * 100.0 / F.greatest("na", F.lit(1)), 2), F.round(F.col("b") * 100.0 / F.greatest("nb", F.lit(1)), 2)
    out = both.select(theme, pa.alias("pct_a"), pb.alias("pct_b"), F.round(pb - pa, 2).alias("delta_pp"), F.round(pb / F.greatest(pa, F.lit(0.001)), 2).alias("ratio"))
    out = out.withColumn("direction", F.when(F.col("delta_pp") >= 1.5, "SURGE").when(F.col("delta_pp") <= -1.5, "DROP").otherwise("STABLE"))
    return out.orderBy(F.desc(F.abs("delta_pp")), theme).limit(top)


def verdict(stats: DataFrame) -> DataFrame:
    """IMPROVED, REGRESSED or STABLE from the differences of a two-sided comparison."""
    one = stats.agg(*(F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "AB" for c in ("avg_rating", "negative_pct")))
    dr, dn = F.round(F.col("avg_rating_B") - F.col("avg_rating_A"), 2), F.round(F.col("negative_pct_B") - F.col("negative_pct_A"), 1)
    return one.select(dr.alias("rating_delta"), dn.alias("negative_delta"), F.when((dr <= -0.2) | (dn >= 4.0), "REGRESSED").when((dr >= 0.2) | (dn <= -4.0), "IMPROVED").otherwise("STABLE").alias("verdict"))


def entity_summary(rows: DataFrame, entities: str = "entities") -> DataFrame:
    """One row: how many rows have redacted entities, and their share. entities: joined by ;, empty or null for none."""
    hit = F.coalesce(F.col(entities), F.lit("")) != ""
    return rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("pii_count"), rate(F.count_if(hit), F.count("*")).alias("pii_rate"))


def release_measures(reviews: DataFrame, cohort: str = "batch", sentiment: str = "sentiment") -> DataFrame:
    """Per cohort the share of positive and of negative reviews, and how the negative share moved since the one before."""
    n, of = F.count("*"), lambda s: F.count_if(F.col(sentiment) == s) * 100.0 / F.count("*")
    out = reviews.filter(F.col(cohort).isNotNull()).groupBy(cohort).agg(n.alias("n"), of("POSITIVE").alias("p"), of("NEGATIVE").alias("neg"))
    before = F.lag("neg").over(W.orderBy(cohort))  # one row for each cohort
    return out.select(cohort, F.round("p", 2).alias("sentiment_index"), F.round("neg", 2).alias("negative_pct"), F.round(F.col("neg") - before, 2).alias("negative_delta"))


def word_counts(texts: DataFrame, tokens: Column, stop: list[str], top: int = 60) -> DataFrame:
    words = texts.select(F.explode(tokens).alias("word")).filter(~F.col("word").isin(*stop) if stop else F.lit(True))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def classification(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class: precision, recall, F1, support, from one grouped count."""
    cell = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    rows = cell.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")))).alias("r")).select("r.*")
    s = rows.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("said").alias("said"))
    p, r = (F.when(F.col(x) > 0, F.col("hit") / F.col(x)).otherwise(0.0) for x in ("said", "support"))
    return s.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support")


def overall(pairs: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: accuracy, the means over classes of precision, recall and F1 (to 4 places), and how many rows."""
    cell = pairs.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    both = cell.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true"), F.lit(0).cast("long").alias("said")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true"), F.col("n").alias("said")))).alias("r")).select("r.*")
    s = both.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("true").alias("support"), F.sum("said").alias("said"))
    p, r = (F.when(F.col(x) > 0, F.col("hit") / F.col(x)).otherwise(0.0) for x in ("said", "support"))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return s.agg(F.round(F.sum("hit") / F.sum("support"), 4).alias("accuracy"), *(F.round(F.avg(x), 4).alias(f"macro_{n}") for n, x in (("precision", p), ("recall", r), ("f1", f))), F.sum("support").alias("n"))


def compared(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """One row: the accuracy of two guesses on the same rows, the difference, and how often they disagree."""
    right = lambda g: F.avg((F.col(g) == F.col(truth)).cast("int"))
    other, n = F.count_if(F.col(a) != F.col(b)), F.count("*")
    return rows.agg(F.round(right(a), 4).alias("accuracy_a"), F.round(right(b), 4).alias("accuracy_b"), F.round(right(b) - right(a), 4).alias("accuracy_delta"), other.alias("disagree"), rate(other, n, 2).alias("disagreement_pct"), n.alias("n"))


def coverage(rows: DataFrame, label: str) -> DataFrame:
    """One row: the share of rows that have a label."""
    return rows.agg(rate(F.count(label), F.count("*"), 2).alias("coverage_pct"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def linkage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows of left, how many have their key in right, and the share."""
    own = left.join(right.select(key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return own.agg(F.count("*").alias("rows"), F.count("__hit").alias("linked"), rate(F.count("__hit"), F.count("*"), 2).alias("linkage_pct"))


def reliability(scored: DataFrame, truth: Column, p: Column, bins: int = 10) -> DataFrame:
    """Per bin of probability that has rows: how many, mean probability, share that is true."""
    return scored.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean_p"), F.round(F.avg(truth.cast("double")), 4).alias("observed"))


def loss(scored: DataFrame, truth: Column, p: Column) -> DataFrame:
    """Brier score of both classes and log loss, the probability kept off 0 and 1."""
    y, safe = truth.cast("double"), F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return scored.agg(F.round(F.avg(2 * (p - y) * (p - y)), 4).alias("brier"), F.round(F.avg(-F.when(truth, F.ln(safe)).otherwise(F.ln(1 - safe))), 4).alias("log_loss"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of rows in a total order, with how many there are, how many pages, and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    own = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return own.crossJoin(F.broadcast(total)).withColumns({"pages": F.ceil(F.col("total") / size), "has_more": F.col("total") > number * size})
