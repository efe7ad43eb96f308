"""Drift between cohorts: population stability index, attribution with exact tests, timeline, alerts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON, MODERATE, CRITICAL, LEAST_ROWS = 1e-4, 0.10, 0.25, 100


def fisher(a: Column, b: Column, c: Column, d: Column, two_sided: bool = False) -> Column:
    """p of Fisher's exact test of the table (a, b; c, d): of a or more in the first cell, or of any table as unlikely.

    In numpy, as the sum runs over a table's possible first cells. Those over 40 standard deviations from the mean, whose
    probability a double can't tell from 0, are passed over, so a test of any size takes bounded memory.
    """

    def log_factorial(x):
        x = np.asarray(x, float)
        y = x + 1
        shift = np.zeros_like(y)
        for _ in range(12):  # to where the series is exact
            small = y < 12
            shift = np.where(small, shift - np.log(np.where(small, y, 1)), shift)
            y = np.where(small, y + 1, y)
        return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)

    def one(a: int, b: int, c: int, d: int) -> float:
        row, col, n = a + b, a + c, a + b + c + d
        if min(a, b, c, d) < 0 or n == 0:
            return 1.0
        mean, sd = row * col / n, (row * col * (n - row) * (n - col) / max(1, n * n * (n - 1))) ** 0.5
        low, high = max(0, col - (n - row), int(mean - 40 * sd - 60)), min(row, col, int(mean + 40 * sd + 60))
        x = np.arange(min(low, a), max(high, a) + 1, dtype=float)
        lf = log_factorial
        p = lf(row) + lf(n - row) + lf(col) + lf(n - col) - lf(n) - lf(x) - lf(row - x) - lf(col - x) - lf(n - row - col + x)
        mine = p[int(a - x[0])]
        return float(min(1.0, np.exp(p[p <= mine + 1e-7] if two_sided else p[x >= a]).sum()))

    @F.pandas_udf("double")
    def test(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([one(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype="float64")

    return test(a.cast("long"), b.cast("long"), c.cast("long"), d.cast("long"))


def distributions(reviews: DataFrame, cohort: str = "batch", theme: str = "theme") -> DataFrame:
    return reviews.filter(F.col(cohort).isNotNull()).groupBy(cohort, theme).agg(F.count("*").alias("n"))


def pairs(counts: DataFrame, cohort: str = "batch", theme: str = "theme") -> DataFrame:
    """(cohort, previous, theme, kt, kb, nt, nb): every theme of a cohort or of the one before it, with both counts and totals."""
    totals = counts.groupBy(cohort).agg(F.sum("n").alias("nt"))
    order = W.orderBy(cohort)  # one row for each cohort
    ranked = totals.withColumns({"previous": F.lag(cohort).over(order), "nb": F.lag("nt").over(order)})
    now = counts.select(cohort, theme, F.col("n").alias("kt"), F.lit(0).cast("long").alias("kb"))
    then = ranked.filter("previous is not null").select(cohort, F.col("previous").alias("__p")).join(counts.select(F.col(cohort).alias("__p"), theme, "n"), "__p")
    both = now.union(then.select(cohort, theme, F.lit(0).cast("long"), "n")).groupBy(cohort, theme).agg(F.sum("kt").alias("kt"), F.sum("kb").alias("kb"))
    return both.join(ranked, cohort)


def psi(kt: Column, nt: Column, kb: Column, nb: Column) -> Column:
    """The sum over the rows of a group, never below 0; the shares get EPSILON each and aren't normalised again."""
    t, b = kt / nt + EPSILON, kb / nb + EPSILON
    return F.greatest(F.lit(0.0), F.sum((t - b) * F.ln(t / b)))


def timeline(reviews: DataFrame, cohort: str = "batch", theme: str = "theme", sentiment: str = "sentiment") -> DataFrame:
    """A row for each cohort in order: counts, negative rate, psi against the one before, status.

    All comes from one count of cohorts, themes and sentiments, which is small, so reviews are read once.
    """
    cells = reviews.filter(F.col(cohort).isNotNull()).groupBy(cohort, theme, sentiment).agg(F.count("*").alias("n"))
    of = lambda s: F.sum(F.when(F.col(sentiment) == s, F.col("n")).otherwise(0)).alias(f"{s.lower()}_count")
    counted = cells.groupBy(cohort).agg(F.sum("n").alias("review_count"), *map(of, ("NEGATIVE", "NEUTRAL", "POSITIVE")))
    moved = pairs(cells.groupBy(cohort, theme).agg(F.sum("n").alias("n")), cohort, theme).groupBy(cohort).agg(psi(F.col("kt"), F.col("nt"), F.col("kb"), F.col("nb")).alias("psi"), F.first("previous").alias("previous"))
    joined = counted.join(moved, cohort)
    few = F.col("review_count") < LEAST_ROWS
    value = F.when(F.col("previous").isNull(), 0.0).when(~few, F.round("psi", 4))
    status = F.when(F.col("previous").isNull(), "BASELINE").when(few, "INSUFFICIENT_DATA").when(F.col("psi") >= CRITICAL, "CRITICAL_DRIFT").when(F.col("psi") >= MODERATE, "MODERATE_DRIFT").otherwise("STABLE")
    return joined.withColumns({"psi": value, "status": status, "negative_rate": F.round(F.col("negative_count") * 100.0 / F.col("review_count"), 1)}).drop("previous")


def drift_rows(line: DataFrame, drivers: DataFrame | None = None, cohort: str = "batch", theme: str = "theme") -> DataFrame:
    """The rows that a report of drift has: the timeline in order, with the theme that rose most in each cohort and by how much."""
    out = line.select(F.col(cohort).alias("Batch_or_Version"), F.col("review_count").alias("Total_Reviews"), F.col("negative_count").alias("Negative_Count"), F.col("positive_count").alias("Positive_Count"), F.col("neutral_count").alias("Neutral_Count"), F.col("negative_rate").alias("Negative_Rate_Pct"), F.col("psi").alias("PSI_Score"), F.col("status").alias("Drift_Status"))
    if drivers is None:
        return out
    best = drivers.groupBy(F.col(cohort).alias("Batch_or_Version")).agg(F.min_by(F.struct(F.col(theme).alias("t"), F.col("rate_delta_pp").alias("d")), F.struct(-F.col("rate_delta_pp"), F.col(theme))).alias("b"))
    return out.join(best, "Batch_or_Version", "left").select(*out.columns, F.col("b.t").alias("Primary_Surging_Theme"), F.coalesce("b.d", F.lit(0.0)).alias("Surging_Delta_Pct"))


def psi_band(line: DataFrame, least: float = CRITICAL, strict: bool = False) -> DataFrame:
    """The cohorts whose psi reaches a threshold; strict: exceeds it, as the client has it."""
    return line.filter(F.col("psi") > least if strict else F.col("psi") >= least)


def explicit_order(counts: DataFrame, order: list[str], cohort: str = "batch") -> DataFrame:
    """counts with cohorts named by their place in a given order, in which they then stand; those that it doesn't name go."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(cohort))
    return counts.filter(place > 0).withColumn(cohort, F.concat(F.lpad((place - 1).cast("string"), 6, "0"), F.lit("|"), F.col(cohort)))


def attribution(counts: DataFrame, cohort: str = "batch", theme: str = "theme") -> DataFrame:
    """Per cohort and theme against the cohort before: rates, their difference, corrected relative risk, exact tests, significance."""
    kt, kb, nt, nb = (F.col(c) for c in ("kt", "kb", "nt", "nb"))
    out = pairs(counts, cohort, theme).filter("previous is not null")
    p = fisher(kt, nt - kt, kb, nb - kb)
    delta = (kt / nt - kb / nb) * 100
    out = out.withColumns({"p": p, "p2": fisher(kt, nt - kt, kb, nb - kb, True), "delta": delta})
    return out.select(
        cohort, theme, kt.alias("target_count"), kb.alias("baseline_count"), F.round(kt / nt * 100, 2).alias("target_rate_pct"), F.round(kb / nb * 100, 2).alias("baseline_rate_pct"),
        F.round("delta", 2).alias("rate_delta_pp"), F.round(((kt + 0.5) / (nt + 0.5)) / ((kb + 0.5) / (nb + 0.5)), 2).alias("relative_risk"), F.round("p", 5).alias("p_value"), F.round("p2", 5).alias("p_value_two_sided"),
        ((F.col("p") < 0.05) & (kt >= 3) & (F.col("delta") > 0)).alias("significant"),
        F.when(F.col("p") < 0.001, "p < 0.001").when(F.col("p") < 0.05, "p < 0.05").otherwise("n.s.").alias("tier"),
    )


def alerts(line: DataFrame, drivers: DataFrame, cohort: str = "batch", theme: str = "theme", top: int = 3) -> DataFrame:
    """The cohorts that drift, with their level and up to three drivers, the largest rise first."""
    rank = F.row_number().over(W.partitionBy(cohort).orderBy(F.desc("rate_delta_pp"), "p_value", theme))
    best = drivers.withColumn("r", rank).filter(F.col("r") <= top).groupBy(cohort).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", theme))), lambda x: x[theme]).alias("drivers"))
    level = F.when(F.col("status") == "CRITICAL_DRIFT", "CRITICAL").otherwise("WARNING")
    return line.filter(F.col("status").isin("CRITICAL_DRIFT", "MODERATE_DRIFT")).join(best, cohort, "left").select(cohort, "psi", level.alias("level"), F.get("drivers", F.lit(0)).alias("top_driver"), "drivers")


def relative_risk(rows: DataFrame, cluster: str, batch: str) -> DataFrame:
    """Per cluster its most frequent batch, and that batch's risk in the cluster against the rest of the corpus, 1.0 unless significant."""
    own = rows.withColumn(batch, F.coalesce(batch, F.lit("General")))
    cell = own.groupBy(cluster, batch).agg(F.count("*").alias("k"))
    cell = cell.withColumn("n", F.sum("k").over(W.partitionBy(cluster))).withColumn("all_batch", F.sum("k").over(W.partitionBy(batch)))
    turn = F.row_number().over(W.partitionBy(cluster).orderBy(F.desc("k"), batch))
    best = cell.withColumn("turn", turn).filter("turn = 1").crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))
    k, n, b, t = (F.col(c) for c in ("k", "n", "all_batch", "total"))
    rest = F.greatest((b - k) / F.greatest(t - n, F.lit(1)), F.lit(1e-4))
    p = fisher(k, n - k, b - k, t - n - (b - k))
    risk = (k / n) / rest
    sure = (p < 0.05) & (n >= 3) & (risk >= 1.5)
    return best.select(cluster, F.when(n < 3, "Omnichannel").otherwise(F.col(batch)).alias("batch"), n.alias("n"), F.when(sure, F.round(risk, 2)).otherwise(1.0).alias("relative_risk"), sure.alias("significant"))
