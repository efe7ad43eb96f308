"""Severity tiers of themes and complaint clusters, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Thresholds.
THEME = {"critical": 0.35, "critical_volume": 500, "high": 0.35, "medium": 0.20}
COMPLAINT = {"critical": 120, "high": 60, "medium": 20}
WEIGHTS = {"P0": 3.0, "P1": 2.0, "P2": 1.2, "P3": 0.8}
POINTS = {"LOW": 3, "MEDIUM": 5, "HIGH": 13}
EFFORT = {"HIGH": "formula|burn|reaction|ingredient|architecture|rewrite", "MEDIUM": "packaging|pump|cap|leak|biometric|button|ui"}
AS_PRIORITY = {"CRITICAL": "P0", "HIGH": "P1", "MEDIUM": "P2", "LOW": "P3"}


def tier(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), rank + 1)


def base_rank(fraction: Column, volume: Column) -> Column:
    return F.when((fraction >= THEME["critical"]) & (volume >= THEME["critical_volume"]), 3).when(fraction >= THEME["high"], 2).when(fraction >= THEME["medium"], 1).otherwise(0)


def simple_severity(fraction: Column, volume: Column) -> Column:
    """By thresholds alone."""
    return tier(base_rank(fraction, volume))


def theme_severity(fraction: Column, volume: Column, baseline: Column | None = None, p0: Column | None = None, p1: Column | None = None) -> Column:
    """By thresholds, raised by the lift over the corpus's share and by grave propositions, never lowered."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    rank = base_rank(f, volume)
    if baseline is not None:
        lift = f / F.when((baseline > 0) & (volume >= 25), baseline)
        rank = F.greatest(rank, F.when((lift >= 3) & (f >= 0.10) & (volume >= 100), 2).when(lift >= 1.25, 1).otherwise(0))
    zero = F.lit(0)
    p0, p1 = (F.coalesce(p, zero) if p is not None else zero for p in (p0, p1))
    grave = F.when((p0 >= 3) | ((p0 >= 1) & ((f >= 0.10) | (volume >= 25))), 3).when(p0 > 0, 2)
    blocked = F.when((p1 >= 5) | ((p1 >= 2) & ((f >= 0.15) | (volume >= 50))), 2).when(p1 > 0, 1)
    return tier(F.greatest(rank, F.when(p0 > 0, grave).otherwise(F.coalesce(blocked, zero))))


def complaint_severity(count: Column, total: Column, p0: Column | None = None, p1: Column | None = None) -> Column:
    """By the share of all complaints, or by volume where their number isn't known."""
    share = count / F.when(total > 0, total)
    known = F.when((share >= 0.20) & (count >= 3), 3).when((share >= 0.14) & (count >= 2), 2).when(share >= 0.08, 1).otherwise(0)
    rank = F.when(total > 0, known).otherwise(F.when(count >= COMPLAINT["critical"], 3).when(count >= COMPLAINT["high"], 2).when(count >= COMPLAINT["medium"], 1).otherwise(0))
    zero = F.lit(0)
    p0, p1 = (F.coalesce(p, zero) if p is not None else zero for p in (p0, p1))
    grave = F.when((p0 >= 2) | ((p0 >= 1) & (count >= 4)), 3).when(p0 > 0, 2)
    blocked = F.when((p1 >= 3) | ((p1 >= 1) & (count >= 5)), 2).when(p1 > 0, 1)
    return tier(F.greatest(rank, F.when(p0 > 0, grave).otherwise(F.coalesce(blocked, zero))))


def thresholds(spark: SparkSession) -> DataFrame:
    """(scope, name, value) of the thresholds in force."""
    rows = [(scope, k, float(v)) for scope, of in (("theme", THEME), ("complaint", COMPLAINT)) for k, v in of.items()]
    return spark.createDataFrame(rows, "scope string, name string, value double")


def effort(title: Column) -> Column:
    t = F.lower(title)
    return F.when(t.rlike(EFFORT["HIGH"]), "HIGH").when(t.rlike(EFFORT["MEDIUM"]), "MEDIUM").otherwise("LOW")


def action_columns(title: Column, count: Column, priority: Column, total: Column) -> dict[str, Column]:
    """Blast radius, impact, effort, story points, expected lift and quadrant of a cluster of complaints."""
    of = lambda m, k, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), k), F.lit(other))
    blast = F.round(count / F.greatest(total, F.lit(1)) * 100, 2)
    impact = F.least(F.round(blast * 4 * of(WEIGHTS, priority, 1.0), 1), F.lit(99.0))
    work = effort(title)
    quadrant = F.when((impact >= 50) & (work != "HIGH"), "QUICK_WIN").when((priority == "P0") | ((impact >= 60) & (work == "HIGH")), "CRITICAL_BLOCKER").when((work == "HIGH") & (impact < 50), "STRATEGIC_REVAMP").otherwise("QUALITY_OF_LIFE")
    return {"blast_radius_pct": blast, "impact_score": impact, "effort": work, "story_points": of(POINTS, work, 5), "csat_lift": F.round(count * 2.7 / F.greatest(total, F.lit(1)), 3), "quadrant": quadrant}
