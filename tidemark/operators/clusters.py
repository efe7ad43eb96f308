"""Clusters of sentences as products: complaints, feature requests and strengths, with titles, tiers and quotes.

Inputs are rows of sentences with a cluster, a vector, a key that orders them, a text and, where it is asked for, severity,
confidence and batch. Clusters are few, so what has one row for each of them is a dimension; members are never gathered but
for the quotes, which are bounded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import title_of
from tidemark.operators import drift as D
from tidemark.operators import keywords as K
from tidemark.operators import severity as S
from tidemark.operators import vectors as V

OUTLIERS, QUOTES, ALIKE = -1, 100, 0.46
#: Titles that clusters of complaints are given where their centroid is near enough.
TAXONOMY = (
    "Dryness & Dehydration", "Skin Sensitivity & Irritation", "Allergic Reaction & Swelling", "Acne Breakouts & Blemishes", "Cystic & Hormonal Acne", "Pore Congestion & Blackheads", "Redness & Skin Flushing",
    "Unpleasant Odor & Scent", "Packaging & Dispenser Defect", "Packaging Leakage & Spillage", "Packaging Breakage & Shattered Bottle", "Greasy Texture & Heavy Residue", "Lack of Results & Inefficacy",
    "Eye Stinging & Irritation", "Lip Chapping & Peeling", "Delivery & Shipping Delays", "Refund & Billing Friction", "Burning & Itching Sensation", "Formula Stripping & Tightness", "Formula Separation & Discoloration",
)
OUTLIER_TITLE, OUTLIER_WORDS = "Zero-Day Outlier Radar", ("unclassified", "novel-defect", "emerging")


def number_of_clusters(n: int, wished: int) -> int:
    """Of requests and strengths: one for each four sentences, at most as many as wished."""
    return max(1, min(wished, max(1, n // 4), n))


def keyword_lists(sentences: DataFrame, cluster: str, tokens: Column, top: int = 6) -> DataFrame:
    """(cluster, keywords): the terms of highest class-based weight, outliers left out."""
    best = K.top_terms(K.class_tfidf(K.term_counts(sentences.filter(F.col(cluster) >= 0), cluster, tokens, []), cluster), cluster, top)
    return best.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))


def medoid_first(sentences: DataFrame, cluster: str, vector: str, key: str, text: str, most: int = QUOTES) -> DataFrame:
    """(cluster, medoid, medoid_verbatim, quotes): keys of at most so many members, the medoid first, then by key."""
    own = V.medoids(sentences, V.centroids(sentences, cluster, vector), cluster, vector, key).select(cluster, F.col(key).alias("medoid"))
    early = sentences.withColumn("__r", F.row_number().over(W.partitionBy(cluster).orderBy(key))).filter(F.col("__r") <= most)
    # one more than needed is looked at, as the medoid may stand among the first
    lists = early.groupBy(cluster).agg(F.array_sort(F.collect_list(key)).alias("early"))
    named = sentences.select(cluster, F.col(key).alias("medoid"), F.col(text).alias("medoid_verbatim"))
    quotes = F.slice(F.concat(F.array("medoid"), F.array_remove("early", F.col("medoid"))), 1, most)
    return lists.join(own, cluster).join(named, [cluster, "medoid"]).select(cluster, "medoid", "medoid_verbatim", quotes.alias("quotes"))


def titles_of(similar: DataFrame, cluster: str, least: float = ALIKE) -> DataFrame:
    """(cluster, title) from (cluster, title, similarity): clusters in order take the nearest title that is near enough and not taken.

    There is a row for each cluster and candidate, so one task decides.
    """
    near = similar.filter(F.col("similarity") >= least).groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "title"))), lambda x: x["title"]).alias("wanted"))
    all_ = near.agg(F.array_sort(F.collect_list(F.struct(F.col(cluster).alias("c"), "wanted"))).alias("all"))
    kind = "array<struct<c:" + dict(similar.dtypes)[cluster] + ",title:string>>"

    def take(done: Column, x: Column) -> Column:
        free = F.get(F.array_except(x["wanted"], F.transform(done, lambda d: d["title"])), F.lit(0))
        return F.when(free.isNull(), done).otherwise(F.concat(done, F.array(F.struct(x["c"].alias("c"), free.alias("title")))))

    return all_.select(F.inline(F.aggregate("all", F.array().cast(kind), take))).select(F.col("c").alias(cluster), "title")


def complaint_clusters(sentences: DataFrame, cluster: str, vector: str, key: str, text: str, tokens: Column, severity: str = "severity", batch: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """A row for each cluster: title, keywords, size, severity, medoid, quotes and, with batch, the batch at risk; outliers first, then the largest.

    titles: (cluster, title) that go before those made of keywords.
    """
    size = sentences.groupBy(cluster).agg(F.count("*").alias("sentence_count"), *(F.count_if(F.col(severity) == p).alias(p.lower()) for p in ("P0", "P1")))
    out = size.crossJoin(F.broadcast(size.agg(F.sum("sentence_count").alias("total"))))
    out = out.join(medoid_first(sentences, cluster, vector, key, text), cluster).join(keyword_lists(sentences, cluster, tokens), cluster, "left")
    out = out.join(titles, cluster, "left") if titles is not None else out.withColumn("title", F.lit(None).cast("string"))
    odd, n = F.col(cluster) == OUTLIERS, F.col("sentence_count")
    words = F.when(odd, F.array(*map(F.lit, OUTLIER_WORDS))).otherwise(F.coalesce("keywords", F.array().cast("array<string>")))
    made = F.when(F.size(words) > 0, title_of(words)).otherwise(F.concat(F.lit("Cluster "), F.col(cluster).cast("string")))
    grave = ((n / F.col("total") >= 0.10) & (n >= 3)) | (F.col("p0") >= 1)
    tier = F.when(odd, F.when(grave, "HIGH").otherwise("MEDIUM")).otherwise(S.complaint_severity(n, F.col("total"), F.col("p0"), F.col("p1")))
    out = out.select(cluster, F.when(odd, OUTLIER_TITLE).otherwise(F.coalesce("title", made)).alias("title"), words.alias("keywords"), n, tier.alias("severity"), "medoid", "medoid_verbatim", "quotes")
    if batch:
        out = out.join(D.relative_risk(sentences, cluster, batch).select(cluster, F.col(batch).alias("affected_batch"), "relative_risk", "significant"), cluster)
    return out.orderBy(F.when(F.col(cluster) == OUTLIERS, 0).otherwise(1), F.desc("sentence_count"), cluster)


def shares(sentences: DataFrame, cluster: str, vector: str, key: str, text: str, tokens: Column, most: int, *more: Column) -> DataFrame:
    size = sentences.groupBy(cluster).agg(F.count("*").alias("n"), *more)
    out = size.crossJoin(F.broadcast(size.agg(F.sum("n").alias("total")))).withColumn("share", F.col("n") / F.col("total"))
    return out.join(medoid_first(sentences, cluster, vector, key, text, most), cluster).join(keyword_lists(sentences, cluster, tokens), cluster, "left")


def feature_requests(sentences: DataFrame, cluster: str, vector: str, key: str, text: str, tokens: Column) -> DataFrame:
    """A row for each cluster: title, keywords, votes, priority by share, medoid and its first five members; most votes first."""
    own = shares(sentences, cluster, vector, key, text, tokens, 5)
    priority = F.when((F.col("share") >= 0.28) & (F.col("n") >= 2), "HIGH").when(F.col("share") >= 0.16, "MEDIUM").otherwise("LOW")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    title = F.when(F.size(words) > 0, F.concat(title_of(words), F.lit(" Request"))).otherwise(F.concat(F.lit("Feature Proposal #"), (F.col(cluster) + 1).cast("string")))
    return own.select(F.col(cluster).alias("request_id"), title.alias("title"), words.alias("keywords"), F.col("n").alias("vote_count"), priority.alias("priority"), F.col("medoid_verbatim").alias("medoid_quote"), F.array_sort("quotes").alias("samples")).orderBy(F.desc("vote_count"), "request_id")


def praise_clusters(sentences: DataFrame, cluster: str, vector: str, key: str, text: str, tokens: Column, confidence: str = "confidence") -> DataFrame:
    """A row for each cluster: title, keywords, size, delight score (mean confidence times 100) and tier, medoid, quotes; the largest first."""
    own = shares(sentences, cluster, vector, key, text, tokens, QUOTES, F.round(F.avg(confidence) * 100, 1).alias("delight_score"))
    tier = F.when((F.col("share") >= 0.28) & (F.col("n") >= 3), "EXCEPTIONAL").when(F.col("share") >= 0.15, "STRONG").otherwise("NOTABLE")
    words = F.coalesce("keywords", F.array().cast("array<string>"))
    title = F.when(F.size(words) > 0, title_of(words)).otherwise(F.concat(F.lit("Product Strength #"), (F.col(cluster) + 1).cast("string")))
    return own.select(cluster, title.alias("title"), words.alias("keywords"), F.col("n").alias("praise_count"), "delight_score", tier.alias("delight_tier"), "medoid", "medoid_verbatim", "quotes").orderBy(F.desc("praise_count"), cluster)


def theme_order(themes: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Critical themes first, then by negative rate and size; the outlier theme last."""
    return themes.orderBy(F.when(F.col(cluster) == OUTLIERS, 1).otherwise(0), F.when(F.col("severity") == "CRITICAL", 0).otherwise(1), F.desc("negative_rate"), F.desc("review_count"), cluster)


def prioritized(clusters: DataFrame, cluster: str = "cluster_id", top: int = 3) -> DataFrame:
    """The gravest clusters, of equal tiers the largest."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, S.TIERS)), F.col("severity")), F.lit(0))
    return clusters.orderBy(F.desc(rank), F.desc("sentence_count"), cluster).limit(top)


def cluster_figures(clusters: DataFrame) -> DataFrame:
    """One row: citations of all clusters, the largest, how many are critical or high."""
    n = F.col("sentence_count")
    return clusters.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total_citations"), F.coalesce(F.max(n), F.lit(0)).alias("largest"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"))


def praise_figures(clusters: DataFrame) -> DataFrame:
    """One row: mentions of all strengths, and their mean delight (missing: 85)."""
    return clusters.agg(F.coalesce(F.sum("praise_count"), F.lit(0)).alias("total"), F.round(F.avg(F.coalesce("delight_score", F.lit(85.0))), 1).alias("mean_delight"))


def clustered(rows: DataFrame, vector: str, k: int, modes: Mapping[str, object], mode: str = "kmeans", cluster: str = "cluster_id") -> DataFrame:
    """rows with a cluster by the named mode, a function (rows, vector, k) -> DataFrame; k-means where there is none of that name or it fails."""
    if mode in modes:
        try:
            return modes[mode](rows, vector, k)
        except (ImportError, ValueError):
            pass
    return V.k_means(rows, vector, k, cluster=cluster)[0]
