"""Vectors as arrays of doubles: products, centroids, medoids, nearest centroid, representatives, search, clustering."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Of length 1; a vector of length 0 stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def finite(a: Column) -> Column:
    return a.isNotNull() & F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def centroids(rows: DataFrame, cluster: str, vector: str, scaled: bool = False) -> DataFrame:
    """(cluster, n, centroid): the mean of each cluster's vectors, by component; scaled: of length 1, and those of length 0 left out."""
    part = rows.filter(finite(F.col(vector))).select(cluster, F.posexplode(vector).alias("i", "x"))
    mean = part.groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    out = mean.groupBy(cluster).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))
    return out.filter(norm(F.col("centroid")) > 0).withColumn("centroid", unit(F.col("centroid"))) if scaled else out


def with_distance(rows: DataFrame, centers: DataFrame, cluster: str, vector: str) -> DataFrame:
    return rows.join(F.broadcast(centers.select(cluster, "centroid")), cluster).withColumn("distance", distance(F.col(vector), F.col("centroid"))).drop("centroid")


def medoids(rows: DataFrame, centers: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """The member of each cluster nearest to its centroid, ties to the lesser key."""
    return with_distance(rows, centers, cluster, vector).groupBy(cluster).agg(F.min(F.struct(F.round("distance", 9).alias("distance"), key)).alias("m")).select(cluster, F.col(f"m.{key}").alias(key), F.round("m.distance", 6).alias("distance"))


def representatives(rows: DataFrame, centers: DataFrame, cluster: str, vector: str, key: str, n: int = 3) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(cluster).orderBy(F.round("distance", 9), key))
    return with_distance(rows, centers, cluster, vector).withColumn("rank", rank).filter(F.col("rank") <= n).select(cluster, "rank", key, F.round("distance", 6).alias("distance"))


def strata(rows: DataFrame, centers: DataFrame, cluster: str, vector: str, key: str, percents: tuple[int, ...] = tuple(range(0, 100, 10))) -> DataFrame:
    """The member at each percentile of distance: place floor(p / 100 * (n - 1))."""
    own = with_distance(rows, centers, cluster, vector)
    w = W.partitionBy(cluster)
    ranked = own.withColumns({"r": F.row_number().over(w.orderBy(F.round("distance", 9), key)), "n": F.count("*").over(w)})
    picks = ranked.withColumn("p", F.explode(F.filter(F.array(*map(F.lit, percents)), lambda p: F.floor(p / 100 * (F.col("n") - 1)) + 1 == F.col("r"))))
    return picks.select(cluster, F.col("p").cast("int").alias("percentile"), key)


def nearest(rows: DataFrame, centers: DataFrame, cluster: str, vector: str, key: str) -> DataFrame:
    """Each row with the centroid of highest cosine, ties to the lesser cluster; -1 for a null vector.

    centers is a dimension of one row for each cluster; it goes to the rows as one array, so no vector moves and rows that
    repeat a key stand for themselves.
    """
    every = centers.agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "centroid")).alias("__all"))
    best = F.array_max(F.transform("__all", lambda x: F.struct(F.round(cosine(F.col(vector), x["centroid"]), 6).alias("similarity"), (-x["c"]).alias("c"))))
    out = rows.crossJoin(F.broadcast(every)).withColumn("__best", best)
    none = F.col(vector).isNull() | F.col("__best").isNull()
    return out.select(key, F.when(none, -1).otherwise(-F.col("__best.c")).alias(cluster), F.when(none, 0.0).otherwise(F.col("__best.similarity")).alias("similarity"))


def search(rows: DataFrame, query: list[float], vector: str, key: str, n: int = 10) -> DataFrame:
    """The n nearest by cosine, never below 0, rounded to 4 places, ties to the lesser key."""
    s = F.greatest(F.lit(0.0), F.round(cosine(F.col(vector), F.array(*map(F.lit, map(float, query)))), 4))
    return rows.filter(finite(F.col(vector))).select(key, s.alias("similarity")).orderBy(F.desc("similarity"), key).limit(n)


def adaptive_k(n: int, target: int | None = None) -> int:
    """The number of clusters for a number of texts."""
    if target and n > 250:
        return target
    for most, k in ((6, min(n, 2)), (20, 3), (80, 5), (250, 8)):
        if n <= most:
            return max(1, k)
    return max(6, min(18, n // 110))


def k_means(rows: DataFrame, vector: str, k: int, seed: int = 42, cluster: str = "cluster_id") -> tuple[DataFrame, float]:
    """rows with a cluster each, and the sum of squared distances."""
    data = rows.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol=cluster).fit(data)
    return model.transform(data).drop("__x"), model.summary.trainingCost


def outliers(rows: DataFrame, cluster: str, distance_col: str = "distance", share: float = 0.95) -> DataFrame:
    """rows with cluster -1 beyond a quantile of distance in their cluster: what stands for density-based noise here."""
    edge = rows.groupBy(cluster).agg(F.percentile(distance_col, share).alias("__e"))
    return rows.join(F.broadcast(edge), cluster).withColumn(cluster, F.when(F.col(distance_col) > F.col("__e"), -1).otherwise(F.col(cluster))).drop("__e")


def k_sweep(rows: DataFrame, vector: str, ks: tuple[int, ...]) -> list[tuple[int, float, float, int, int]]:
    """(k, inertia, cosine silhouette, least and largest size) for each k."""
    out = []
    for k in ks:
        own, cost = k_means(rows, vector, k)
        own = own.withColumn("__x", array_to_vector(F.col(vector).cast("array<double>")))
        sizes = own.groupBy("cluster_id").count().agg(F.min("count"), F.max("count")).first()
        out.append((k, cost, ClusteringEvaluator(featuresCol="__x", predictionCol="cluster_id", distanceMeasure="cosine").evaluate(own), sizes[0], sizes[1]))
    return out
