"""Writing results: versioned runs, star schema, upserts, caches keyed by content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.artifacts import exists


def write_run(frames: dict[str, DataFrame], path: str, run_id: str, kind: str = "parquet") -> None:
    """Each frame without raw_text below its name and the run's id, as parquet or json; a NaN or an infinity fails the write."""
    for name, df in frames.items():
        out = df.drop("raw_text")
        for c, t in out.dtypes:
            if t in ("double", "float"):
                bad = F.isnan(c) | (F.abs(c) == float("inf"))
                out = out.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} isn't a number"))).otherwise(F.col(c)))
        out.write.mode("overwrite").format(kind).save(f"{path}/{name}/run_id={run_id}")


def read_latest(spark: SparkSession, path: str, name: str, kind: str = "parquet") -> DataFrame:
    """The rows of the latest run."""
    df = spark.read.option("basePath", f"{path}/{name}").format(kind).load(f"{path}/{name}/run_id=*")
    last = df.agg(F.max("run_id")).first()[0]
    return df.filter(F.col("run_id") == last).drop("run_id")


def bootstrap(spark: SparkSession, root: str, schemas: dict[str, str], partition: str) -> list[str]:
    """Makes the tables that aren't there yet, empty; their names."""
    made = [n for n in schemas if not exists(spark, f"{root}/{n}")]
    for n in made:
        spark.createDataFrame([], schemas[n]).write.partitionBy(partition).parquet(f"{root}/{n}")
    return made


def upsert(spark: SparkSession, new: DataFrame, path: str, key: str, partition: str, overwrite: bool = False, order: str | None = None) -> None:
    """Rows of new keys, or with overwrite whole partitions anew; of rows with one key the first by order stays (without: any of the least)."""
    by = [order] if order else [c for c in new.columns if c != key]
    once = new.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*by))).filter("__r = 1").drop("__r")
    if overwrite:
        once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        return
    if exists(spark, path):
        once = once.join(spark.read.parquet(path).select(key), key, "left_anti")
    once.write.mode("append").partitionBy(partition).parquet(path)


def insert_if_empty(spark: SparkSession, new: DataFrame, path: str) -> bool:
    """Writes new where nothing is yet; whether it did."""
    if exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    new.write.mode("overwrite").parquet(path)
    return True


def save_ticket(tickets: DataFrame, path: str) -> None:
    tickets.write.mode("append").parquet(path)


def tickets(spark: SparkSession, path: str, schema: str, time: str = "created_at") -> DataFrame:
    """All tickets, the latest first; none where nothing was saved."""
    found = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return found.orderBy(F.desc(time))


def write_training_set(samples: DataFrame, path: str, label: str, split: str) -> DataFrame:
    """Samples as JSON lines and CSV below path; returns (and writes) their metadata: how many of each label and split."""
    samples.write.mode("overwrite").json(f"{path}/json")
    samples.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    samples.groupBy(label, split).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return samples.sparkSession.read.schema(f"{label} string, {split} string, n long").json(f"{path}/metadata")


def cached(texts: DataFrame, text: str, encode, path: str, kind: str) -> DataFrame:
    """texts with vector, each distinct text encoded once and kept by its hash. encode: Column -> Column of type kind.

    New vectors are appended by one write, which either is there as a whole or not at all.
    """
    spark, schema = texts.sparkSession, f"key string, vector {kind}"
    own = texts.withColumn("key", F.sha2(F.col(text), 256))
    new = own.select("key", text).dropDuplicates(["key"])
    if exists(spark, path):
        new = new.join(spark.read.schema(schema).parquet(path).select("key"), "key", "left_anti")
    new.select("key", encode(F.col(text)).cast(kind).alias("vector")).write.mode("append").parquet(path)
    return own.join(spark.read.schema(schema).parquet(path), "key", "left").drop("key")


def theme_dimension(themes: DataFrame) -> DataFrame:
    """The dimension of themes as a report reads it; a negative share up to 1 is a fraction."""
    share = F.coalesce("negative_share", F.lit(0.0)).cast("double")
    return themes.select(F.col("cluster_id").alias("Cluster_ID"), F.col("title").alias("Theme_Title"), F.coalesce("category", F.lit("General")).alias("Category"), F.coalesce("severity", F.lit("MEDIUM")).alias("Severity"), F.coalesce("review_count", F.lit(0)).alias("Review_Count"), F.round(F.when(share <= 1.0, share * 100).otherwise(share), 1).alias("Negative_Share_Pct"), F.round(F.coalesce("avg_rating", F.lit(0.0)), 2).alias("Avg_Rating"), F.array_join("keywords", "; ").alias("Top_Keywords"), F.coalesce("medoid_verbatim", F.lit("")).alias("Medoid_Sample"))


def connector(base_url: str, feed: str = "/api/reports/reviews.csv") -> str:
    """A data source file of a BI client that reads the fact table from the web."""
    return json.dumps({"version": "0.1", "connections": [{"details": {"url": base_url.rstrip("/") + feed}, "connectionType": "Web"}]})


def import_script(base_url: str, facts: DataFrame, feed: str = "/api/reports/reviews.csv") -> str:
    """A Power Query script that reads the fact table with the types of its columns."""
    kinds = {"string": "type text", "int": "Int64.Type", "bigint": "Int64.Type", "double": "type number", "boolean": "type logical", "timestamp": "type datetime", "date": "type date"}
    types = ", ".join(f'{{"{c}", {kinds.get(k, "type any")}}}' for c, k in facts.dtypes)
    url = base_url.rstrip("/") + feed
    return f'let Source = Csv.Document(Web.Contents("{url}"), [Delimiter = ",", Columns = {len(facts.columns)}, Encoding = 65001, QuoteStyle = QuoteStyle.Csv]), Headed = Table.PromoteHeaders(Source), Typed = Table.TransformColumnTypes(Headed, {{{types}}}) in Typed'


def measures() -> dict[str, str]:
    """The report measures over the fact table, as SQL expressions."""
    return {
        "net_sentiment": "round((count_if(Calibrated_Sentiment = 'POSITIVE') - count_if(Calibrated_Sentiment = 'NEGATIVE')) * 100D / greatest(count(*), 1), 2)",
        "defect_pct": "round(count_if(Complaint_Clauses > 0) * 100D / greatest(count(*), 1), 2)", "hidden_defects": "count_if(Has_Silent_Defect)", "actionable_pct": "round(count_if(Is_Actionable) * 100D / greatest(count(*), 1), 2)",
        "redacted_pct": "round(count_if(Is_PII_Scrubbed) * 100D / greatest(count(*), 1), 2)", "severe": "count_if(Complaint_Clauses > 0 AND Rating <= 2)",
    }
