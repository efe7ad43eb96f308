"""Streaming ingest and drift: an extension, as there is none in batch form. Duplicates are dropped within a watermark only."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import CRITICAL, MODERATE, pairs, psi
from tidemark.operators.quality_gate import normal, rejection


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).load(path)


def clean(stream: DataFrame, text: str, stamp: str, late: str = "1 hour") -> DataFrame:
    """Rows that pass the gate, one for each text within the time that rows may be late."""
    passed = stream.filter(rejection(normal(F.col(text))).isNull()).withColumn("__k", F.xxhash64(F.lower(F.trim(text))))
    return passed.withWatermark(stamp, late).dropDuplicatesWithinWatermark(["__k"]).drop("__k")


def windowed(stream: DataFrame, stamp: str, theme: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts of each window and theme. late: the watermark of a stream that has none yet; a cleaned one has."""
    own = stream.withWatermark(stamp, late) if late else stream
    return own.groupBy(F.window(stamp, width).alias("w"), theme).agg(F.count("*").alias("n")).select(F.col("w.start").alias("cohort"), theme, "n")


def cohorts_of(spark: SparkSession, path: str) -> list[str]:
    """The cohorts that have counts, in order, from the names of their folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(unquote(n.removeprefix("cohort=")) for n in names if n.startswith("cohort="))


def drift_sink(path: str, theme: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch in update mode: stores the counts (cohort, theme, n) of each batch by cohort, and the psi of the cohorts
    that it touches and of those after them against the cohort before.

    Only the folders of these cohorts are read. A batch that is run again writes the same psi and counts that don't exceed
    those before, of which the largest hold.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.select(F.col("cohort").cast("string").alias("cohort"), theme, "n").persist()
        try:
            touched = {r[0] for r in own.select("cohort").distinct().collect()}  # windows that are still open
            if not touched:
                return
            own.write.mode("append").partitionBy("cohort").parquet(f"{path}/counts")
            order = cohorts_of(spark, path)
            moved = touched | {b for a, b in zip(order, order[1:], strict=False) if a in touched}
            needed = moved | {a for a, b in zip(order, order[1:], strict=False) if b in moved}
            counts = spark.read.schema(f"{theme} string, n long, cohort string").parquet(f"{path}/counts").filter(F.col("cohort").isin(*needed)).groupBy("cohort", theme).agg(F.max("n").alias("n"))
            # a cohort whose own predecessor isn't read has none here, so its row isn't written
            drift_of(counts, theme).filter(F.col("cohort").isin(*(moved - {order[0]}))).write.mode("overwrite").parquet(f"{path}/psi/batch={batch_id}")
        finally:
            own.unpersist()

    return run


def read_drift(spark: SparkSession, path: str) -> DataFrame:
    """(cohort, psi, status) as the latest batch has them."""
    rows = spark.read.parquet(f"{path}/psi")
    return rows.groupBy("cohort").agg(F.max_by(F.struct("psi", "status"), "batch").alias("r")).select("cohort", "r.psi", "r.status")


def drift_of(counts: DataFrame, theme: str) -> DataFrame:
    moved = pairs(counts, "cohort", theme).filter("previous is not null").groupBy("cohort").agg(psi(F.col("kt"), F.col("nt"), F.col("kb"), F.col("nb")).alias("psi"))
    return moved.withColumn("status", F.when(F.col("psi") >= CRITICAL, "CRITICAL_DRIFT").when(F.col("psi") >= MODERATE, "MODERATE_DRIFT").otherwise("STABLE"))
