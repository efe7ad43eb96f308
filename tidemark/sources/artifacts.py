"""Files that earlier runs left: bounded uploads, artifacts with their digests, zipped tables, the older upload format."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pii
from tidemark.functions.text import complaint_span
from tidemark.operators.quality_gate import weak_label

MOST_BYTES = 25 << 20
ASSIGNMENTS = "review_index long, cluster_id int, theme string"
#: Columns of the older format, by exact name and then by the longest name inside another.
LEGACY = {
    "text": ("review_text", "reviewtext", "review", "comment_text", "comment", "feedback_text", "feedback", "body", "content", "message", "text"),
    "rating": ("rating", "stars", "star_rating", "score", "overall"),
    "version": ("batch_or_version", "version", "release", "build", "batch", "date"),
    "product": ("product_name", "product", "sku", "item_name", "item", "name"),
}


def status_of(spark: SparkSession, path: str):
    """(file system, status) of a path; status is null where there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.getFileStatus(p) if fs.exists(p) else None


def exists(spark: SparkSession, path: str) -> bool:
    return status_of(spark, path)[1] is not None


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths where there is nothing."""
    return [p for p in paths if not exists(spark, p)]


def bounded(spark: SparkSession, path: str, most: int = MOST_BYTES) -> str:
    """path, if it is a file that isn't empty or larger than allowed; its bytes aren't read."""
    _, status = status_of(spark, path)
    if status is None or status.getLen() == 0:
        raise ValueError(f"{path} is empty")
    if status.getLen() > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return path


def digest(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file, read by one task."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def verified(spark: SparkSession, path: str, expected: str) -> str:
    """path, if its content has the digest that is expected: what is to be loaded is checked before."""
    if (found := digest(spark, path)) != expected.lower():
        raise ValueError(f"{path} has digest {found}")
    return path


def read_assignments(spark: SparkSession, path: str, schema: str = ASSIGNMENTS) -> DataFrame:
    """A table of cluster assignments or of representatives, with the columns of schema by name."""
    names = [x.split()[0] for x in schema.split(", ")]
    raw = spark.read.option("header", True).csv(path)
    kinds = dict(x.split() for x in schema.split(", "))
    return raw.select(*(F.col(n).try_cast(kinds[n]).alias(n) for n in names))


def read_zipped(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns, as strings, of all tables with a header in the zip files below path; a task reads one file, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.schema([(c, pa.string()) for c in columns])
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in sorted(n for n in archive.namelist() if n.endswith(".csv")):
                        with archive.open(name) as f:
                            options = pyarrow.csv.ConvertOptions(include_columns=columns, include_missing_columns=True, column_types=own, strings_can_be_null=True)
                            for part in pyarrow.csv.open_csv(f, parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True), convert_options=options):
                                yield part.cast(own) if part.schema != own else part

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))


def legacy_column(df: DataFrame, names: tuple[str, ...], text: bool = False) -> str | None:
    """The column of one of the names, else the one that holds the longest; text: only columns of strings."""
    low = {c.strip().lower(): c for c in df.columns}
    for n in names:
        if n in low:
            return low[n]
    kinds, best, score = dict(df.dtypes), None, 0
    for key, column in low.items():
        if text and kinds[column] != "string":
            continue
        rank = next((i for i, n in enumerate(names) if n in key), None)
        if rank is not None and (now := len(names[rank]) * 100 - rank) > score:
            best, score = column, now
    return best


def parse_legacy(df: DataFrame, index: str = "row_index") -> DataFrame:
    """Records of an upload in the older way: ids by position, ratings that aren't 1 to 5 are 3, redacted text and span."""
    rest = df.drop(index)
    found = {k: legacy_column(rest, names, k == "text") for k, names in LEGACY.items()}
    if not found["text"]:
        raise ValueError("no column looks like review text")
    or_else = lambda k, other: F.coalesce(F.col(found[k]).cast("string"), F.lit(other)) if found[k] else F.lit(other)
    value: Column = F.col(found["rating"]).cast("string").try_cast("double").cast("int") if found["rating"] else F.lit(None).cast("int")
    raw = F.col(found["text"]).cast("string")
    kept = df.filter((F.trim(raw) != "") & (F.lower(raw) != "nan"))
    own = kept.select(
        F.format_string("REV-USER-%05d", F.col(index) + 1).alias("id"), or_else("product", "Custom Item").alias("product_name"), F.lit("General").alias("sku_or_module"), or_else("version", "Batch-Custom").alias("batch_or_version"), F.lit("Upload CSV").alias("channel"),
        F.when(value.between(1, 5), value).otherwise(3).alias("rating"), raw.alias("redacted_text"),
    )
    own = pii.redact(own, "redacted_text", entities="pii_detected")
    return own.withColumns({"ground_truth_label": weak_label(F.col("rating")), "highlight_span": complaint_span(F.col("redacted_text"))})
