"""Reading uploads of any of the supported formats, with the sniffing done on a bounded head of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.artifacts import bounded

HEAD = 4096
ENVELOPES = ("reviews", "data", "items", "records", "feedback", "results")
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1", "cp1252")


def head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file, or of the first one of a folder, read by Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(f.getPath()) for f in fs.listStatus(p) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")
        if not files:
            return b""
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def encoding_of(data: bytes) -> str:
    """The first encoding of the ladder that reads the head; a character cut at its end doesn't count against UTF-8."""
    for name in ENCODINGS:
        try:
            data[: len(data) - 3 if len(data) == HEAD else None].decode(name)
        except UnicodeDecodeError as e:
            if name.startswith("utf") and len(data) == HEAD and e.start >= len(data) - 8:
                return name
            continue
        return name
    return "utf-8"


def delimiter_of(text: str) -> str:
    """Tab, semicolon or bar where they outnumber the commas, else the comma."""
    return max(("\t", ";", "|"), key=text.count) if max(map(text.count, "\t;|")) > text.count(",") else ","


def indexed(df: DataFrame) -> DataFrame:
    """df with row_index in file order: places within partitions, after what the partitions before hold (one row each is sorted)."""
    own = df.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    counts = own.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    base = counts.select("__p", "__first", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__base"))
    return own.join(F.broadcast(base), "__p").withColumn("row_index", F.col("__base") + F.col("__i") - F.col("__first")).drop("__p", "__i", "__first", "__base")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text. Files are split among tasks unless the head shows line ends inside quotes."""
    data = head(spark, path)
    encoding = encoding_of(data)
    quoted = any(line.count(b'"') % 2 for line in data[: data.rfind(b"\n") + 1].split(b"\n"))
    reader = spark.read.option("header", True).option("multiLine", quoted).option("escape", '"').option("sep", delimiter_of(data.decode(encoding, "replace"))).option("encoding", {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}[encoding])
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """JSON lines, an array, an object with its rows under a known name, or a single object."""
    start = head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n")
    if lines or (lines is None and start[:1] == b"{" and b"}\n{" in start.replace(b"\r", b"")):
        return spark.read.json(path)
    df = spark.read.option("multiLine", True).json(path)
    for name in ENVELOPES:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            rows = df.select(F.explode(name).alias("r"))
            return rows.select("r.*") if isinstance(rows.schema["r"].dataType, T.StructType) else rows
    return df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ValueError("reading Excel files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(bounded(spark, path), dtype=str))  # the driver holds at most so many bytes of it


def read_any(spark: SparkSession, source: str | DataFrame) -> tuple[DataFrame, str]:
    """(frame, format) by extension; what isn't as its name says is read as delimited text; a frame is taken as it is."""
    if isinstance(source, DataFrame):
        return source, "dataframe"
    ending = source.lower().rpartition(".")[2]
    if ending == "parquet":
        return spark.read.parquet(source), "parquet"
    if ending in ("xlsx", "xls"):
        if head(spark, source, 8)[:2] in (b"PK", b"\xd0\xcf"):  # else it only has the name of one
            return read_excel(spark, source), "excel"
    elif ending in ("json", "jsonl", "ndjson"):
        lines = True if ending != "json" else None
        df = read_json(spark, source, lines)
        if "_corrupt_record" not in df.columns:
            return df, "json" if lines is None else "jsonl"
    return read_csv(spark, source), "tsv" if ending == "tsv" else "csv"


def required(df: DataFrame, names: tuple[str, ...], text: str) -> DataFrame:
    """df without blank texts; missing columns are an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.filter(F.col(text).isNotNull() & (F.trim(text) != ""))


def guarded(df: DataFrame, label: str | None = None, least: int = 20, most: int = 50_000, classes: int = 2) -> DataFrame:
    """df if its rows and label classes are within limits, counted over at most one row more than allowed."""
    n = df.limit(most + 1).count()
    if not least <= n <= most:
        raise ValueError(f"{'more than ' if n > most else ''}{min(n, most)} rows; {least} to {most} are allowed")
    if label and df.select(F.count_distinct(label)).first()[0] < classes:
        raise ValueError(f"fewer than {classes} classes")
    return df
