"""What the operators share: the shared folder, written intermediate tables, components of a graph."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = told.get() if told.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def importable(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver found it, and get batches of bounded bytes unless the session says how many."""
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


class Scratch:
    """Intermediate tables in a folder of their own below the shared one.

    A saved table is complete before it is read again, so a lost executor costs only the tasks that ran on it, and its
    files give later joins their true size. Tables that the returned frame doesn't read are to be dropped.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark, self.top, self.paths, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", {}, 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.top}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        schema, path = df.schema, self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _, path = self.paths.pop(id(df))
            self.delete(path)


ONE_TASK = 1 << 19


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges given, by union and find."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(scratch: Scratch, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, comp): the least node that each node of edges (a, b: long) reaches. Only nodes with an edge take part.

    Up to one_task edges, which are counted first, are joined up in one task. More are in rounds: each takes the least
    label of the neighbours and then that label's own label, so paths shorten by half, until no label changes.
    """
    own = scratch.save(edges.select("a", "b"), "edges")
    if own.count() <= one_task:
        labels = scratch.save(own.coalesce(1).mapInArrow(joined_up, "node long, comp long"), "labels")
        scratch.drop(own)
        return labels
    both = scratch.save(own.union(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    scratch.drop(own)
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumn("changed", F.lit(True)), "labels")
    while True:
        told = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        near = labels.join(told, "node").select("node", F.col("comp").alias("old"), F.least("comp", "seen").alias("mid"))
        far = labels.select(F.col("node").alias("mid"), F.col("comp").alias("end"))
        new = near.join(far, "mid").select("node", F.least("mid", "end").alias("comp"), (F.least("mid", "end") < F.col("old")).alias("changed"))
        new = scratch.save(new, "labels")
        scratch.drop(labels)
        labels = new
        if labels.filter("changed").isEmpty():
            scratch.drop(both)
            return labels.drop("changed")


HEAVY, WAYS = 4096, 64


def spread_join(many: DataFrame, few: DataFrame, key: str, count: str, spread: Column) -> DataFrame:
    """many joined with few by key, where few has each key once and count, the number of rows of many that have it.

    Keys that at least a HEAVYth of these rows have are at most HEAVY, whatever the data; they go to all tasks, and their
    rows are dealt WAYS ways by the hash of spread, each way with a copy of the key's row. The others are joined as they are.
    few is read twice.
    """
    total = few.agg((F.sum(count) / HEAVY).alias("__least"))
    heavy = few.select(key, count).crossJoin(F.broadcast(total)).filter(F.col(count) >= F.col("__least")).select(key, F.lit(True).alias("__heavy"))
    own = many.join(F.broadcast(heavy), key, "left").withColumn("__way", F.when(F.col("__heavy"), F.pmod(F.xxhash64(spread), F.lit(WAYS)).cast("int")).otherwise(0))
    ways = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    copies = few.join(F.broadcast(heavy), key, "left").select(*few.columns, F.explode(ways).alias("__way"))
    return own.join(copies, [key, "__way"]).drop("__way", "__heavy")


class Ranges:
    """Ranges of at most about so many rows of a long column, numbered from 0, for tables that have the column.

    There are as many as the session has shuffle partitions, or more where these would be too large, or fewer where they
    would be under least, by default a fiftieth of rows.

    Spark's range partitioner finds them in the column alone, so every range is bounded however many there are, but for
    rows of one value, which share a range. What is kept of them is their least value: a table of 16 bytes for each range.
    It is looked up in two steps of about the square root of their number: the first is a constant, the second a join, for
    which Spark sends the table to all tasks while it is small enough by its own threshold. Nulls are in range 0.
    """

    def __init__(self, scratch: Scratch, df: DataFrame, column: str, rows: int, least: int | None = None):
        count, partitions = df.count(), int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.column, self.n = column, max(1, -(-count // rows), min(partitions, -(-count // (least or max(1, rows // 50)))))
        ranged = df.select(column).repartitionByRange(self.n, column).select(F.spark_partition_id().alias("p"), column)
        step = int(self.n**0.5) + 1
        # the held number of partitions may be greater than the one asked for
        edges = ranged.filter(F.col(column).isNotNull()).groupBy("p").agg(F.min(column).alias("edge")).select(F.floor(F.col("p") / step).cast("int").alias("__g"), "p", "edge")
        self.edges = scratch.save(edges.groupBy("__g").agg(F.array_sort(F.collect_list(F.struct("edge", "p"))).alias("__edges")), "ranges")
        told = self.edges.select("__g", F.get("__edges", F.lit(0))["edge"].alias("edge"), F.get("__edges", F.size("__edges") - 1)["p"].alias("last")).orderBy("__g").collect()
        self.groups, self.starts, self.last = [r["__g"] for r in told], [r["edge"] for r in told], told[-1]["last"] if told else 0

    def add(self, df: DataFrame, part: str, head: str | None = None) -> DataFrame:
        """df with part, the number of the range of each row, and head, whether its value is the least of a range but the first. Numbers have no gaps where no value is null."""
        value = F.col(self.column)
        starts, known = (F.from_json(F.lit(json.dumps(x)), f"array<{kind}>") for x, kind in ((self.starts, "bigint"), (self.groups, "int")))
        group = F.get(known, F.greatest(F.size(F.filter(starts, lambda e: e <= value)), F.lit(1)) - 1) if self.starts else F.lit(0)
        joined = df.withColumn("__g", group).join(self.edges, "__g", "left")
        below = F.filter("__edges", lambda e: e["edge"] <= value)
        own = F.get(below, F.size(below) - 1)
        new = {part: F.coalesce(own["p"], F.lit(0))}
        if head:
            new[head] = F.coalesce((own["edge"] == value) & (own["p"] > 0), F.lit(False))
        return joined.withColumns(new).drop("__g", "__edges")
