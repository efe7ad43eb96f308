"""WARC archives, and finding their records by boundary-chain verification.

Writing is a plain projection: a record is its header, an HTTP response and two line ends, which are the line separator of
Spark's text writer. Of equal payloads from a size on, one is written and the others are revisit records that name it.

Reading splits archives wherever Spark splits files. Tasks cut their bytes at every line that begins with the version
magic, also inside payloads, and tell for each such candidate where it starts, where its content length says the next
record starts, and what it holds. What is a record is settled afterwards, on these offsets alone: a candidate is one if the
chain of successors from the start of its file reaches it. The chain is followed by pointer jumping, first inside segments
of fixed size, where each candidate learns at which offset its chain leaves the segment, then over segments, the jumps
doubling each round. Records that the cut at a false magic left in pieces are put together from a second read of those pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha1

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, importable

EOL, MAGIC = "\r\n", "WARC/1."
CUT = EOL + MAGIC
SEGMENT = 64 << 20
NIL = "00000000-0000-0000-0000-000000000000"


def urn(page_id: Column) -> Column:
    """A record id that holds a page id: its 16 hexadecimal digits around the version and variant of a UUID; null: the nil UUID."""
    h = F.lower(F.lpad(F.hex(page_id.cast("long")), 16, "0"))
    own = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 13, 3), F.lit("-8"), F.substring(h, 16, 1), F.lit("00-" + "0" * 12))
    return F.concat(F.lit("<urn:uuid:"), F.coalesce(own, F.lit(NIL)), F.lit(">"))


def page_of(record_id: str | None) -> int | None:
    """The page id in a record id of this module, else null."""
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-8(\w{3})-8(\w)00-0{12}>", record_id or "")
    return int.from_bytes(bytes.fromhex("".join(m.groups())), "big", signed=True) if m else None


def write_warc(pages: DataFrame, path: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", compression: str | None = None) -> None:
    """A record for each row of pages (page_id, url, html) in archives below path.

    The payload is html in UTF-8, empty if null. Among equal payloads of at least so many bytes, the rows with the largest
    page_id are responses and the others revisits of it; a row without page_id has the nil record id and is no response of
    others unless all are without. A null url is left out; characters in it that would end a header line are escaped. Other
    columns aren't written. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    several = own.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("master"), F.count("*").alias("n")).filter("n > 1").select("digest", "master")
    told = own.join(scratch.save(several, "several"), "digest", "left")
    again = F.col("master").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("master"))
    safe = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL), F.when(again, "").otherwise(F.col("html")))
    block = told.withColumns({"again": again, "http": http})
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit(f"{EOL}WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"{EOL}WARC-Date: {date}"), F.coalesce(F.concat(F.lit(f"{EOL}WARC-Target-URI: "), safe), F.lit("")),
        F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(F.col("again"), F.concat(F.lit(f"{EOL}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{EOL}WARC-Refers-To: "), urn(F.col("master")))).otherwise(""),
        F.lit(f"{EOL}Content-Type: application/http;msgtype=response{EOL}Content-Length: "), F.octet_length("http").cast("string"), F.lit(EOL + EOL), F.col("http"),
    )
    writer = block.select(head.alias("value")).write.option("lineSep", EOL + EOL)
    (writer.option("compression", compression) if compression else writer).text(path)
    scratch.delete(scratch.top)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): the bytes between two magics, in the order of each block of a file."""
    rows = spark.read.option("lineSep", CUT).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


class Record:
    """The header of a record, and its payload as far as the bytes go. value begins at the minor version."""

    def __init__(self, value: bytes):
        head, mark, rest = value.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        size = self.fields.get("content-length", "")
        self.valid = bool(mark) and re.fullmatch(rb"[01]", lines[0]) is not None and size.isascii() and size.isdigit() and len(size) < 19
        if self.valid:
            self.span = len(MAGIC) + len(head) + 4 + int(size) + 4
            self.complete = len(rest) >= int(size)
            block = rest[: int(size)]
            http = self.fields.get("content-type", "").startswith("application/http")
            status, found, body = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
            self.payload = body if found or not http else block
            said = re.search(rb"(?im)^content-length: *(\d+)", status)
            self.said = int(said[1]) if said else None

    def row(self) -> dict:
        f, revisit = self.fields, self.fields.get("warc-type") == "revisit"
        told = f.get("warc-payload-digest", "").removeprefix("sha1:").lower()
        return {
            "record_type": f.get("warc-type"), "page_id": page_of(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "refers_to": page_of(f.get("warc-refers-to")), "told": told,
            "payload_digest": told if revisit else sha1(self.payload).hexdigest(), "payload_bytes": self.said if revisit else len(self.payload),
        }


FIELDS = {"record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "refers_to": pa.int64(), "told": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
PARSED = "record_type string, page_id long, url string, refers_to long, told string, payload_digest string, payload_bytes long"


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, place in block, start relative to the block's first piece, bytes) of each piece."""
    here, place, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, block) != here:
                here, place, at = (file, block), 0, 0
            value = value.as_py()
            yield file, block, place, at, value
            place, at = place + 1, at + len(value) + len(CUT)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece: where it is, the span to its successor if it reads as a record, and what it holds if it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            names = {"file": pa.string(), "block": pa.int64(), "place": pa.int64(), "start": pa.int64(), "size": pa.int64(), "span": pa.int64(), "complete": pa.bool_(), **FIELDS}
            return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in names.items()], names=list(names))

        rows = []
        for file, block, place, start, value in numbered(batches):
            row = {"file": file, "block": block, "place": place, "start": start, "size": len(value)}
            head = block == 0 and place == 0
            if not head or value.startswith(MAGIC.encode()):
                record = Record(value[len(MAGIC) :] if head else value)
                if record.valid:
                    row |= {"span": record.span, "complete": record.complete, **(record.row() if record.complete else {})}
            rows.append(row)
            if len(rows) == 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return pieces(spark, path).mapInArrow(run, f"file string, block long, place long, start long, size long, span long, complete boolean, {PARSED}")


def located(rows: DataFrame) -> DataFrame:
    """rows of candidates with their offset in the file: what all earlier blocks hold, and what comes before in their own."""
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(CUT)).alias("held"))
    base = blocks.select("file", "block", (F.sum("held").over(W.partitionBy("file").orderBy("block")) - F.col("held")).alias("base"))
    first = (F.col("block") == 0) & (F.col("place") == 0)
    return rows.join(base, ["file", "block"]).withColumn("offset", F.when(first, 0).otherwise(F.col("base") + F.col("start") - len(MAGIC))).drop("base")


def leaps(offset: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted candidates of a segment: the place of each one's successor (their number, if it isn't among them), and the successor's offset."""
    to = offset + span
    at = np.searchsorted(offset, to)
    found = np.zeros(len(at), bool)
    inside = at < len(offset)
    found[inside] = offset[at[inside]] == to[inside]
    return np.where(found, at, len(offset)), to


def exits(table: pa.Table) -> pa.Table:
    """Where the chain of each candidate leaves its segment."""
    table = table.sort_by("offset")
    offset, span = table.column("offset").to_numpy(), table.column("span").to_numpy()
    step, to = leaps(offset, span)
    n = len(offset)
    jump = np.append(np.where(step < n, step, np.arange(n)), n)
    for _ in range(n.bit_length()):
        jump = jump[jump]
    return pa.table({"file": table.column("file"), "offset": table.column("offset"), "to": pa.array(to[jump[:n]], pa.int64())})


def reached(table: pa.Table) -> pa.Table:
    """The candidates of a segment that the chain from its entries reaches."""
    table = table.sort_by("offset")
    offset, span = table.column("offset").to_numpy(), table.column("span").to_numpy()
    step, _ = leaps(offset, span)
    n = len(offset)
    jump = np.append(step, n)
    hit = np.append(table.column("entry").to_numpy(zero_copy_only=False), False)
    for _ in range(n.bit_length()):
        hit[jump[np.flatnonzero(hit)]] = True
        jump = jump[jump]
    return table.filter(pa.array(hit[:n]))


def records(scratch: Scratch, rows: DataFrame, segment: int) -> DataFrame:
    """The rows with span that the chain from the start of their file reaches."""
    own = rows.filter("span is not null").withColumn("segment", (F.col("offset") / segment).cast("long"))
    far = own.agg(F.max("segment")).first()[0] or 0
    reach = own.filter("offset = 0").select("file", "offset")
    if far:
        light = own.select("file", "segment", "offset", "span")
        jump = scratch.save(light.groupBy("file", "segment").applyInArrow(exits, "file string, offset long, to long"), "jumps")
        for _ in range(int(far).bit_length()):
            reach = scratch.save(reach.union(reach.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset"))).distinct(), "reach")
            jump = scratch.save(jump.join(jump.select("file", F.col("offset").alias("to"), F.col("to").alias("next")), ["file", "to"]).select("file", "offset", F.col("next").alias("to")), "jumps")
    marked = own.join(reach.withColumn("entry", F.lit(True)), ["file", "offset"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return marked.groupBy("file", "segment").applyInArrow(reached, marked.schema)


def pieced(spark: SparkSession, path: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, offset, payload, parsed columns) of wanted records, put together from the pieces up to their successors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for piece in numbered(batches):
            kept.append((*piece[:3], piece[4]))
            if len(kept) == 500:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept]) for i in range(4)], names=["file", "block", "place", "value"])
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept]) for i in range(4)], names=["file", "block", "place", "value"])

    starts = wanted.select("file", "offset", "span", F.lit(True).alias("start"))
    owner = F.last(F.when(F.col("start"), F.struct("offset", "span")), ignorenulls=True).over(W.partitionBy("file").orderBy("offset"))
    owned = rows.select("file", "block", "place", "offset").join(starts, ["file", "offset"], "left").withColumn("owner", owner)
    owned = owned.filter(F.col("offset") < F.col("owner.offset") + F.col("owner.span")).select("file", "block", "place", "offset", F.col("owner.offset").alias("home"))
    values = pieces(spark, path).mapInArrow(run, "file string, block long, place long, value binary")
    whole = values.join(owned, ["file", "block", "place"]).groupBy("file", "home").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]).alias("values"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Record(CUT.encode().join(v).removeprefix(MAGIC.encode())) for v in batch.column(2).to_pylist()]
            parsed = [r.row() for r in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.payload for r in found], pa.binary()), *(pa.array([p[k] for p in parsed], t) for k, t in FIELDS.items())], names=["file", "offset", "payload", *FIELDS])

    return whole.select("file", "home", "values").mapInArrow(join, f"file string, offset long, payload binary, {PARSED}")


def read_warc(spark: SparkSession, path: str, payloads: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(file, offset, record_type, page_id, url, refers_to, told, payload_digest, payload_bytes[, payload]) of every record below path.

    page_id and refers_to are read from record ids that write_warc made, else null. payload_digest is the SHA-1 of what was
    read, for a revisit the one it tells (told); payload_bytes of a revisit is its HTTP content length, null if it has none.
    Bytes that no chain reaches, as after a truncated record, give no records. Plain and gzip archives are read.
    """
    importable(spark)
    scratch = Scratch(spark, "warc-read")
    rows = scratch.save(located(scratch.save(candidates(spark, path), "candidates")), "located")
    own = scratch.save(records(scratch, rows, segment), "records")
    names = ["file", "offset", *FIELDS]
    if payloads:
        return pieced(spark, path, rows, own).select(*names, "payload")
    parts = own.filter("not complete")
    if parts.isEmpty():
        return own.select(*names)
    return own.filter("complete").select(*names).union(pieced(spark, path, rows, parts).select(*names))
