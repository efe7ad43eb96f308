"""Token ids in a content-addressed store.

The id stream of each document, its end id included, is cut where a rolling hash of the last 32 ids has eight leading zero
bits, so equal passages give equal chunks wherever they stand. A chunk is named by the first 16 bytes of the SHA-256 of its
ids, little-endian in 2 bytes (4, if the vocabulary needs it), and every different chunk is stored once:

  data           a row for each document, in ascending id order: its recipe (the names and lengths of its chunks), its Merkle
                 root, and inline the bytes of the chunks that occur once; and a row for each chunk that occurs several times,
                 with its name, its bytes and how often it does
  manifest       a row for each pack: how many documents and ids it has, and the Merkle root over its documents' roots

Lists of names and of lengths are kept as one binary value each. Packs are ranges of ids of about as many documents each. Reading names every chunk again from its bytes, builds the roots
of documents and packs from those names, and fails where one differs. A document's start is the number of ids in the packs
before its own and, within its pack, in the documents before it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.bpe import byte_letters, lowers
from tidemark.llm.common import Ranges, Scratch, importable, spread_join
from tidemark.llm.words import Words, even, groups, pieces

WINDOW, LEADING, LEAST, MOST = 5, 8, 64, 4096  # a window of 2**5 ids; least and most ids of a chunk
NAME = 16  # bytes of a name
GEAR = np.random.default_rng(11).integers(0, 2**32, 2**16, dtype=np.uint64).astype(np.uint32)


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of a stream of ids."""
    h = GEAR[ids & 0xFFFF] ^ (ids >> 16).astype(np.uint32)
    for k in range(WINDOW):
        n = 1 << k
        if len(h) > n:
            h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    ends, last = [], 0
    for end in (*(np.flatnonzero(h >> np.uint32(32 - LEADING) == 0) + 1).tolist(), len(ids)):
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or (end == len(ids) and end > last):
            ends.append(end)
            last = end
    return ends


def merkle(names: list[bytes]) -> bytes:
    """The root of a binary tree of SHA-256 whose leaves are names; of one name, its hash; an odd one goes up as it is."""
    level = names if len(names) > 1 else [sha256(b"\0" + b"".join(names)).digest()]
    while len(level) > 1:
        level = [sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the runs of ids that end at these places."""
    places = np.concatenate([[0], ends]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])


LETTERS = dict(enumerate(byte_letters()))


class Library:
    """Ids of texts by the tokenizers library, which is asked once for each word that is remembered.

    New words of small Latin letters, which are one pre-token each, go to its model; others go to it side by side with a
    special token between them, which it takes out before anything else, so each is encoded by itself; if one holds that
    token they are asked for one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; threads of the library would only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [x for x in self.tokenizer.get_added_tokens_decoder().items() if x[1].special and not x[1].normalized]
        self.between, self.mark = (special[0][0], special[0][1].content) if special else (None, "")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = Words(self.learn, self.kind, lowers(path))

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, words: pa.Array) -> pa.Array:
        small = pc.and_(even(words), pc.and_(pc.match_substring_regex(words, r"^\pL+$"), pc.equal(pc.utf8_lower(words), words))) if self.words.lower else pa.repeat(False, len(words))
        if not pc.any(small).as_py():
            return self.others(words)
        own, encode = words.filter(small).to_pylist(), self.tokenizer.model.tokenize
        found = [[t.id for t in encode(x if x.isascii() else x.encode().decode("latin-1").translate(LETTERS))] for x in own]
        ids = pa.concat_arrays([packed(np.fromiter(chain.from_iterable(found), self.kind), np.cumsum(list(map(len, found)))), self.others(words.filter(pc.invert(small)))])
        place = small.to_numpy(zero_copy_only=False)
        return ids.take(pa.array(np.where(place, np.cumsum(place) - 1, len(own) + np.cumsum(~place) - 1)))

    def others(self, words: pa.Array) -> pa.Array:
        if not len(words):
            return pa.array([], pa.binary())
        if not self.mark or pc.any(pc.match_substring(words, self.mark)).as_py():
            return pa.array([self.ids(w).tobytes() for w in words.to_pylist()], pa.binary())
        ids = self.ids(self.mark.join(words.to_pylist()))
        ends = np.append(np.flatnonzero(ids == self.between), len(ids))
        return packed(ids[ids != self.between], ends - np.arange(len(ends)))

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text in bytes."""
        out: list[bytes] = []
        for at, n in groups(texts):
            if n == 1:
                out.append(b"".join(self.words(pa.array([x]))[0].tobytes() for x in pieces(texts[at].as_py() or "")))
            else:
                ids, ends = self.words(texts.slice(at, n))
                data, w = memoryview(ids.tobytes()), self.kind.itemsize
                out += [bytes(data[a * w : b * w]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out


LOADED: dict[str, Library] = {}


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, packed, sizes, names): each document's ids, compressed, and its chunks' numbers of ids and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in LOADED:
            LOADED[path] = Library(path)
        library = LOADED[path]
        w, end, press = library.kind.itemsize, np.array([end_id], library.kind).tobytes(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at, n in groups(batch.column(1)):
                packed, sizes, names = [], [], []
                for x in library(batch.column(1).slice(at, n)):
                    data = x + end
                    ends = cut(np.frombuffer(data, library.kind).astype(np.int64))
                    sizes.append(np.diff(ends, prepend=0).astype("<i4").tobytes())
                    names.append(b"".join([sha256(data[a * w : b * w]).digest()[:NAME] for a, b in zip([0, *ends[:-1]], ends, strict=True)]))
                    packed.append(press.compress(data))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(x, pa.binary()) for x in (packed, sizes, names))], names=["doc_id", "packed", "sizes", "names"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return chosen.mapInArrow(run, "doc_id long, packed binary, sizes binary, names binary")


def each(names: Column) -> Column:
    """The names in a binary value, an array."""
    n = (F.octet_length(names) / NAME).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(names, i * NAME + 1, F.lit(NAME)))).otherwise(F.array().cast("array<binary>"))


STORED = "pack int, place int, doc_id long, n_tokens long, sizes binary, names binary, common binary, root binary, name binary, data binary"
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6]


def write_store(docs: DataFrame, path: str, top: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", rows: int = 50_000) -> None:
    """The store of docs below the folder top, which must be shared and new.

    Null and empty texts have the end id alone. Documents of one id, or of none (which come first), follow each other by
    their bytes. Other columns aren't stored. rows: at most about so many documents make a pack.
    """
    scratch = Scratch(docs.sparkSession, "token-store")
    ranges = Ranges(scratch, docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", rows)
    staged = scratch.save(encoded(docs, path, end_id, id_col, text_col), "staged")
    chunk = staged.select("doc_id", F.explode(each(F.col("names"))).alias("name"))
    often = scratch.save(chunk.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "often")
    common = spread_join(chunk, often, "name", "n", F.col("doc_id")).select("doc_id", F.struct("name", F.col("doc_id").eqNullSafe(F.col("first")).alias("own"), "n").alias("c"))
    common = common.groupBy("doc_id").agg(F.collect_set("c").alias("common"))
    none = F.lit(None).cast("binary")
    told = common.select("doc_id", none.alias("packed"), none.alias("sizes"), none.alias("names"), "common")
    both = told.union(staged.withColumn("common", F.lit(None).cast(told.schema["common"].dataType)))
    # the rows that tell a document's common chunks sort before its own
    dealt = ranges.add(both, "pack").repartitionById(ranges.last + 1, "pack").sortWithinPartitions("pack", "doc_id", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks that a document is the first to hold go out as rows, other common ones not at all."""
        doc, shared, owned, here, place, open_ = object(), set(), {}, None, 0, zstandard.ZstdDecompressor()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                out = []
                for d, packed, sizes, names, told, pack in zip(*(c.to_pylist() for c in whole.slice(at, 500).columns), strict=True):
                    if d != doc:
                        doc, shared, owned = d, set(), {}
                    if packed is None:
                        shared = {c["name"] for c in told}
                        owned = {c["name"]: c["n"] for c in told if c["own"]}
                        continue
                    here, place = pack, place + 1 if pack == here else 0
                    data, ends = open_.decompress(packed), np.frombuffer(sizes, "<i4").cumsum()
                    parts = [names[i : i + NAME] for i in range(0, len(names), NAME)]
                    n, inline, held = int(ends[-1]), data, b""
                    if shared:
                        width, inline = len(data) // n, []
                        for a, b, name in zip([0, *(ends[:-1] * width).tolist()], (ends * width).tolist(), parts, strict=True):
                            if name not in shared:
                                inline.append(data[a:b])
                            elif name in owned:
                                out.append((pack, None, None, owned.pop(name), None, None, None, None, name, data[a:b]))
                        inline, held = b"".join(inline), b"".join(sorted(shared.intersection(parts)))
                    out.append((pack, place, d, n, sizes, names, held, merkle(parts), None, inline))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(KINDS)], names=[x.split()[0] for x in STORED.split(", ")])

    dealt.select("doc_id", "packed", "sizes", "names", "common", "pack").mapInArrow(run, STORED).write.option("compression", "zstd").parquet(f"{top}/data")
    scratch.delete(scratch.top)
    packs(docs.sparkSession.read.schema(STORED).parquet(f"{top}/data").filter("place is not null")).write.parquet(f"{top}/manifest")


def packs(rows: DataFrame) -> DataFrame:
    """(pack, docs, ids, packroot) of rows with pack, place, n_tokens and root."""
    roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.hex("root").alias("r")))), lambda x: x["r"]), "")
    return rows.groupBy("pack").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids"), F.sha2(roots, 256).alias("packroot"))


def pairs_of(lists: pa.ListArray) -> Iterator[dict[bytes, bytes]]:
    """Each list of structs (name, part) as a mapping; null: empty."""
    for i in range(len(lists)):
        own = lists[i].values
        yield {} if own is None else dict(zip(own.field(0).to_pylist(), own.field(1).to_pylist(), strict=True))


def read_store(spark, top: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the store below top, every document put together from its chunks.

    A chunk that differs from its name, or a document or pack from its root, fails the read. An empty store gives no rows.
    """
    importable(spark)
    data = spark.read.schema(STORED).parquet(f"{top}/data")
    docs = data.filter("place is not null").drop("name")
    shared = data.filter("place is null").select("name", F.col("n_tokens").alias("n"), F.col("data").alias("part"))
    scratch = Scratch(spark, "token-read")
    wanted = docs.filter(F.octet_length("common") > 0).select("pack", "place", F.explode(each(F.col("common"))).alias("name"))
    fetched = spread_join(wanted, shared, "name", "n", F.concat_ws("/", "pack", "place")).groupBy("pack", "place").agg(F.collect_list(F.struct("name", "part")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                crcs, found, streams = [], [], []
                for n, sizes, names, root, inline, have in zip(*(c.to_pylist() for c in batch.columns[3:8]), pairs_of(batch.column(8)), strict=True):
                    sizes, parts, i = np.frombuffer(sizes, "<i4").tolist(), [names[i : i + NAME] for i in range(0, len(names), NAME)], 0
                    own = sum(k for k, x in zip(sizes, parts, strict=True) if x not in have) if have else n
                    width = len(inline) // own if own else len(have[parts[0]]) // sizes[0]
                    stream = []
                    for k, name in zip(sizes, parts, strict=True):
                        if (part := have.get(name)) is None:
                            part = inline[i : i + k * width]
                            i += k * width
                        if sha256(part).digest()[:NAME] != name:
                            raise ValueError("a chunk differs from its name, and so the document differs from its root")
                        stream.append(part)
                    now, stream = merkle(parts), np.frombuffer(b"".join(stream), f"<u{width}").astype("<u4")
                    if now != root or len(stream) != n:
                        raise ValueError("a document differs from its root")
                    found.append(now)
                    crcs.append(crc32(stream.tobytes()))
                    streams.append(stream.astype(np.int32) if ids else None)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary()), pa.array(crcs, pa.int64()), pa.array(streams, pa.list_(pa.int32()))], names=["pack", "place", "doc_id", "n_tokens", "root", "ids_crc32", "ids"])

    names = ["pack", "place", "doc_id", "n_tokens", "sizes", "names", "root", "data", "parts"]
    inline = docs.filter(F.octet_length("common") == 0).withColumn("parts", F.lit(None).cast(fetched.schema["parts"].dataType))
    whole = inline.select(*names).union(docs.filter(F.octet_length("common") > 0).join(fetched, ["pack", "place"], "left").select(*names))
    rows = scratch.save(whole.mapInArrow(run, "pack int, place int, doc_id long, n_tokens long, root binary, ids_crc32 long, ids array<int>"), "rows")
    manifest = spark.read.parquet(f"{top}/manifest")
    now = packs(rows).select("pack", F.col("packroot").alias("seen"))
    before = F.sum("ids").over(W.orderBy("pack")) - F.col("ids")
    base = manifest.join(now, "pack", "left").select("pack", F.when(F.coalesce(F.col("seen") == F.col("packroot"), F.lit(False)), before).otherwise(F.raise_error(F.lit("a pack differs from its root"))).alias("base"))
    start = F.sum("n_tokens").over(W.partitionBy("pack").orderBy("place")) - F.col("n_tokens") + F.col("base")
    out = rows.join(base, "pack").withColumn("start", start)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)
