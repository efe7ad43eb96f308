"""Near-duplicate documents by a signature-coordinate inverted join.

1. Each document's distinct word shingles give a MinHash signature of k coordinates, and a digest of the whole set.
   Documents of equal digests (128 bits) are one class; only one member stands for it from here on.
2. Every (coordinate, value) pair has a posting list. A link of the wished likeness agrees in at least m of k coordinates
   (for the defaults, one in 10^5 links of exactly 0.75 doesn't, and none of 0.85 or more in 10^11). So a class with fewer
   than m values that any other class has is done. The others order their values from the rarest list to the most
   frequent and post only the first k - m + 1 of them (the prefix): two classes that agree in m values meet in it. The
   m - 1 most frequent values of each class, where passages that many documents share end up, are skipped.
3. Every list links its members to one of them, the pivot. Collisions of such a pair are counted over all coordinates: in the
   posted lists both were met, and the skipped ones are looked up in the other's signature instead of being merged. Pairs of
   m collisions are confirmed on the full shingle sets, and the links give components. Lists whose members are in one component need nothing more; the others
   get another pivot among the members outside the largest component, a few times. So a group of n copies costs some n pairs, not n squared.
4. What shares lists and is still apart forms neighbourhoods. Their members outside the neighbourhood's largest component
   are compared with all its members, in blocks of bounded size: an inverted index of a block's full shingle sets counts
   one member's intersections with all of the block at once, and only links leave the block. No link between components
   is lost, then, and no pair of one is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import Scratch, components

STEP = np.uint64(0x9E3779B97F4A7C15)
LEFT, RIGHT = 128, 512  # members on either side of a block of comparisons


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's words; A to Z lower-cased, words parted by ASCII space."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(w))
    acc = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        acc = acc * STEP + w[i : len(w) - n + 1 + i]
    return np.unique(mixed(acc))


def set_digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def signer(k: int, seed: int = 7):
    odd = np.random.default_rng(seed).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(s: np.ndarray) -> np.ndarray:
        """The top 32 bits of the least product with each of k odd numbers, modulo 2**64."""
        low = np.full(k, 2**64 - 1, np.uint64)
        for at in range(0, len(s), 2048):
            low = np.minimum(low, (odd[:, None] * s[None, at : at + 2048]).min(axis=1))
        return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)

    return sign


def sign_documents(docs: DataFrame, id_col: str, text_col: str, width: int, k: int, digest: bool = False) -> DataFrame:
    """(id, n_shingles, own, sig) and with digest text_hash: own is the digest of the shingle set, null for an empty one."""
    more = [F.xxhash64(text_col).alias("text_hash")] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer(k)
        for batch in batches:
            n, own, sig = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                own.append(set_digest(s))
                sig.append(sign(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(sig, pa.binary()), *batch.columns[2:]], names=["id", "n_shingles", "own", "sig", *batch.schema.names[2:]])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), *more).mapInArrow(run, "id long, n_shingles long, own binary, sig binary" + ", text_hash long" * digest)


def coordinates(classes: DataFrame, k: int) -> DataFrame:
    """(cls, at, value): a row for each coordinate of a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), k)), pa.array(np.tile(np.arange(k, dtype=np.int32), batch.num_rows)), pa.array(sig)], names=["cls", "at", "value"])

    return classes.select("cls", "sig").mapInArrow(run, "cls long, at int, value int")


def prefixes(postings: DataFrame, m: int) -> DataFrame:
    """(at, value, cls): the rarest values of each class, as many as two classes with m common values need to meet."""
    often = postings.groupBy("at", "value").agg(F.count("*").alias("freq")).filter("freq > 1")
    own = W.partitionBy("cls")
    shared = postings.join(often, ["at", "value"]).withColumns({"c": F.count("*").over(own), "r": F.row_number().over(own.orderBy("freq", "at", "value"))})
    return shared.filter((F.col("c") >= m) & (F.col("r") <= F.col("c") - m + 1)).select("at", "value", "cls")


def agreeing(pairs: DataFrame, classes: DataFrame, m: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in m coordinates at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.int32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= m))

    a, b = (classes.select(F.col("cls").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union. texts: (cls, text) of each class in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, left = a, shingles(x.as_py(), width)
                right = shingles(y.as_py(), width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    a, b = (texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def named(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """lists with each member's component, without the lists whose members are all in one."""
    own = lists.join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    open_ = own.groupBy("at", "value").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return own.join(open_, ["at", "value"])


def star(open_: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of a pivot of each list, outside the list's highest component, and its members in other components."""
    order = F.when(F.col("comp") < F.col("hi"), F.xxhash64(F.lit(salt), "cls"))
    pivot = open_.groupBy("at", "value").agg(F.min(order).alias("order"))
    hit = open_.filter("comp < hi").select("at", "value", F.xxhash64(F.lit(salt), "cls").alias("order"), F.col("cls").alias("pivot"), F.col("comp").alias("home"))
    pairs = open_.join(pivot.join(hit, ["at", "value", "order"]), ["at", "value"]).filter("comp != home")
    return pairs.select(F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b")).distinct()


def neighbourhoods(scratch: Scratch, open_: DataFrame) -> DataFrame:
    """(cls, comp, g, outer, left, right): members of each neighbourhood g, whether outside its largest component, and how many blocks they make."""
    near = open_.select(F.col("lo").alias("a"), F.col("comp").alias("b")).filter("a < b").distinct()
    groups = components(scratch, near).select(F.col("node").alias("comp"), F.col("comp").alias("g"))
    members = open_.select("cls", "comp").distinct().join(groups, "comp")
    size = members.groupBy("g", "comp").agg(F.count("*").alias("n"))
    whole = size.groupBy("g").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max(F.struct("n", "comp")).alias("m")).select("g", "all", (F.col("all") - F.col("most")).alias("rest"), F.col("m.comp").alias("home"))
    blocks = {"outer": F.col("comp") != F.col("home"), "left": F.ceil(F.col("rest") / LEFT).cast("int"), "right": F.ceil(F.col("all") / RIGHT).cast("int")}
    return members.join(whole, "g").withColumns(blocks).select("cls", "comp", "g", *blocks)


def between(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different components of one neighbourhood."""
    full = members.join(texts, "cls")
    spread = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = full.filter("outer").select("g", spread("left").alias("i"), every("right").alias("j"), F.lit(True).alias("x"), "cls", "comp", "text")
    y = full.select("g", every("left").alias("i"), spread("right").alias("j"), F.lit(False).alias("x"), "cls", "comp", "text")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("x").to_numpy()
        cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
        sets = [shingles(t.as_py(), width) for t in table.column("text")]
        y = np.flatnonzero(~side)
        size = np.array([len(sets[i]) for i in y], np.int64)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(y):
            all_ = np.concatenate([sets[i] for i in y])
            order = np.argsort(all_, kind="stable")
            all_, owner = all_[order], np.repeat(np.arange(len(y)), size)[order]
            for i in np.flatnonzero(side):
                lo, hi = np.searchsorted(all_, sets[i], "left"), np.searchsorted(all_, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(y))
                hit = y[(100 * both >= percent * (len(sets[i]) + size - both)) & (comp[y] != comp[i])]
                a.append(np.full(len(hit), cls[i]))
                b.append(cls[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return x.union(y).groupBy("g", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, k: int = 64, m: int = 32, rounds: int = 3, digest: bool = False) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of each row of docs; kept marks the least id of a component.

    Null or empty texts and texts without words have no shingles and link with nothing. A row without id has a null
    component and is kept. Rows that repeat an id are judged by their own texts; with digest, text_hash, the xxhash64 of the
    text, is a fifth column that tells them apart. Other columns aren't read; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    signed = scratch.save(sign_documents(docs, id_col, text_col, width, k, digest), "signed")
    groups = signed.filter("own is not null").groupBy("own").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = scratch.save(groups.withColumn("cls", F.monotonically_increasing_id()), "classes")  # numbers that the written table fixes
    lists = scratch.save(prefixes(coordinates(classes, k), m), "lists")
    met = scratch.save(lists.select("cls").distinct(), "met")

    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    home = classes.join(met, "cls").select("own", "cls", F.col("least").alias("id"))
    again = wanted.join(home.select("id").distinct(), "id", "left_semi")
    texts = scratch.save(classed(again, width).join(home.select("own", "cls"), "own").groupBy("cls").agg(F.first("text").alias("text")), "texts")

    links, labels = None, classes.select(F.col("cls").alias("node"), F.col("cls").alias("comp"))
    for salt in range(rounds):
        open_ = scratch.save(named(lists, labels), "open")
        found = confirmed(scratch.save(agreeing(star(open_, salt), classes, m), "pairs"), texts, width, percent)
        links = scratch.save(found if links is None else links.union(found), "links")
        labels = components(scratch, links)
    open_ = scratch.save(named(lists, labels), "open")
    links = scratch.save(links.union(between(scratch.save(neighbourhoods(scratch, open_), "members"), texts, width, percent)), "links")
    labels = components(scratch, links)

    own = classes.join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = own.groupBy("comp").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).filter("size > 1")
    grouped = scratch.save(own.join(least, "comp").select("own", "component_id"), "grouped")
    out = signed.drop("sig").join(grouped, "own", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    result = out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), *(["text_hash"] if digest else []))
    scratch.drop(*(x for x, _ in list(scratch.paths.values()) if x is not signed and x is not grouped))
    return result


def classed(docs: DataFrame, width: int) -> DataFrame:
    """(own, text) of documents (id, text): the digest of the shingle set of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(shingles(t.as_py(), width)) for t in batch.column(0)], pa.binary()), batch.column(0)], names=["own", "text"])

    return docs.select("text").mapInArrow(run, "own binary, text binary")
