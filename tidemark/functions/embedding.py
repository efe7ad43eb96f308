"""Vectors of texts without a model, keys of cached vectors, and encoding by aspect."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import cosine, finite

WORD = re.compile(r"\b\w\w+\b")


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit hash, as a signed number."""
    h, low = seed, 0xFFFFFFFF

    def mixed(k: int) -> int:
        k = k * 0xCC9E2D51 & low
        return ((k << 15 | k >> 17) & low) * 0x1B873593 & low

    whole = len(data) & ~3
    for at in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) * 5 & low) + 0xE6546B64 & low
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for by, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> by) * factor & low
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def hashed_vector(text: Column, size: int = 384) -> Column:
    """Counts of a text's words (two characters or more, lower case) in so many places by their hash, of length 1."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place: dict[str, int] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(size)
                for w in WORD.findall((t or "").lower()):
                    if w not in place:
                        if len(place) > 200_000:
                            place.clear()
                        place[w] = abs(murmur3(w.encode())) % size
                    v[place[w]] += 1
                out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
            yield pd.Series(out)

    return F.pandas_udf(run, "array<double>")(text)


def sampled_key(rows: DataFrame, text: str, index: str, namespace: str | None = None) -> DataFrame:
    """One row: the key of an ordered corpus by its size, characters and first and last five texts."""
    n, e = f"{namespace}_" if namespace else "", lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda x: x["t"]), "_")
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    pair = F.struct(F.col(index).alias("i"), F.col(text).alias("t"))
    head, tail = rows.orderBy(index).limit(5).agg(e(F.collect_list(pair)).alias("head")), rows.orderBy(F.desc(index)).limit(5).agg(e(F.collect_list(pair)).alias("tail"))
    one = total.crossJoin(F.broadcast(head)).crossJoin(F.broadcast(tail))
    source = F.concat(F.lit(n), F.col("n").cast("string"), F.lit("_"), F.col("chars").cast("string"), F.lit("_"), "head", F.lit("_"), "tail")
    return one.select(F.when(F.col("n") > 0, F.substring(F.sha2(source, 256), 1, 16)).otherwise(f"{namespace or 'empty'}_empty_corpus").alias("key"))


def content_key(rows: DataFrame, text: str, index: str, model: str, size: int, salt: str = "") -> DataFrame:
    """One row: the key of an ordered corpus by all its texts, as digests in order, and the model.

    A digest of digests, so that no task holds all texts: equal for equal corpora, other for others.
    """
    each = rows.select(F.col(index).alias("i"), F.sha2(text, 256).alias("d"))
    block = each.groupBy(F.floor(F.col("i") / 10_000).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return block.agg(F.substring(F.sha2(F.concat(joined, F.lit(f"|{model}|{size}|{salt}")), 256), 1, 16).alias("key"))


def encoded_by_aspect(rows: DataFrame, text: str, aspect: str, encode: Callable[[Column], Column]) -> DataFrame:
    """rows with vector (null for an empty text) and namespace, prop_ and the aspect: what a cache keeps them under."""
    own = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", encode(F.col(text)))
    return rows.withColumns({"vector": own, "namespace": F.concat(F.lit("prop_"), F.coalesce(aspect, F.lit("MIXED")))})


def search_by_intent(rows: DataFrame, query: list[float], vector: str, key: str, intent: str | None = None, label: str = "intent", n: int = 10) -> DataFrame:
    """The n rows of an intent (any case; null: all) nearest to a query vector: similarity, never below 0, to 4 places."""
    own = rows.filter(F.col(label) == intent.upper()) if intent else rows
    s = F.greatest(F.lit(0.0), F.round(cosine(F.col(vector), F.array(*map(F.lit, map(float, query)))), 4))
    return own.filter(finite(F.col(vector))).select(key, label, s.alias("similarity_score")).orderBy(F.desc("similarity_score"), key).limit(n)
