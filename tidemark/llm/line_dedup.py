"""Line deduplication by pairwise alignment of overlapping documents.

1. Every document becomes its outline: a hash and a word count for each line.
2. A window is the shortest run of lines from a line onwards, or back from a line, that has enough words for a block. A
   document overlaps with the first holder of each of its windows. Every line of a common block lies in such a window
   within the block: in the one from the block's start, or in the one back from the line itself. So no block is missed,
   and a document has at most two partners a line, however many copies a window has.
3. Each pair's outlines are aligned by patience diff, and common blocks of enough words are cut from the later document.
   Those that the alignment doesn't match, as passages in another order or repeated lines, are found by their windows.

A document is never cut against a later one, so the first holder of a block keeps it. Lines are equal if their 63-bit hashes
are: as only lines of a pair of documents are compared, 10^11 pairs of 100 lines each have one false match in 10,000 corpora.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import Scratch, spread_join

PRIME, BASE = (1 << 61) - 1, 0x1B873593CC9E2D51 % ((1 << 61) - 1)  # of the hash of a run of lines
ROWS, SLICE = 1 << 16, 1000


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising in both: equal ends, then lines unique to both sides in the longest order, then the gaps between.

    Where a gap has no line that is unique on both sides, the n-th occurrence of a line is matched with its n-th occurrence.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            found.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            found.append((i1, j1))
        if i0 == i1 or j0 == j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        once = {x for x, n in in_a.items() if n == 1 and in_b.get(x) == 1}
        if once:
            at = {a[i]: i for i in range(i0, i1) if a[i] in once}
            pairs = [(at[b[j]], j) for j in range(j0, j1) if b[j] in once]
        else:
            at, seen = {}, Counter()
            for i in range(i0, i1):
                if a[i] in in_b:
                    at[a[i], seen[a[i]]] = i
                    seen[a[i]] += 1
            pairs, seen = [], Counter()
            for j in range(j0, j1):
                if (i := at.get((b[j], seen[b[j]]))) is not None:
                    pairs.append((i, j))
                    seen[b[j]] += 1
        ends, last, before = [], [], []
        for n, (i, _) in enumerate(pairs):
            k = bisect_left(ends, i)
            before.append(last[k - 1] if k else None)
            ends[k:], last[k:] = ([i], [n]) if k == len(ends) else ([i, *ends[k + 1 :]], [n, *last[k + 1 :]])
        n, anchors = last[-1] if last else None, []
        while n is not None:
            anchors.append(pairs[n])
            n = before[n]
        if anchors:
            i, j = i0, j0
            for x, y in reversed(anchors):
                found.append((x, y))
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            todo.append((i, i1, j, j1))
    return sorted(found)


def cut_lines(earlier: list[int], later: list[int], words: list[int], least: int) -> set[int]:
    """Positions in later of all lines that are in a common block of at least so many words.

    The alignment gives the blocks that stand in order. It matches each line once, so passages in another order and other
    occurrences of repeated lines are found by their windows, each extended on both sides as far as the lines are equal.
    """
    block: list[tuple[int, int]] = []
    cut: set[int] = set()
    for pair in [*patience(earlier, later), (-9, -9)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(words[j] for _, j in block) >= least:
                cut.update(j for _, j in block)
            block = []
        block.append(pair)
    stay = [0, *accumulate(j not in cut for j in range(len(later)))]
    left = [w for w in windows(later, words, least) if stay[w[1]] < stay[w[2]]]
    if left:
        known = dict(zip(later, words, strict=False))  # a line that later hasn't is in no common block, so its words don't matter
        at = {h: i for h, i, _ in windows(earlier, [known.get(x, least) for x in earlier], least)}
        done = 0  # lines before it that are cut by the last block found here
        for h, j0, j1 in left:
            i0 = at.get(h)
            if i0 is None or j1 <= done:
                continue
            i1 = i0 + j1 - j0
            if earlier[i0:i1] != later[j0:j1]:
                continue
            while i0 and j0 and earlier[i0 - 1] == later[j0 - 1]:
                i0, j0 = i0 - 1, j0 - 1
            while i1 < len(earlier) and j1 < len(later) and earlier[i1] == later[j1]:
                i1, j1 = i1 + 1, j1 + 1
            cut.update(range(j0, j1))
            done = j1
    return cut


def windows(lines: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(hash, start, end) of the shortest runs of at least so many words that start or end at each line."""
    before, total, power = [0], [0], [1]
    for x, n in zip(lines, words, strict=False):
        before.append((before[-1] * BASE + x + 1) % PRIME)
        total.append(total[-1] + n)
        power.append(power[-1] * BASE % PRIME)
    ends, end = set(), 0
    for start in range(len(lines)):
        while end < len(lines) and (end == start or total[end] - total[start] < least):
            end += 1
        if total[end] - total[start] < least:
            break
        ends.add((start, end))
    start = 0
    for end in range(1, len(lines) + 1):
        while start + 1 < end and total[end] - total[start + 1] >= least:
            start += 1
        if total[end] - total[start] >= least:
            ends.add((start, end))
    return [((before[end] - before[start] * power[end - start]) % PRIME, start, end) for start, end in sorted(ends)]


def outlines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, lines, words) of each distinct document: id, hash of the text as tie-break, hash and words of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                lines = [t.as_py().split(b"\n") for t in batch.column(2)]
                hashes = [[xxh3_64_intdigest(x.strip()) >> 1 for x in own] for own in lines]
                words = [[len(x.split()) for x in own] for own in lines]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32()))], names=["d", "t", "lines", "words"])

    own = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).cast("binary").alias("text"))
    return own.filter("d is not null and text is not null").mapInArrow(run, "d long, t long, lines array<long>, words array<int>").dropDuplicates(["d", "t"])


def partners(scratch: Scratch, outline: DataFrame, least: int) -> DataFrame:
    """(d, t, e, u): each document with the first holders of its windows, where these are earlier.

    Windows that very many documents have are spread, so that no task has all their holders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["h", "d", "t"])
            for x in out:
                x.clear()
            return batch

        out: tuple[list[int], ...] = ([], [], [])
        for batch in batches:
            for d, t, lines, words in zip(*(batch.column(i) for i in range(4)), strict=True):
                own = {h for h, _, _ in windows(lines.as_py(), words.as_py(), least)}
                for x, values in zip(out, (own, [d.as_py()] * len(own), [t.as_py()] * len(own)), strict=True):
                    x.extend(values)
                if len(out[0]) >= ROWS:
                    yield told()
        yield told()

    window = outline.select("d", "t", "lines", "words").mapInArrow(run, "h long, d long, t long")
    spread = window.groupBy("h").agg(F.min(F.struct("d", "t")).alias("first"), F.max(F.struct("d", "t")).alias("final"), F.count("*").alias("n")).filter("first != final")
    spread = scratch.save(spread.select("h", "n", F.col("first.d").alias("e"), F.col("first.t").alias("u")), "windows")
    seen = spread_join(window, spread, "h", "n", F.col("d")).filter("e < d or e = d and u < t")
    return seen.select("d", "t", "e", "u").distinct()


def cuts(outline: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(d, t, cut): the sorted positions of the lines that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(cut_lines(e.as_py(), x.as_py(), w.as_py(), least)) for e, x, w in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["d", "t", "cut"])

    earlier = outline.select(F.col("d").alias("e"), F.col("t").alias("u"), F.col("lines").alias("earlier"))
    both = pairs.join(earlier, ["e", "u"]).join(outline, ["d", "t"]).select("d", "t", "earlier", "lines", "words")
    found = both.mapInArrow(run, "d long, t long, cut array<int>").filter(F.size("cut") > 0)
    return found.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cut")))).alias("cut"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """docs with each text cut, and n_removed (lines) and removed (their positions) beside it.

    Lines are parted by \\n and compared without the white space at their ends; least is the least number of words of a
    block. Rows without id or text and empty texts come back as they are. Of rows with one id, the one whose text has the
    lesser hash counts as the earlier; rows with the same id and text are one document, cut alike. All columns of docs are
    kept, whatever their names; n_removed and removed replace columns of these names. A text of which no line is left
    becomes empty.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    outline = scratch.save(outlines(docs, id_col, text_col), "outlines")
    pairs = scratch.save(partners(scratch, outline, least), "pairs")
    cut = scratch.save(cuts(outline, pairs, least), "cuts")
    scratch.drop(*(x for x, _ in list(scratch.paths.values()) if x is not cut))
    # the cuts grow with the corpus, so they are joined in the same way at every size: never sent to all tasks
    key = {"__d": F.col(id_col).cast("long"), "__t": F.xxhash64(text_col)}
    joined = docs.withColumns(key).join(cut.select(F.col("d").alias("__d"), F.col("t").alias("__t"), F.col("cut").alias("__cut")).hint("merge"), ["__d", "__t"], "left")
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains("__cut", i)), "\n")
    new = {text_col: F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(left), "n_removed": F.when(F.col("__cut").isNull(), 0).otherwise(F.size("__cut")), "removed": F.coalesce("__cut", F.array().cast("array<int>"))}
    return joined.withColumns(new).select(*[c for c in docs.columns if c not in ("n_removed", "removed")], "n_removed", "removed")
