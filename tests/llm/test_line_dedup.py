import random

from tidemark.llm.line_dedup import cut_lines, dedup_lines, patience

SCHEMA = "doc_id long, text string, source string, e long, t long, n_removed string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "s", 1, 2, "x") for d, t in rows], SCHEMA)


def run(spark, rows):
    return {(r.doc_id, r.n_removed, r.text) for r in dedup_lines(frame(spark, rows)).collect()}


def test_patience_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(8) for _ in range(rng.randrange(14))] for _ in range(2))
        got = patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_blocks_in_any_order_are_cut():
    words = [10] * 9
    assert cut_lines([1, 2, 3, 4, 5, 6], [4, 5, 6, 9, 1, 2, 3, 8, 8], words, 30) == {0, 1, 2, 4, 5, 6}
    assert cut_lines([1, 2, 3], [1, 7, 2, 8, 3], words, 30) == set()


def test_passages_against_brute_force(spark):
    """Planted passages of over 50 words go from all but the first holder; everything else stays."""
    rng = random.Random(5)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(20), line(20), line(15)], [line(60)], [line(30), line(30)]]
    short = line(6)
    rows, seen, expected = [], set(), set()
    for d in range(60):
        own, left, removed = [], [], 0
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(5)
            part = passages[k] if k < 3 else [short] if k == 3 else []
            for x in part:
                own.append(x)
                if k < 3 and k in seen and seen_before[k] < d:
                    removed += 1
                else:
                    left.append(x)
            if k < 3 and k not in seen:
                seen.add(k)
                seen_before = {**(seen_before if len(seen) > 1 else {}), k: d}
            x = line(rng.randrange(1, 30))
            own.append(x)
            left.append(x)
        rows.append((d, "\n".join(own)))
        expected.add((d, removed, "\n".join(left)))
    assert run(spark, rows) == expected


def test_copies_and_odd_rows(spark):
    text = "\n".join(f"line {i} " + "of some words that are the same " * 2 for i in range(9))
    got = run(spark, [(5, text), (7, text), (9, text + "\nand more"), (None, text), (3, None), (4, ""), (8, "\n\n"), (7, text)])
    assert got == {(5, 0, text), (7, 9, ""), (9, 9, "and more"), (None, 0, text), (3, 0, None), (4, 0, ""), (8, 0, "\n\n")}


def test_columns_and_empty_table(spark):
    out = dedup_lines(frame(spark, []))
    assert out.columns == ["doc_id", "text", "source", "e", "t", "n_removed", "removed"] and out.collect() == []


def test_very_long_text(spark):
    text = "\n".join(f"line {i} has five words" for i in range(60_000))
    got = run(spark, [(1, text), (2, "own\n" + text + "\nown")])
    assert got == {(1, 0, text), (2, 60_000, "own\nown")}


def test_blocks_of_lines_with_other_first_holders(spark):
    rng = random.Random(7)
    x, y = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(2))
    rows = [(0, x), (1, y), (2, f"{x}\n{y}"), (3, f"own\n{x}\n{y}\nend"), (4, f"{y}\n{x}")]
    assert run(spark, rows) == {(0, 0, x), (1, 0, y), (2, 0, rows[2][1]), (3, 2, "own\nend"), (4, 0, rows[4][1])}
    first = [" ".join(f"{p}{i}" for i in range(n)) for p, n in (("a", 49), ("b", 2), ("c", 1))]
    text = "\n".join(first)  # the last line is in no window from the first line on
    assert run(spark, [(0, "\n".join(first[:2])), (1, text), (2, text)]) == {(0, 0, "\n".join(first[:2])), (1, 2, first[2]), (2, 3, "")}


def in_common_blocks(earlier, later, words, least):
    """Positions in later of all common contiguous blocks, by trying every pair of starts."""
    out = set()
    for i in range(len(earlier)):
        for j in range(len(later)):
            n = 0
            while i + n < len(earlier) and j + n < len(later) and earlier[i + n] == later[j + n]:
                n += 1
            if n and sum(words[j : j + n]) >= least:
                out |= set(range(j, j + n))
    return out


def test_blocks_among_repeated_lines_are_cut():
    p1, p2, p3, p4, j, f, g, h = range(8)
    assert cut_lines([p1, p2, p3, p4], [p1, p2, j, p1, p2, p3, p4], [15] * 7, 50) == {3, 4, 5, 6}
    assert cut_lines([f, f, f, g], [f, h, f, f, f, g], [15] * 6, 50) == {2, 3, 4, 5}
    rng = random.Random(11)
    found = 0
    for _ in range(5000):
        kinds = rng.randint(1, 7)
        size = [rng.choice((0, 1, 5, 15, 25, 49, 60)) for _ in range(kinds)]
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(16))] for _ in range(2))
        words = [size[x] for x in b]
        expected = in_common_blocks(a, b, words, 50)
        assert cut_lines(a, b, words, 50) == expected
        found += 0 < len(expected) < len(b)
    assert found > 500


def test_documents_against_all_common_blocks(spark):
    """Every line of a block that any earlier document has goes, and no other."""
    rng = random.Random(12)
    lines = [" ".join(f"v{k}x{i}" for i in range(n)) for k, n in enumerate((0, 1, 3, 15, 20, 20, 25, 30, 49, 60))]
    texts = [[rng.randrange(10) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    expected = set()
    for d, own in enumerate(texts):
        words = [len(lines[k].split()) for k in own]
        cut = set().union(*(in_common_blocks(e, own, words, 50) for e in texts[:d]))
        expected.add((d, len(cut), "\n".join(lines[k] for i, k in enumerate(own) if i not in cut)))
    assert run(spark, [(d, "\n".join(lines[k] for k in own)) for d, own in enumerate(texts)]) == expected
