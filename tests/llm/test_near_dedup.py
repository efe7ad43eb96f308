import random
import re

import pytest

from tidemark.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, lang string, comp long, cls int"


def brute(rows):
    """n_shingles and component by comparing all pairs of full sets."""
    sets = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(s), least.get(top(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(vocab)
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        texts.append([word() for _ in range(rng.randint(1, 200))])
    for _ in range(60):  # share a passage, few are near
        own = [word() for _ in range(rng.randint(5, 120))]
        texts.append(own + passage)
    base = [word() for _ in range(150)]
    for _ in range(80):  # near copies at all distances
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(150)] = word()
        texts.append(copy)
    chain = [word() for _ in range(100)]
    for i in range(15):  # each near the next only
        texts.append(chain[4 * i :] + [f"c{j}" for j in range(4 * i)])
    out = [" ".join(t) for t in texts] + ["", None, "  \t\n", "One two", "one  TWO", "É two three"]
    out += out[:10]
    rng.shuffle(out)
    return list(enumerate(out, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(100, "one two three four five six"), (None, "one two three four five six")]
    got = near_duplicates(spark.createDataFrame([(d, t, None, 1, 2) for d, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_very_long_text(spark):
    long = " ".join(f"x{i % 7919}" for i in range(200_000))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(1, long, None, 0, 0), (2, long + " end", None, 0, 0), (3, "x", None, 0, 0)], SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
