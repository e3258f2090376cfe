import random
import re

import pytest

from gradeloom.llm import jaccard_join as m
from gradeloom.llm.components import components

DOCS = "doc_id long, text string, n int, key string"


def gram_set(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=90):
    sets = [(i, gram_set(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            n = len(x & y)
            if None not in (i, j) and n and 100 * n >= percent * (len(x) + len(y) - n):
                lo, hi = sorted((top(i), top(j)))
                parent[hi] = lo
    return sorted(((i, len(s), top(i) if i is not None else None) for i, s in sets), key=str)


def family(seed, base_words, copies, edits):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        out.append(" ".join(w))
    return out


def check(spark, rows):
    out = m.near_groups(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_families_against_brute_force(spark):
    texts = family(1, 120, 90, 5) + family(2, 60, 60, 4) + family(3, 200, 6, 4) + family(4, 12, 20, 2)
    random.Random(0).shuffle(texts)
    check(spark, [(i * 3, t, 0, "k") for i, t in enumerate(texts)])


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, 0, ""), (2, "", 0, ""), (3, " \t", 0, ""), (4, "One", 0, ""), (5, "one", 0, ""), (6, "a b", 0, ""),
            (7, "A b", 0, ""), (8, "a b c", 0, ""), (9, "Éa b c", 0, ""), (10, "éa b c", 0, ""), (11, long, 0, ""),
            (12, long + " tail", 0, ""), (None, long, 0, ""), (12, long + " tail", 0, ""), (13, "a a a a a", 0, "")]
    check(spark, rows)
    assert m.near_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_pairs_of_long_lists_are_not_lost(spark, monkeypatch):
    monkeypatch.setattr(m, "LIST_MAX", (2, 2, 2))
    check(spark, [(i, t, 0, "k") for i, t in enumerate(family(5, 80, 40, 7) + family(6, 40, 40, 5))])


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(None, 3), (5, 5)]
    out = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = {n: n for e in real for n in e}
    for _ in want:
        for a, b in real:
            want[a] = want[b] = min(want[a], want[b])
    assert out == want


def test_dedup(spark):
    rows = [(i, t, 0, "k") for i, t in enumerate(family(7, 100, 10, 3))] + [(None, "x", 0, "")]
    left = m.near_dedup(spark.createDataFrame(rows, DOCS))
    assert left.columns == ["doc_id", "text", "n", "key"]
    keep = {c for i, _, c in brute(rows) if i is not None} | {None}
    assert {r.doc_id for r in left.collect()} == keep


def compared_pairs(spark, monkeypatch, texts):
    """The pairs of doc_ids that were compared, those without a pivot apart."""
    seen, real = [], m._with_sets

    def spy(pairs, sets, state):
        seen.extend(pairs.select("a", "b", "pivot").collect())
        return real(pairs, sets, state)

    monkeypatch.setattr(m, "_with_sets", spy)
    check(spark, [(i, t, 0, "k") for i, t in enumerate(texts)])
    return [(r.a, r.b) for r in seen], [(r.a, r.b) for r in seen if not r.pivot]


def test_texts_just_beyond_the_threshold_are_hardly_compared(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(60):
        w = list(base)
        for j, at in enumerate(rng.sample(range(2, 148), 4)):
            w[at] = f"x{i}_{j}"
        texts.append(" ".join(w))
    _, pairs = compared_pairs(spark, monkeypatch, texts)
    assert len(pairs) < 60


def test_texts_of_other_sizes_are_not_compared(spark, monkeypatch):
    base = [f"b{i}" for i in range(400)]
    texts = [" ".join(base[:20] + [f"x{i}_{j}" for j in range(int(12 * 1.4 ** i))]) for i in range(14)]
    texts += family(7, 80, 20, 4)
    pairs, _ = compared_pairs(spark, monkeypatch, texts)
    assert pairs
    for a, b in pairs:
        n = sorted((len(gram_set(texts[a])), len(gram_set(texts[b]))))
        assert n[0] >= 0.7 * n[1]


@pytest.mark.parametrize("percent", [80, 90])
def test_sizes_at_the_edge_of_a_band(spark, percent):
    rows = []
    for n in (10, 20, 40, 50, 81, 90, 100, 180, 200):
        large = [f"t{n}_{i}" for i in range(n + 2)]
        rows += [" ".join(large), " ".join(large[:n * percent // 100 + 2])]
    rows = [(i, t, 0, "k") for i, t in enumerate(rows)]
    out = m.near_groups(spark.createDataFrame(rows, DOCS), 3, percent)
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows, percent)


def test_counters_keep_their_numbers():
    for top in (0, 255, 256, 2 ** 31 - 1):
        counts = m.np.zeros(m.PART, m.np.int32)
        counts[[3, -1]] = top, top // 2
        assert (m._unpacked(m._packed(counts)) == counts).all()
