import random
import re

import numpy as np
import pytest

from gradeloom.llm import chain_dedup, suffix_dedup
from gradeloom.llm.anchors import minimisers, word_table

DOCS = "doc_id long, text string, start string, key int"


def words(rng, n, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def spans_by_words(rows, n):
    """Brute force: maximal runs of words that lie in some window of n words that occurs twice."""
    seen, texts = {}, {}
    for i, t, *_ in rows:
        texts.setdefault((i, t or ""), list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")))
    for key, ms in texts.items():
        w = [m[0].lower() for m in ms]
        for p in range(len(w) - n + 1):
            seen.setdefault(tuple(w[p:p + n]), []).append((key, p))
    inside = {}
    for places in seen.values():
        if len(places) > 1:
            for key, p in places:
                inside.setdefault(key, set()).update(range(p, p + n))
    out = set()
    for key, own in inside.items():
        for p in sorted(own):
            if p - 1 not in own:
                e = p
                while e + 1 in own:
                    e += 1
                out.add((key[0], texts[key][p].start(), texts[key][e].end()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    shared = [words(rng, n) for n in (50, 51, 70, 49, 200)]
    out = []
    for i in range(40):
        w = words(rng, rng.randrange(80))
        for s in rng.sample(shared, rng.randrange(3)):
            w += s + words(rng, 1 + rng.randrange(40))
        out.append((i, "\n ".join(w) if i % 3 else " ".join(w).upper(), "s", 1))
    twice = words(rng, 60)
    out += [(50, " ".join(twice + words(rng, 5) + twice), "s", 1), (51, None, "s", 1), (52, "", "s", 1), (None, " ".join(shared[4]), "s", 1),
            out[3], (53, " ".join(words(rng, 20_000, 10**6) + shared[2]), None, None)]
    return out


def test_minimisers_of_shared_words():
    rng = random.Random(1)
    same = words(rng, 20)
    a, b = words(rng, 30) + same + words(rng, 9), words(rng, 4) + same + words(rng, 50)
    h, doc, _, _, first = word_table([" ".join(a), " ".join(b)])
    at, grams = minimisers(h, doc, 6, 15)
    assert {grams[p] for p in at if doc[p] == 0} & {grams[p] for p in at if doc[p] == 1}
    naive = {s + min(range(15), key=lambda j: (grams[s + j], j)) for s in range(len(h) - 19) if doc[s] == doc[s + 19]}
    assert naive == set(at.tolist())


def test_suffixes_against_brute_force(spark, rows):
    out = suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS))
    assert {(r.doc_id, r.start, r.end) for r in out.collect()} == spans_by_words(rows, 50)


def test_one_passage_in_many_documents(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    many = [(i, " ".join(words(rng, 5) + passage + words(rng, 5)), "", 0) for i in range(300)]
    for find in (suffix_dedup.repeated_passages, chain_dedup.fuzzy_passages):
        got = find(spark.createDataFrame(many, DOCS).repartition(7)).collect()
        assert sorted(r.doc_id for r in got) == list(range(300))


def test_passages_around_a_common_part(spark):
    rng = random.Random(21)
    common = words(rng, 40, 10**6)
    rows = [(i, " ".join(words(rng, 30, 10**6) + common + words(rng, 30, 10**6)), "", 0) for i in range(400)]
    for i in range(20):
        passage = words(rng, 5, 10**6) + common + words(rng, 5, 10**6)
        rows += [(1000 + 2 * i + j, " ".join(words(rng, 30, 10**6) + passage + words(rng, 30, 10**6)), "", 0) for j in (0, 1)]
    out = suffix_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.start, r.end) for r in out} == spans_by_words(rows, 50)


def test_chains_against_brute_force():
    rng = random.Random(2)
    k = chain_dedup.K
    for _ in range(200):
        pts = list({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
        x, y = zip(*pts)
        for chain in chain_dedup.chains(list(x), list(y)):
            assert all(x[a] < x[b] and y[a] < y[b] and x[b] - x[a] <= chain_dedup.MAX_GAP + k for a, b in zip(chain, chain[1:]))
    diagonal = chain_dedup.chains([0, 6, 13, 20, 3], [5, 11, 18, 26, 40])
    assert diagonal[0] == [0, 1, 2, 3]


def test_chains_of_many_pairs_at_once(monkeypatch):
    rng = random.Random(22)
    pairs = [sorted({(rng.randrange(120), rng.randrange(90)) for _ in range(rng.randrange(50))}) for _ in range(30)]
    rows = [(i, x, y) for i, matches in enumerate(pairs) for x, y in matches]
    pair, x, y = (np.array(c) for c in zip(*rows))
    for held in (1, 40, chain_dedup.CANDIDATES):
        monkeypatch.setattr(chain_dedup, "CANDIDATES", held)
        got = {}
        for i, chain in chain_dedup.pair_chains(pair, x, y):
            got.setdefault(i, []).append([(int(x[j]), int(y[j])) for j in chain])
        assert got == {i: [[m[j] for j in c] for c in chain_dedup.chains(*map(list, zip(*m)))] for i, m in enumerate(pairs) if m}


def test_matches_of_many_pairs_at_once():
    import pyarrow as pa

    rng = random.Random(23)
    rows = [{"a": i, "b": 1000 + i, **{c: [{"pos": p, "seed": rng.randrange(12)} for p in range(rng.randrange(25))] for c in ("seeds_a", "seeds_b")}} for i in range(60)]
    want = {}
    for r in rows:
        of = [{}, {}]
        for places, c in zip(of, ("seeds_a", "seeds_b")):
            for s in r[c]:
                places.setdefault(s["seed"], []).append(s["pos"])
        found = sorted({m for s in of[0].keys() & of[1].keys() for m in chain_dedup._places(of[0][s], of[1][s])})
        if len(found) > 1:
            want[r["a"], r["b"]] = found
    # A slice of a batch: its lists don't start at the first value.
    batch = pa.RecordBatch.from_pylist([rows[0], *rows]).slice(1)
    got = {(r["a"], r["b"]): [(m["x"], m["y"]) for m in r["matches"]] for b in chain_dedup._match(iter([batch])) for r in b.to_pylist()}
    assert got == want


def test_chain_scores_against_all_predecessors():
    rng = random.Random(12)
    k, reach = chain_dedup.K, chain_dedup.MAX_GAP + chain_dedup.K
    for _ in range(200):
        pts = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(40)})
        best = []
        for i, (x, y) in enumerate(pts):
            best.append(max([k, *[best[j] + min(k, x - a, y - b) - chain_dedup.GAP * (x - a + y - b)
                                  for j, (a, b) in enumerate(pts[:i]) if 0 < x - a <= reach and 0 < y - b <= reach]]))
        first = [pts[i] for i in chain_dedup.chains(*map(list, zip(*pts)))[0]]
        got = k + sum(min(k, x - a, y - b) - chain_dedup.GAP * (x - a + y - b) for (a, b), (x, y) in zip(first, first[1:]))
        assert abs(got - max(best)) < 1e-9


def test_two_passages_of_one_pair(spark):
    rng = random.Random(13)
    one, two = words(rng, 60, 10**6), words(rng, 200, 10**6)
    texts = [words(rng, 20, 10**6) + one + words(rng, n, 10**6) + two + words(rng, 20, 10**6) for n in (100, 130)]
    copy = words(rng, 300, 10**6)
    longer = copy[:120] + words(rng, 70, 10**6) + copy[120:]
    rows = [(i, " ".join(w), "", 0) for i, w in enumerate([*texts, copy, longer])]
    out = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()
    covered = lambda spans: {(i, m.start()) for i, a, b in spans for m in re.finditer(r"\S+", rows[i][1]) if a <= m.start() < b}
    assert covered((r.doc_id, r.start, r.end) for r in out) == covered(spans_by_words(rows, 50))


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 9)), rng.integers(0, 5, rng.integers(0, 9))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert chain_dedup.equal_words(a, b) == table[-1][-1]


def test_fuzzy_passages(spark, rows):
    rng = random.Random(6)
    passage = words(rng, 80)
    fuzzy = []
    for i in range(100, 130):
        p = list(passage)
        for _ in range(4):
            p[rng.randrange(len(p))] = "edit"
        if i % 2:
            del p[rng.randrange(len(p))]
        fuzzy.append((i, " ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6)), "", 0))
    out = chain_dedup.fuzzy_passages(spark.createDataFrame(rows + fuzzy, DOCS)).collect()
    found = {r.doc_id: (r.start, r.end) for r in out}
    assert set(range(100, 130)) <= set(found)
    assert all(found[i][1] - found[i][0] >= 250 for i, *_ in fuzzy)
    # Exact repeats are fuzzy ones, too; texts of unrelated words are left alone.
    exact = {i for i, a, b in spans_by_words(rows, 60)} - {50}
    assert exact <= set(found) and not set(found) - {i for i, *_ in spans_by_words(rows, 40)} - set(range(100, 130))


def test_copies_whose_phrases_stand_in_other_texts(spark):
    rng = random.Random(31)
    rows, key = [], 0
    for _ in range(12):
        phrases = [words(rng, 24, 10**6) for _ in range(3)]
        passage = sum(phrases, [])
        # Many texts hold one phrase each, so the two that hold all are seldom the ones chosen from a seed's list.
        for p in phrases * 30 + [passage] * 2:
            rows.append((key, " ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6)), "", 0))
            key += 1
    out = chain_dedup.fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in out} == {i for i, *_ in spans_by_words(rows, 72)} and len(out) == 24


def test_periodic_passages(spark):
    rng = random.Random(32)
    rows = [(i, " ".join(words(rng, 30, 10**6) + ["is", "not"] * (40 + i) + words(rng, 30, 10**6)), "", 0) for i in range(30)]
    out = {r.doc_id: (r.start, r.end) for r in chain_dedup.fuzzy_passages(spark.createDataFrame(rows, DOCS)).collect()}
    want = {i: (a, b) for i, a, b in spans_by_words(rows, 50)}
    assert set(out) == set(want) and all(
        len(rows[i][1][max(a, out[i][0]):min(b, out[i][1])].split()) > len(rows[i][1][a:b].split()) - chain_dedup.K - chain_dedup.WINDOW for i, (a, b) in want.items())


def test_places_of_runs():
    assert chain_dedup._places([3, 90], [5]) == {(3, 5), (90, 5)}
    one, two = list(range(0, 40, 2)), list(range(100, 110, 2))
    got = chain_dedup._places(one, two)
    assert {x for x, _ in got} == set(one) and {y for _, y in got} == set(two) and len(got) <= 2 * len(one)


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert suffix_dedup.repeated_passages(empty).collect() == [] and chain_dedup.fuzzy_passages(empty).collect() == []


def test_stretches_leave_in_parts(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(8)
    texts = [[{"pos": 5 * i, "seed": int(x)} for i, x in enumerate(rng.integers(0, 40, n))] for n in (300, 0, 1, 200, 250)]
    spans = [None, None, [], [{"first": 100, "last": 400}, {"first": 300, "last": 500}], []]
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(5), pa.int64()), pa.array(texts, pa.list_(pa.struct([("pos", pa.int64()), ("seed", pa.int64())]))),
        pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], ["key", "seeds", "spans"])
    want = set()
    for key, (seeds, gone) in enumerate(zip(texts, spans)):
        for i, one in enumerate(seeds):
            for two in seeds[i + 1:]:
                inside = any(one["pos"] >= a and two["pos"] + chain_dedup.K <= b for a, b in [(100, 500)]) if key == 3 else False
                if 20 <= two["pos"] - one["pos"] <= 300 and not inside:
                    want.add((key, one["seed"], two["seed"]))
    monkeypatch.setattr(chain_dedup, "STRETCHES", 500, raising=False)
    parts = list(chain_dedup._uncovered(20, 300, True)(iter([batch])))
    assert {(r["key"], r["one"], r["two"]) for p in parts for r in p.to_pylist()} == want
    assert all(p.num_rows <= 1500 for p in parts) and sum(p.num_rows for p in parts) > 3000
