import random
import re

from gradeloom.llm import decontam as m

DOCS = "doc_id long, text string, item_id string, words int"
ITEMS = "item_id long, text string, doc_id string"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def stretch(flags):
    best, score, since, hits = (0, 0, 0, 0), 0, 0, 0
    for i, e in enumerate(flags):
        if score <= 0:
            score, since, hits = 0, i, 0
        score, hits = score + (1 if e else -2), hits + e
        if score > best[0]:
            best = (score, since, i + 1, hits)
    return best


def brute(docs, items):
    out = {}
    for d, t, *_ in docs:
        w = words(t)
        for k, it, *_ in items:
            v = words(it)
            masks = [[o for o, c in enumerate(x) if c == "1"] for x in m.MASKS] if len(v) >= m.SPAN else [range(len(v))]
            span = m.SPAN if len(v) >= m.SPAN else len(v)
            for shift in range(-len(v), len(w)) if v else []:
                def hit(j):
                    return (0 <= j + shift and j + span <= len(v) and j + shift + span <= len(w)
                            and any(all(w[j + shift + o] == v[j + o] for o in x) for x in masks))
                if not any(hit(j) for j in range(len(v))):
                    continue
                skip = max(0, -shift)
                n = min(len(v) - skip, len(w) - skip - shift)
                _, a, b, hits = stretch([w[shift + skip + x] == v[skip + x] for x in range(n)])
                if hits >= min(m.MIN_WORDS, len(v)) and hits / max(1, b - a) >= m.SIMILARITY:
                    key = (hits, hits / (b - a), -(shift + skip + a))
                    out[(d, k)] = max(out.get((d, k), key), key)
    return {(d, k, h, s, -p) for (d, k), (h, s, p) in out.items()}


def found(spark, docs, items):
    out = m.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.item_id, r.matched_words, r.similarity, r.doc_word) for r in out.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=n)), "x") for i, n in enumerate([30, 14, 12, 11, 5, 1, 40])]
    items += [(2, items[2][1], "again"), (None, items[0][1] + " tail", "n"), (9, None, ""), (10, "!?", "")]
    docs = []
    for d in range(40):
        part = words(rng.choice(items[:7])[1])
        part = [rng.choice(vocab) if rng.random() < 0.08 else x for x in part][rng.randrange(3):]
        docs.append((d, ", ".join(rng.choices(vocab, k=rng.randrange(30)) + part + rng.choices(vocab, k=rng.randrange(30))).upper(), "c", 1))
    docs += [(None, items[0][1], "", 0), (90, None, "", 0), (91, "", "", 0), docs[0], (92, "zz " * 30_000 + items[0][1], None, None)]
    got = found(spark, docs, items)
    assert got == brute(docs, items) and len(got) > 20


def test_empty_tables_and_filter(spark):
    some = [(1, "a b c d e f g h i j k l m n", "", 0), (2, "other words", "", 0), (2, "other words", "", 0), (None, "x", "", 0)]
    item = [(1, "a b c d e f g h i j k l m", "")]
    assert found(spark, [], item) == set() and found(spark, some, []) == set()
    left = m.decontaminate(spark.createDataFrame(some, DOCS), spark.createDataFrame(item, ITEMS))
    assert left.columns == ["doc_id", "text", "item_id", "words"]
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "2", "None"]


def test_no_python_in_the_plan(spark):
    out = m.contamination(spark.createDataFrame([(1, "a", "", 0)], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
