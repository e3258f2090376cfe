import hashlib
import itertools
import random
import re

import numpy as np

from gradeloom.llm import pii as m
from gradeloom.llm.queries import op9_pii
from tests.conftest import SF

# The patterns as the contract words them.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def ok(kind, text):
    d = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) if 2 * int(c) < 10 else 2 * int(c) - 9) for i, c in enumerate(d[::-1]))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    return [(m.KINDS.index(k), *x.span()) for k in m.KINDS for x in re.finditer(PATTERNS[k], text) if ok(k, x[0])]


def test_patterns_against_plain_regex():
    rng = random.Random(5)
    parts = ["a", "B.c", "@", ".", "x@y.z", "1", "255", "256", "10.0.0.1", "-", " ", "+1", "(", ")", "4111 1111 1111 1111",
             "4012888888881881", "+44 20 7946 0958", "é", "%", "00", "1.2.3.4.5", "@@", "a@b", "\n", "0000000000000"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert m.base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 200_000, "a@" * 150_000, "+1" + "-" * 200_000):
        m.base_spans(text)


def test_propagation_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    unary, edges = rng.normal(size=(5, 3)), np.array([[0, 1], [1, 2], [1, 3], [3, 4]])
    pots = rng.normal(size=(4, 3, 3))
    joint = {x: np.exp(sum(unary[i, v] for i, v in enumerate(x)) + sum(p[x[a], x[b]] for (a, b), p in zip(edges, pots)))
             for x in itertools.product(range(3), repeat=5)}
    want = np.array([[sum(v for x, v in joint.items() if x[i] == k) for k in range(3)] for i in range(5)])
    assert np.allclose(m.propagate(unary, edges, pots), want / want.sum(1, keepdims=True))


def test_repeated_tokens_take_the_label_of_the_entity(spark):
    rows = [(i, f"write to ana.b{i}@mail.example.com or call +1 (555) 555-{1000 + i} room {i} in 19{i % 90 + 10} and 10.0.{i}.7 host", "c") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    model = m.fit_pii(docs)
    text = "call +15555552485 today; later he dialled 5555552485 again in 1990"
    base = [m.base_spans(text)]
    (more,) = m.added_spans([text], base, model)
    assert [text[a:b] for _, a, b in base[0]] == ["+15555552485"]
    assert (3, text.index(" 5555552485") + 1, text.index(" again")) in more and not any("1990" in text[a:b] for _, a, b in more)


def test_query_against_plain_regex(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    for r in op9_pii(spark, SF).collect():
        spans = plain(texts[r.doc_id])
        joined = ",".join(f"{m.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in spans) for i in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_defined_results(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a@b.c", ""), (3, "a@b.c", ""), (3, "a@b.c", ""), (4, "word " * 50_000 + "1.2.3.4", None)],
                                 "doc_id long, text string, base string")
    out = m.digest(m.find_pii(docs, m.fit_pii(docs))).collect()
    assert len(out) == 6 and {r.n_email for r in out if r.doc_id in (3, None)} == {1}
    empty = docs.filter("false")
    assert m.find_pii(empty, m.fit_pii(empty)).collect() == []
