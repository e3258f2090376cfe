import hashlib

import pytest

from gradeloom.llm import exact_dedup as m

COLS = "doc_id long, text string, n_bytes int, f0 string"


def brute(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(text or "", set()).add(i)
    return {(i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for i in ids}


@pytest.fixture
def rows():
    long = "wörd " * 40_000
    return [(1, "a b", 0, "x"), (2, "a b", 1, None), (3, None, 2, "y"), (4, "", None, "y"), (5, "A b", 5, "z"),
            (6, long, 1, ""), (7, long, 1, ""), (8, long[:-1] + "x", 1, ""), (9, "é", 1, ""), (9, "é", 1, "")]


def test_groups_against_brute_force(spark, rows):
    out = m.exact_groups(spark.createDataFrame(rows, COLS))
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_empty_table(spark):
    assert m.exact_groups(spark.createDataFrame([], COLS)).collect() == []


def test_hash_composes(spark, monkeypatch):
    text = bytes(range(256)) * 700
    want = [sum((b + 1) * pow(base, len(text) - 1 - i, m.PRIME) for i, b in enumerate(text)) % m.PRIME
            for base in m.BASES]
    df = spark.createDataFrame([(1, text.decode("latin-1"))], "doc_id long, text string")
    body = text.decode("latin-1").encode()
    want = [sum((b + 1) * pow(base, len(body) - 1 - i, m.PRIME) for i, b in enumerate(body)) % m.PRIME
            for base in m.BASES]
    got = m.fingerprints(df).first()
    assert [got.f0, got.f1, got.f2] == want and got.n_bytes == len(body)


def test_clashing_fingerprints_fall_back_to_sha(spark, rows, monkeypatch):
    whole = m.fingerprints
    monkeypatch.setattr(m, "fingerprints", lambda d: whole(d).selectExpr(
        "doc_id", "sha", "n_bytes", "0L as f0", "0L as f1", "0L as f2", "copies"))
    out = m.exact_groups(spark.createDataFrame(rows, COLS))
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_dedup_keeps_rows_and_columns(spark, rows):
    out = m.exact_dedup(spark.createDataFrame(rows, COLS))
    assert out.columns == ["doc_id", "text", "n_bytes", "f0"]
    assert sorted(r.doc_id for r in out.collect()) == [2, 4, 5, 7, 8, 9]
