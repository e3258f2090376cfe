import hashlib
import re
import zlib

import duckdb
import pytest

from gradeloom.llm import prefix_trie as m

SF = "/root/testdata/sf0.001"
COLS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Every node of the trie of rebuilt conversations, by plain dictionaries."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(__import__("math").fmod(c, 20)), [])
        rebuilt[c] = base[:h] + own[c][h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    count = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    def sub(p):
        kids = children.get(p, [])
        own_saved = (len(nodes[p]) - 1) * (count(p[-1][1]) if p else 0)
        leaves, saved = (1 if not kids else 0), own_saved
        for k in kids:
            a, b = sub(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved
    out = set()
    for p, members in nodes.items():
        leaves, saved = sub(p)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children.get(p, [])),
                 leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def fixture():
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    same = [(1000 + i, t, "user" if t % 2 == 0 else "assistant", f"Same turn {t}.") for i in range(30) for t in range(4)]
    odd = [(2000, None, None, None), (2000, 1, "user", "a  b\tc"), (2000, 1, "user", "a b c"), (None, 1, "user", "x"),
           (2001, 0, "user", "é " * 50_000), (2020, 5, "user", "Own.")]
    return rows + same + odd


@pytest.mark.parametrize("bound", [m.CONTAINER_TURNS, 3])
def test_against_brute_force(spark, bound):
    rows = fixture()
    df = spark.createDataFrame(rows, COLS).withColumn("key", spark_lit(1)).withColumn("path", spark_lit("x"))
    got = m.prefix_trie(df, container_turns=bound).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute(rows)


def spark_lit(v):
    from pyspark.sql import functions as F
    return F.lit(v)


def test_empty_table(spark):
    assert m.prefix_trie(spark.createDataFrame([], COLS)).collect() == []


def test_chain_matches_spark(spark):
    got = spark.sql("select xxhash64(cast(-3 as bigint), cast(77 as bigint)) as h").collect()[0].h
    assert got == m.chain(-3, 77)
