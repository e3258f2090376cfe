import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gradeloom.llm import packing as m
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, start string, ids int"


def check(spark, rows, least_full=0.0):
    plain = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append([*plain.encode(t or "", add_special_tokens=False).ids, 0])
    pieces = m.pack(spark.createDataFrame(rows, DOCS), PATH).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= m.WINDOW and at & (at - 1) == 0, "nothing is padded"
    for i, versions in want.items():
        if len(versions) == 1:
            at = 0
            for p in sorted(docs[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(versions[0])
                assert p.ids_crc32 == zlib.crc32(np.array(versions[0][at:at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(versions[0])
        else:
            assert sum(p.length for p in docs[i]) == sum(map(len, versions))
    assert set(docs) == set(want)
    return sequences


def test_round_trip_of_the_table(spark):
    rows = [(r.doc_id, r.text, "", 0) for r in spark.read.parquet(SF + "/documents.parquet").collect()]
    check(spark, rows)


def test_edge_cases(spark):
    rows = [(1, None, "", 0), (2, "", "", 0), (3, "<|endoftext|> x", "", 0), (4, "a" * 200_000, "", 0), (5, "naïve ☃ 𝄞\u0000 \n\n  x", None, 0),
            (6, "same", "", 0), (6, "same", "", 0), (None, "no id", "", 0), (7, "word " * 30_000, "", 0), (8, " ", "", 0)]
    check(spark, rows)
    assert m.pack(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_bm25_against_brute_force():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50, rng.integers(5, 60)) for _ in range(40)]
    df = np.array([sum(t in d for d in docs) for t in range(50)])
    idf = np.log(1 + (40 - df + 0.5) / (df + 0.5))
    mean = np.mean([len(d) for d in docs])
    shard = m.Shard(docs, idf, mean)

    def weight(t, d):
        tf = (d == t).sum()
        return idf[t] * tf * (m.K1 + 1) / (tf + m.K1 * (1 - m.B + m.B * len(d) / mean))

    query = sorted(set(docs[0].tolist()), key=lambda t: -weight(t, docs[0]))[:m.QUERY_TERMS]
    score = [sum(weight(t, d) for t in query) for d in docs]
    got = shard.neighbours(0, np.arange(40) != 0)
    assert [round(score[i], 9) for i in got] == sorted((round(s, 9) for s in score[1:] if s > 0), reverse=True)[:m.NEIGHBOURS]


def test_neighbours_share_windows(spark):
    rng = np.random.default_rng(2)
    topic = [[f"topic{k}word{j}" for j in range(30)] for k in range(4)]
    rows = [(i, " ".join(rng.choice(topic[i % 4], 12)), "", 0) for i in range(200)]
    packed = m.pack(spark.createDataFrame(rows, DOCS).coalesce(1), PATH).collect()
    by = defaultdict(set)
    for p in packed:
        by[p.sequence_id].add(p.doc_id % 4)
    assert np.mean([len(v) for v in by.values()]) < 3
