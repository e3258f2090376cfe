import math
import struct
import zlib

import xxhash

from gradeloom.llm import sharding as m

COLS = "doc_id long, text string, shard string, slot double, _draws int"


def spark_hash(doc_id, i):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<q", i), seed=seed)


def flat(doc_id, n):
    """The least draw over all shards, with no tree: the descent must reach the same shard."""
    d = [-math.log(((spark_hash(doc_id, i) >> 11) + 0.5) / 2 ** 53) for i in range(n)]
    return d.index(min(d))


def rows():
    long = "ü" * 300_000
    out = [(i, f"text {i % 7}", "x", 1.0, 3) for i in range(400)]
    return out + [(None, None, None, None, None), (None, "a", None, None, None), (5, "text 5", "y", 2.0, 1),
                  (5, "text 5", "y", 2.0, 1), (9000, "", None, None, None), (9001, long, None, None, None)]


def test_against_brute_force(spark):
    data = rows()
    got = m.assign(spark.createDataFrame(data, COLS)).collect()
    assert len(got) == len(data)
    assert {r.law for r in got} == {"key"}
    want = {}
    for doc_id, text, *_ in data:
        b = (text or "").encode()
        want.setdefault((doc_id, len(b) + 8, zlib.crc32(b), flat(doc_id, 24), flat(doc_id, 25)), 0)
        want[(doc_id, len(b) + 8, zlib.crc32(b), flat(doc_id, 24), flat(doc_id, 25))] += 1
    seen = {}
    for r in got:
        key = (r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard)
        seen[key] = seen.get(key, 0) + 1
    assert seen == want


def test_slots_gapless_and_ordered(spark):
    got = m.assign(spark.createDataFrame(rows(), COLS)).collect()
    for shard in {r.shard for r in got}:
        mine = sorted((r.slot, r.doc_id if r.doc_id is not None else -1, r.size) for r in got if r.shard == shard)
        assert [s for s, *_ in mine] == list(range(len(mine)))
        keys = [(d, z) for _, d, z in mine]
        nulls_first = [k for k in keys if k[0] == -1] + [k for k in keys if k[0] != -1]
        assert keys == nulls_first or keys == sorted(keys)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) as text")
    got = m.assign(df).collect()
    moved = [r for r in got if r.grown_shard != r.shard]
    assert moved and all(r.grown_shard == 24 for r in moved)
    assert abs(len(moved) - 5000 / 25) < 5 * math.sqrt(5000 / 25)
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) < 8 * math.sqrt(5000 / 24)


def test_weights_confine_movement(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'' as text")
    before = {r.doc_id: r.shard for r in m.assign(df, 8, [1.0] * 8, grow=False).collect()}
    after = {r.doc_id: r.shard for r in m.assign(df, 8, [1.0] * 5 + [3.0] + [1.0] * 2, grow=False).collect()}
    assert all(after[i] == before[i] or after[i] == 5 for i in before)
    assert sum(after[i] == 5 for i in after) > sum(before[i] == 5 for i in before)


def test_hot_key_is_spread(spark):
    df = spark.createDataFrame([(-7, "same")] * 3000 + [(i, "x") for i in range(3000)], "doc_id long, text string")
    got = m.assign(df).collect()
    hot = sorted(r.slot for r in got if r.doc_id == -7)
    assert len(hot) == 3000 and len(set(hot)) == 3000


def test_empty_table(spark):
    assert m.assign(spark.createDataFrame([], COLS)).collect() == []
