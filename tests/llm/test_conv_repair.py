import hashlib
import zlib

import duckdb

from gradeloom.llm import conv_repair as m

SF = "/root/testdata/sf0.001"


def best_by_bellman_ford(roles, texts):
    """Least (cost, audit) to the end from every node by plain relaxation, with no prices: the brute force."""
    arcs = m.lattice(roles, m.faults(roles, texts))
    end = len(arcs) - 1
    best = [None] * len(arcs)
    best[end] = (0, "")
    changed = True
    while changed:
        changed = False
        for v in range(end):
            for j, w, letter, _ in arcs[v]:
                if best[j] is not None:
                    cand = (w + best[j][0], letter + best[j][1])
                    if best[v] is None or cand < best[v]:
                        best[v], changed = cand, True
    return best[0]


def damaged_in_python(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        d = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        role = "user" if d == 4 else role
        out.setdefault(conv, []).extend([(turn, role, text)] * (2 if d == 3 else 1))
    return out


def test_auction_equals_relaxation_on_the_table():
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall()
    for conv, turns in damaged_in_python(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1], t[2]))
        roles, texts = [t[1] for t in turns], [t[2] for t in turns]
        got = m.repair_one(conv, [t[0] for t in turns], roles, texts)
        assert (got["cost"], got["audit"]) == best_by_bellman_ford(roles, texts)


def test_small_cases():
    one = m.repair_one(1, [0, 1], ["user", "assistant"], ["Hi.", "Hello."])
    assert (one["cost"], one["audit"], one["illegal"]) == (0, "KK", 0)
    assert one["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest()
    two = m.repair_one(2, [0, 1, 2], ["user", "user", "tool"], ["Hi.", "Hi.", "x"])
    # the duplicate goes (2); then "x" (truncated) as assistant costs 1 + 5, so deleting all three (6) is cheapest
    assert (two["duplicate"], two["truncated"], two["cost"], two["audit"]) == (1, 1, 6, "DDD")
    assert two["illegal"] == 2
    three = m.repair_one(3, [None, 5], ["system", "system"], ["   ", "Rules."])
    # the blank row goes; a lone system row is not accepted: deleting it (2) beats rerole and insert (6)
    assert (three["blank"], three["gaps"], three["cost"], three["audit"]) == (1, 0, 4, "DD")
    assert m.repair_one(4, [], [], [])["repaired_sha256"] == m.EMPTY_SHA
    lone = m.repair_one(5, [3], ["system"], ["Be kind."])
    assert (lone["cost"], lone["audit"]) == (2, "D")  # s alone is not accepted; delete 2 beats two inserts 10


def test_long_conversation():
    n = 3000
    roles = ["user" if i % 3 else "assistant" for i in range(n)]
    texts = [f"Turn {i % 50}." for i in range(n)]
    got = m.repair_one(9, list(range(n)), roles, texts)
    assert len(got["audit"]) >= n
    short = m.repair_one(9, list(range(300)), roles[:300], texts[:300])
    assert (short["cost"], short["audit"]) == best_by_bellman_ford(roles[:300], texts[:300])


def test_query_covers_every_conversation(spark):
    data = [(1, 0, "user", "Hello there."), (1, 1, None, None), (1, None, "assistant", "Hi."),
            (2, 0, "user", "x"), (None, 3, "user", "Who?"), (None, 4, "assistant", "Me.")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in m.repair(df.withColumn("cost", df.turn)).collect()}
    assert set(got) == {1, 2, None}
    for conv, turns in damaged_in_python(data).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] if t[0] is not None else 0, t[1], t[2]))
        want = m.repair_one(conv, [t[0] for t in turns], [t[1] for t in turns], [t[2] for t in turns])
        assert got[conv].asDict() == want
    for conv in {1, 2, None} - set(damaged_in_python(data)):
        assert (got[conv].cost, got[conv].audit, got[conv].repaired_sha256) == (0, "", m.EMPTY_SHA)


def test_empty_table(spark):
    assert m.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
