"""Conversation structure repair: damage, audit, and the cheapest edits found by the auction shortest-path algorithm.

``damage`` changes rows by ``crc32('conv_id:turn') % 20`` (a null conv_id, turn, role or text is one space there):
0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it next to itself (same turn),
4 sets its role to ``user``. Each conversation's damaged rows, ordered by turn (nulls first, then role and text), are
audited and repaired in one task (partitions hashed by conversation and sorted, many conversations a Pandas call):
a conversation is the unit of its sequence of edits.

Audit: a row's first fault counts, in this order: blank (no character outside space, tab and line ends), duplicate
(its role and text stand in an earlier row), truncated (its last such character is not ``.``, ``!`` or ``?``);
``illegal`` counts adjacent pairs whose role initials are not ``su``, ``ua`` or ``au``.

Repair: the result's role initials must read ``(s?(ua)+)?``. The lattice has a node for (rows read, state of that
pattern) and arcs for the edits: Keep (0), Rerole to user or assistant (1), Delete (2; the only edit of a blank or
duplicate row), Insert an empty user or assistant row (5); a truncated row that stays adds 5. Every cycle of the
lattice costs more than 0 (inserts only), so the auction algorithm applies: a path grows from an origin by its tightest
arc, or contracts while it raises the price of its end. Run from every node, last rows first, the prices reach the
exact cost to the end; arcs whose cost equals the difference of prices are tight, and from the first node the audit
takes the tight arc of the ASCII-least initial each time (ending beats every letter). In every state of the pattern
at most one of ``u`` and ``a`` fits, so a letter names one arc and the audit names one repair.

Defined cases: a conversation without rows after damage gives zeros, an empty audit and the hash of no text; rows
with a null conv_id are one conversation of id null; ``gaps`` ignores null turns (all null: 0); extra columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract: costs of the edits and the accepted pairs of role initials.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = {"su", "ua", "au"}
ENDS = ".!?"
SPACE = " \t\n\x0b\x0c\r"
# states of (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = {0, 3}
ROLE = {"u": "user", "a": "assistant"}

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")

OUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
       "repaired_sha256 string")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def damage(conversations: DataFrame) -> DataFrame:
    """The damaged rows: conv_id, turn, role, text (nulls of role and text are one space)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    d = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    return (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text"), d.alias("_d"))
            .where(F.col("_d") != 0)
            .select("conv_id", "turn",
                    F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1))).alias("_copy"))
            .drop("_copy"))


def faults(roles: list[str], texts: list[str]) -> list[str | None]:
    """Each row's first fault: 'blank', 'duplicate', 'truncated' or None."""
    seen, out = set(), []
    for role, text in zip(roles, texts):
        if not _VISIBLE.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif text.rstrip(SPACE)[-1] not in ENDS:
            out.append("truncated")
        else:
            out.append(None)
        seen.add((role, text))
    return out


def lattice(roles: list[str], fault: list[str | None]) -> list[list[tuple[int, int, str, str | None]]]:
    """Arcs (target, cost, edit initial, role written) of every node ``4 * rows read + state``; the last node is the end."""
    n = len(roles)
    end = 4 * (n + 1)
    arcs: list[list[tuple[int, int, str, str | None]]] = [[] for _ in range(end + 1)]
    for i in range(n + 1):
        for q in range(4):
            here = arcs[4 * i + q]
            if i == n and q in ACCEPT:
                here.append((end, 0, "", None))
            for c in "ua":
                if (q, c) in STEP:
                    here.append((4 * i + STEP[q, c], INSERT, "I", ROLE[c]))
            if i == n:
                continue
            here.append((4 * (i + 1) + q, DELETE, "D", None))
            if fault[i] in ("blank", "duplicate"):
                continue
            extra = TRUNCATED if fault[i] == "truncated" else 0
            if (q, roles[i][:1]) in STEP:
                here.append((4 * (i + 1) + STEP[q, roles[i][:1]], KEEP + extra, "K", roles[i]))
            for c in "ua":
                if (q, c) in STEP:
                    here.append((4 * (i + 1) + STEP[q, c], REROLE + extra, "R", ROLE[c]))
    return arcs


def auction_prices(arcs: list[list[tuple[int, int, str, str | None]]]) -> list[int]:
    """Prices equal to each node's least cost to the end: the auction algorithm, run from every node, last first.

    The path grows by the arc of least cost plus price while that equals its end's price (the arc is tight), else the
    end's price rises to that least value and the path contracts. Prices stay below true costs and tight along the
    path; when the path reaches the end, its origin's price is exact. Prices carry over between origins.
    """
    end = len(arcs) - 1
    price = [0] * (end + 1)
    for origin in range(end - 1, -1, -1):
        path = [origin]
        while path[-1] != end:
            i = path[-1]
            best, to = min((w + price[j], j) for j, w, _, _ in arcs[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def trace(arcs, price) -> tuple[str, list[tuple[int | None, str]]]:
    """The ASCII-least audit over tight arcs from the first node, and the rows it writes (row index or None, role)."""
    end = len(arcs) - 1
    node, audit, written = 0, [], []
    while node != end:
        j, _, letter, role = min((a for a in arcs[node] if a[1] + price[a[0]] == price[node]), key=lambda a: a[2])
        if letter in ("K", "R"):
            written.append((node // 4, role))
        elif letter == "I":
            written.append((None, role))
        audit.append(letter)
        node = j
    return "".join(audit), written


def repair_one(conv_id, turns: list, roles: list[str], texts: list[str]) -> dict:
    """Audit and repair of one conversation's damaged rows, in order."""
    fault = faults(roles, texts)
    initials = [r[:1] for r in roles]
    arcs = lattice(roles, fault)
    price = auction_prices(arcs)
    audit, written = trace(arcs, price)
    lines = [f"{role}:{'' if i is None else texts[i]}" for i, role in written]
    known = [t for t in turns if t is not None and not pd.isna(t)]
    return {
        "conv_id": conv_id,
        "gaps": int(max(known) - min(known) + 1 - len(set(known))) if known else 0,
        "blank": fault.count("blank"), "duplicate": fault.count("duplicate"), "truncated": fault.count("truncated"),
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
        "cost": price[0], "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def _repair_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``repair_one`` of every conversation of a partition sorted by conversation and turn; a conversation cut by a
    batch end waits for the rest of its rows."""
    pending = None
    for batch in batches:
        if pending is not None:
            batch = pd.concat([pending, batch], ignore_index=True)
        if not len(batch):
            continue
        key = list(zip(batch["conv_id"].isna(), batch["conv_id"].fillna(0)))
        starts = [0] + [i for i in range(1, len(key)) if key[i] != key[i - 1]]
        done = [_one(batch.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        pending = batch.iloc[starts[-1]:].reset_index(drop=True)
        if done:
            yield pd.DataFrame(done)
    if pending is not None and len(pending):
        yield pd.DataFrame([_one(pending)])


def _one(rows: pd.DataFrame) -> dict:
    conv = rows["conv_id"].iloc[0]
    turns = [None if pd.isna(t) else int(t) for t in rows["turn"]]
    return repair_one(None if pd.isna(conv) else int(conv), turns, list(rows["role"]), list(rows["text"]))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation of the input (``OUT``), also for those that damage empties."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    # a conversation stays whole in one task; many are repaired in one Pandas call
    hit = damage(conversations).repartition("conv_id").sortWithinPartitions(*order).mapInPandas(_repair_sorted, OUT)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = ids.join(hit.withColumnRenamed("conv_id", "_c"), ids["conv_id"].eqNullSafe(F.col("_c")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
