"""Conversation prefix trie by burst tries: containers of suffixes under trie heads, burst by the next turn id.

``rebuild`` orders each conversation's turns by turn (nulls first, then role and text; null role or text is empty)
and rebuilds conversation ``c`` from the first ``h`` turns of conversation ``c - c % 20`` (all if fewer, none if it
is absent) and then ``c``'s own turns after its first ``h``, with ``h = crc32(decimal c) % 4``.

A turn's id is ``xxhash64(role, text)``; a node's key is ``xxhash64(parent key, turn id)`` from the root's 0, so a
conversation's node of depth d is the chain over its first d ids (64 bits; two different prefixes share a key with
probability about nodes^2 / 2^65). The trie is built in Spark:

1. Every conversation starts as a suffix (its whole id sequence) in the root's container. Equal suffixes under one
   head are one row with a multiplicity and their least conv_id, so thousands of copies weigh as one.
2. A container holding more than ``CONTAINER_TURNS`` suffix turns (and more than one distinct suffix) bursts: its
   head becomes a trie head, whose counts come from one aggregation, and each suffix moves under the child head of
   its next turn id, one turn shorter. Rounds repeat until no container is over the bound; each round's state is
   written to the shared folder.
3. Each remaining container is swept in one task (partitions sorted by head, many containers a Pandas call): its
   suffixes are sorted and swept once, a stack
   holding the open path; the sweep gives every node below and at the container's head its members, least member,
   children and subtree sums.
4. Subtree sums of trie heads add the sums of their containers and trie heads below, found through the list of
   trie heads each container carries; conversations that end at a node are hashed in conv_id order by a streaming
   pass over rows sorted by node, in bounded memory.

Output per node (all long but the hash): conv_id (least member), depth, parent_conv_id (null at the root), n_convs,
n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its subtree, each node's
``(n_convs - 1) * words of its last text``; words are runs of characters other than space, tab and line ends),
ends_sha256 (SHA-256 of the ids of conversations that end there, ascending, comma-joined; none: of no text).

Defined cases: rows with a null conv_id belong to no conversation; a conversation with no turns is a member of the
root only; an empty table gives no nodes; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.storage import scratch, stored

CONTAINER_TURNS = 100_000
FAMILY, PREFIX_CHOICES = 20, 4  # fixed values of the rebuild
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, key long, path array<long>")
_MASK = (1 << 64) - 1


def chain(parent: int, turn_id: int) -> int:
    """Spark's ``xxhash64(parent, turn_id)`` of two longs, as a signed long."""
    seed = xxhash.xxh64_intdigest(struct.pack("<q", parent), seed=42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", turn_id), seed=seed)
    return h - (1 << 64) if h >> 63 else h


def words(text) -> F.Column:
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))


def rebuild(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, ids (turn ids in order), n_words (of each turn), end (its node's key)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = rows.select("conv_id", F.row_number().over(by_turn).alias("k"),
                      F.xxhash64("role", "text").alias("tid"), words(F.col("text")).alias("w"))
    ids = rows.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIX_CHOICES).alias("h"))
    lengths = own.groupBy(F.col("conv_id").alias("base")).agg(F.max("k").alias("base_len"))
    ids = ids.join(lengths, "base", "left").withColumn(
        "n_base", F.least(F.col("h"), F.coalesce(F.col("base_len"), F.lit(0))))
    head = ids.join(own.withColumnRenamed("conv_id", "base"), "base").where(F.col("k") <= F.col("h"))
    tail = ids.drop("base").join(own, "conv_id").where(F.col("k") > F.col("h")).withColumn(
        "k", F.col("n_base") + F.col("k") - F.col("h"))
    turns = head.select("conv_id", "k", "tid", "w").unionByName(tail.select("conv_id", "k", "tid", "w"))
    seqs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "tid", "w"))).alias("t"))
    out = ids.select("conv_id").join(seqs, "conv_id", "left").select(
        "conv_id", F.coalesce(F.col("t.tid"), F.array().cast("array<long>")).alias("ids"),
        F.coalesce(F.col("t.w"), F.array().cast("array<int>")).alias("n_words"))
    return out.withColumn("end", F.aggregate("ids", F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))


def _sweep(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of one container, from its head down, by one pass over its sorted suffixes."""
    first = rows.iloc[0]
    head_path = list(first["path"]) if first["path"] is not None else []
    order = sorted(range(len(rows)), key=lambda i: tuple(rows["suf"].iat[i]))
    nodes: list[dict] = []

    def open_node(key, depth, parent, n_words):
        node = {"key": key, "depth": depth, "parent": parent, "n": 0, "min": None, "children": 0,
                "leaves": 0, "saved": 0, "words": n_words}
        if parent is not None:
            parent["children"] += 1
        nodes.append(node)
        return node

    def close(node):
        node["saved"] += (node["n"] - 1) * node["words"]
        node["leaves"] += node["children"] == 0
        if node["parent"] is not None:
            node["parent"]["leaves"] += node["leaves"]
            node["parent"]["saved"] += node["saved"]

    root = open_node(int(first["head"]), int(first["depth"]), None, int(first["head_words"]))
    stack, prev = [root], ()
    for i in order:
        suf, sw = tuple(int(x) for x in rows["suf"].iat[i]), rows["sw"].iat[i]
        common = 0
        while common < min(len(prev), len(suf)) and prev[common] == suf[common]:
            common += 1
        while len(stack) > common + 1:
            close(stack.pop())
        for j in range(common, len(suf)):
            stack.append(open_node(chain(stack[-1]["key"], suf[j]), root["depth"] + j + 1, stack[-1], int(sw[j])))
        mult, least = int(rows["mult"].iat[i]), int(rows["min_conv"].iat[i])
        for node in stack:
            node["n"] += mult
            node["min"] = least if node["min"] is None else min(node["min"], least)
        prev = suf
    while stack:
        close(stack.pop())
    parent_min = first["parent_min"]
    return pd.DataFrame({
        "conv_id": [n["min"] for n in nodes], "depth": [n["depth"] for n in nodes],
        "parent_conv_id": [(None if pd.isna(parent_min) else int(parent_min)) if n["parent"] is None else n["parent"]["min"]
                           for n in nodes],
        "n_convs": [n["n"] for n in nodes], "n_children": [n["children"] for n in nodes],
        "n_leaves": [n["leaves"] for n in nodes], "saved_tokens": [n["saved"] for n in nodes],
        "key": [n["key"] for n in nodes], "path": [head_path if n["parent"] is None else None for n in nodes],
    }).astype({"parent_conv_id": "Int64"})


def _sweep_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``_sweep`` of every container of a partition sorted by head; a container cut by a batch end waits for the rest."""
    pending = None
    for batch in batches:
        if pending is not None:
            batch = pd.concat([pending, batch], ignore_index=True)
        heads = batch["head"].to_numpy()
        if not len(heads):
            continue
        starts = np.concatenate([[0], np.flatnonzero(heads[1:] != heads[:-1]) + 1])
        done = [_sweep(batch.iloc[a:b]) for a, b in zip(starts[:-1], starts[1:])]
        pending = batch.iloc[starts[-1]:].reset_index(drop=True)
        if done:
            yield pd.concat(done, ignore_index=True)
    if pending is not None and len(pending):
        yield _sweep(pending)


def _ends_digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of ascending conv_ids per node key, over rows sorted by (key, conv_id): one key at a time in memory."""
    key, digest, out = None, None, {"key": [], "ends_sha256": []}
    for batch in batches:
        for k, c in zip(batch["end"].tolist(), batch["conv_id"].tolist()):
            if k != key:
                if digest is not None:
                    out["key"].append(key)
                    out["ends_sha256"].append(digest.hexdigest())
                key, digest = k, hashlib.sha256(str(c).encode())
            else:
                digest.update(b"," + str(c).encode())
        if len(out["key"]) >= 10_000:
            yield pd.DataFrame(out)
            out = {"key": [], "ends_sha256": []}
    if digest is not None:
        out["key"].append(key)
        out["ends_sha256"].append(digest.hexdigest())
    yield pd.DataFrame(out)


def prefix_trie(conversations: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see the module's text)."""
    spark = conversations.sparkSession
    with scratch(spark) as keep:
        convs = stored(rebuild(conversations))
        state = stored(convs.groupBy("end").agg(
            F.first("ids").alias("suf"), F.first("n_words").alias("sw"), F.count("*").alias("mult"),
            F.min("conv_id").alias("min_conv")).select(
            F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_min"), F.array().cast("array<long>").alias("path"),
            F.lit(0).cast("long").alias("head_words"), "suf", "sw", "mult", "min_conv"))
        heads = []
        while True:
            sizes = state.groupBy("head").agg(F.sum(F.size("suf") + 1).alias("size"), F.count("*").alias("n"))
            over = sizes.where((F.col("size") > container_turns) & (F.col("n") > 1)).select("head")
            if over.isEmpty():
                break
            hot = state.join(over, "head", "left_semi")
            burst = stored(hot.groupBy("head").agg(
                F.first("depth").alias("depth"), F.first("parent_min").alias("parent_min"),
                F.first("path").alias("path"), F.first("head_words").alias("head_words"),
                F.sum("mult").alias("n_convs"), F.min("min_conv").alias("least"),
                F.count_distinct(F.when(F.size("suf") > 0, F.col("suf")[0])).alias("n_children")))
            heads.append(burst)
            moved = hot.where(F.size("suf") > 0).join(burst.select("head", "least"), "head").select(
                F.xxhash64("head", F.col("suf")[0]).alias("head"), (F.col("depth") + 1).alias("depth"),
                F.col("least").alias("parent_min"), F.concat("path", F.array("head")).alias("path"),
                F.col("sw")[0].cast("long").alias("head_words"),
                F.slice("suf", 2, F.size("suf") - 1).alias("suf"), F.slice("sw", 2, F.size("sw") - 1).alias("sw"),
                "mult", "min_conv")
            state = stored(state.join(over, "head", "left_anti").unionByName(moved))
        # containers stay whole in one task (each is bounded); many are swept in one call
        nodes = stored(state.repartition("head").sortWithinPartitions("head").mapInPandas(_sweep_sorted, NODES))
        tops = nodes.where(F.col("path").isNotNull())
        found = nodes.drop("path")
        if heads:
            burst = heads[0]
            for more in heads[1:]:
                burst = burst.unionByName(more)
            own = burst.select("head", "path", (F.col("n_children") == 0).cast("long").alias("leaf"),
                               ((F.col("n_convs") - 1) * F.col("head_words")).alias("own"))
            below = (tops.select(F.explode("path").alias("head"), F.col("n_leaves").alias("leaf"),
                                 F.col("saved_tokens").alias("own"))
                     .unionByName(own.select(F.explode("path").alias("head"), "leaf", "own"))
                     .groupBy("head").agg(F.sum("leaf").alias("below_leaves"), F.sum("own").alias("below_saved")))
            found = found.unionByName(own.join(burst.drop("path"), "head").join(below, "head", "left").select(
                F.col("least").alias("conv_id"), "depth", F.col("parent_min").alias("parent_conv_id"), "n_convs",
                "n_children", (F.col("leaf") + F.coalesce("below_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("own") + F.coalesce("below_saved", F.lit(0))).alias("saved_tokens"), F.col("head").alias("key")))
        ends = (convs.select("end", "conv_id").repartition("end").sortWithinPartitions("end", "conv_id")
                .mapInPandas(_ends_digest, "key long, ends_sha256 string"))
        return keep(found.join(ends, "key", "left").select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
