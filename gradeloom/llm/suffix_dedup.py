"""Repeated passages by sparse suffix arrays.

Only suffixes that start at minimiser positions are counted (windows of ``WINDOW`` grams of ``GRAM`` words: a passage of
``min_words`` in two places has one of them in both). Those whose first gram occurs once fall out after a
narrow count. Around the others, every window of ``min_words`` words that has the gram as its least one is sorted by
content, range-partitioned over the cluster, ties by document and position, so a passage that a third of all documents share
is split like any other. Equal windows are neighbours whatever stands around them: neighbours are compared, and along their
diagonal all runs of equal words of at least ``min_words`` are found, which extends the match to the left and to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import words as W
from gradeloom.llm.anchors import keyed, least_grams, merged, minimisers, per_slice, with_texts, word_table
from gradeloom.llm.storage import scratch, stored

MIN_WORDS = 50
GRAM = 32


def _suffixes(window: int):
    def make(texts: list[str]):
        hashes, doc, _, _, first = word_table(texts)
        at, grams = minimisers(hashes, doc, GRAM, window)
        return doc[at], grams[at].view(np.int64), at - first[doc[at]]
    return per_slice(make, ["gram", "pos"], [pa.int64()] * 2)


def _windows(window: int):
    """(key, text, positions of repeated grams): hash and start of every window whose least gram is one of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = np.array(batch.column(0)), batch.column(2)
            for first_row, part in W.slices(batch.column(1).to_pylist()):
                hashes, doc, _, _, first = word_table(part)
                own = at.slice(first_row, len(part))
                repeated = np.zeros(len(hashes) + 1, bool)
                repeated[np.repeat(first[:-1], np.array(own.value_lengths())) + np.array(own.flatten())] = True
                starts, where, _ = least_grams(hashes, doc, GRAM, window)
                starts = starts[repeated[where]]
                whole = W.run_hashes(hashes, starts, starts + window + GRAM - 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (
                    whole.view(np.int64), keys[first_row + doc[starts]], starts - first[doc[starts]])], ["whole", "key", "pos"])
    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive windows with one hash as pairs; the ends of the partition come with its number."""
    names = ["whole", "a", "pos_a", "b", "pos_b", "part"]
    part, first, last = TaskContext.get().partitionId(), None, None

    def out(whole, a, pos_a, b, pos_b, number):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (whole, a, pos_a, b, pos_b, number)], names)

    for batch in batches:
        whole, key, pos = (np.array(batch.column(i)) for i in range(3))
        if not len(whole):
            continue
        first = first or (whole[0], key[0], pos[0])
        if last:
            whole, key, pos = (np.concatenate([[x], y]) for x, y in zip(last, (whole, key, pos), strict=True))
        last = (whole[-1], key[-1], pos[-1])
        same = np.flatnonzero(whole[1:] == whole[:-1])
        yield out([None] * len(same), key[same], pos[same], key[same + 1], pos[same + 1], [None] * len(same))
    if first:
        yield out([first[0], last[0]], [None, last[1]], [None, last[2]], [first[1], None], [first[2], None], [part, part])


def _sorted_pairs(windows: DataFrame) -> DataFrame:
    order = ["whole", "key", "pos"]
    ranged = windows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(
        _neighbours, "whole long, a long, pos_a long, b long, pos_b long, part long"))
    inner = found.filter("part is null").select("a", "pos_a", "b", "pos_b")
    # Where one partition ends and the next one that has rows begins: two rows for each partition.
    ends, starts = (found.filter(f"part is not null and {c} is not null") for c in "ab")
    used = sorted(r.part for r in starts.select("part").collect())
    following = found.sparkSession.createDataFrame(list(zip(used, used[1:], strict=False)), "part long, next long")
    across = ends.select("whole", "a", "pos_a", "part").join(following, "part").join(
        starts.select(F.col("whole").alias("w"), "b", "pos_b", F.col("part").alias("next")), "next").filter("whole = w")
    return inner.unionByName(across.select("a", "pos_a", "b", "pos_b"))


def _extend(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, shift, id_a, text_a, id_b, text_b in zip(*(batch[c].to_pylist() for c in (
                    "a", "b", "shift", "id_a", "text_a", "id_b", "text_b")), strict=True):
                x, _, xs, xe, _ = word_table([text_a])
                y, _, ys, ye, _ = word_table([text_b])
                lo, hi = max(0, shift), min(len(x), len(y) + shift)
                starts, ends = W.runs(x[lo:hi] == y[lo - shift:hi - shift])
                for s, e in zip(starts + lo, ends + lo, strict=True):
                    if e - s >= min_words:
                        rows.append((a, id_a, xs[s], xe[e - 1], id_b))
                        rows.append((b, id_b, ys[s - shift], ye[e - shift - 1], id_a))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "doc_id", "start", "end", "other_id"])
    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, other_id: passages of at least ``min_words`` words that stand elsewhere, too, in this text or in others.

    Offsets are code points, end exclusive; passages of a text that overlap are one row. other_id is a document that
    holds a part of it. Words are runs without white space, A-Z in lower case. Rows that repeat id and text
    are one document; null ids stay null; null, empty and shorter texts have no passages; other columns are ignored.
    """
    if min_words < GRAM:
        raise ValueError(f"min_words must be at least {GRAM}")
    with scratch(docs.sparkSession) as keep:
        own = keyed(docs)
        window = min_words - GRAM + 1
        rows = own.select("key", "text").mapInArrow(_suffixes(window), "key long, gram long, pos long")
        often = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram")
        at = stored(rows.join(often, "gram").groupBy("key").agg(F.collect_set("pos").alias("at")))
        texts = own.select("key", "text").join(at.select("key"), "key", "left_semi").dropDuplicates(["key"]).join(at, "key")
        windows = stored(texts.select("key", "text", "at").mapInArrow(_windows(window), "whole long, key long, pos long"))
        pairs = _sorted_pairs(windows)
        # One pair of documents and diagonal once, whatever the number of shared suffixes.
        swap = F.col("a") > F.col("b")
        pairs = stored(pairs.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.when(swap, F.col("pos_b") - F.col("pos_a")).otherwise(F.col("pos_a") - F.col("pos_b")).alias("shift"))
            .filter("a <> b or shift <> 0").distinct())
        spans = with_texts(pairs, own).mapInArrow(_extend(min_words), "key long, doc_id long, start long, end long, other_id long")
        return keep(merged(stored(spans)))
