"""Minimiser positions of word sequences, and pairs of documents with their texts; used by both passage finders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import words as W


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, key: rows that repeat id and text have one key; null text counts as empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def word_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end character (in its text) of every word, and each text's first word.

    Words are runs without white space, A-Z in lower case.
    """
    cp, at = W.codes(texts)
    cp = W.ascii_lower(cp)
    starts, ends = W.runs(W.not_space(cp))
    doc = np.searchsorted(at, starts, "right") - 1
    return W.run_hashes(cp, starts, ends), doc, starts - at[doc], ends - at[doc], np.searchsorted(doc, np.arange(len(texts) + 1))


def least_grams(hashes: np.ndarray, doc: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window of ``w`` word k-grams of one text, position of its least gram (the first of equals; these
    never fall), and all k-gram hashes."""
    n = len(hashes) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    grams = W.run_hashes(hashes, at, at + k)
    windows = n - w + 1
    best, where = grams[:windows].copy(), at[:windows].copy()
    for j in range(1, w):
        less = grams[j:j + windows] < best
        best[less], where[less] = grams[j:j + windows][less], at[j:j + windows][less]
    whole = np.flatnonzero(doc[:windows] == doc[w + k - 2:])
    return whole, where[whole], grams


def minimisers(hashes: np.ndarray, doc: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that are the least of some window of ``w`` word k-grams of one text (the first of equals), and
    all k-gram hashes. Two texts that share w + k - 1 words in a row share such a position there."""
    _, where, grams = least_grams(hashes, doc, k, w)
    return np.unique(where), grams


def per_slice(make: Callable[[list[str]], Iterator[tuple]], names: list[str], types: list[pa.DataType]):
    """mapInArrow function over (key, text): make(texts) gives text numbers and columns, which get the key before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array(batch.column(0))
            for first, part in W.slices(batch.column(1).to_pylist()):
                doc, *cols = make(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[first + doc], pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["key", *names])
    return run


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of keys with id_a, text_a, id_b, text_b. The first text travels with its pair, so each pair is moved once."""
    texts = docs.select("key", "doc_id", "text").join(
        pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"])
    for c in "ab":
        pairs = pairs.join(texts.select(F.col("key").alias(c), F.col("doc_id").alias(f"id_{c}"), F.col("text").alias(f"text_{c}")), c)
    return pairs


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (key, doc_id, start, end, other_id) of a text as one: doc_id, start, end, other_id.

    A text's spans are no more than twice its anchors. The other_id is the least of the spans that were joined.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = None
                for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                    if now and s["start"] <= now[2]:
                        known = [x for x in (now[3], s["other_id"]) if x is not None]
                        now = (doc, now[1], max(now[2], s["end"]), min(known, default=None))
                    else:
                        rows += [now] if now else []
                        now = (doc, s["start"], s["end"], s["other_id"])
                rows += [now] if now else []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "end", "other_id"])

    grouped = spans.groupBy("key", "doc_id").agg(F.collect_set(F.struct("start", "end", "other_id")).alias("spans"))
    return grouped.select("doc_id", "spans").mapInArrow(run, "doc_id long, start long, end long, other_id long")
