"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks of ``SPAN`` words look at 8 of 12 positions, so a hit survives substitutions at the others. The
hashes of all windows of the benchmark and of all documents meet in a join; along the diagonal of each hit the
item is laid over the document and compared word by word, and the best local stretch (a word that agrees
counts 1, one that differs -2) is the overlap. Items shorter than the span are looked up as they stand.

Each document becomes hashes, then hits, without moving its text; only the few hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.storage import scratch, stored

SPAN = 12
# The positions that count, a mask a row.
MASKS = ("110110011101", "111010010111", "101101101101")
MIN_WORDS = 10
SIMILARITY = 0.8
BROADCAST_SEEDS = 2_000_000  # rows of 24 bytes


def _words(text: str) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(lengths: list[int]) -> tuple[list[F.Column], dict[int, F.Column]]:
    """Hashes of the windows that start at word ``i`` of ``words``; null where a window passes the end:
    one for each mask, and one for each length of a short item."""
    word = lambda o: F.get("words", F.col("i") + o)
    room = F.size("words") - F.col("i")
    spaced = [F.when(room >= SPAN, F.xxhash64(F.lit(m), *[word(o) for o, c in enumerate(mask) if c == "1"]))
              for m, mask in enumerate(MASKS)]
    return spaced, {n: F.when(room >= n, F.xxhash64(F.lit(-n), *[word(o) for o in range(n)])) for n in lengths}


def _positions(df: DataFrame, *cols: str) -> DataFrame:
    return df.filter(F.size("words") > 0).select(*cols, "words", F.explode(F.expr("sequence(0, size(words) - 1)")).alias("i"))


def contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS,
                  similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, doc_hash, item_id, matched_words, overlap_words, similarity, doc_word, item_word: one row for
    each document (doc_id and text) and item whose best stretch has ``min_words`` agreeing words (or all of
    a shorter item's) and at least ``similarity`` of its words equal.

    Words are runs of letters and digits in lower case. Null and empty texts or items match nothing; null ids
    are ids like any other; repeated rows and items are found once; an item that stands in several places
    reports the best, the first of equals. Other columns are ignored.
    """
    with scratch(docs.sparkSession) as keep:
        items = stored(benchmark.select("item_id", _words("text").alias("words")).filter(F.size("words") > 0)
                       .distinct().withColumn("item_key", F.xxhash64("item_id", "words")))
        # At most SPAN - 1 numbers.
        lengths = sorted(r[0] for r in items.filter(F.size("words") < SPAN).select(F.size("words")).distinct().collect())
        spaced, short = _seeds(lengths)
        own = F.array(*spaced, *[F.when((F.size("words") == n) & (F.col("i") == 0), h) for n, h in short.items()])
        seeds = stored(_positions(items, "item_key")
                       .select("item_key", F.size("words").alias("n_item"), F.col("i").alias("j"), F.explode(own).alias("seed"))
                       .filter("seed is not null"))
        small = F.broadcast if seeds.count() <= BROADCAST_SEEDS else (lambda df: df)

        body = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), _words("text").alias("words"))
        at = _positions(body, "doc_id", "doc_hash").select(
            "doc_id", "doc_hash", "words", "i", F.explode(F.array(*spaced, *short.values())).alias("seed")).filter("seed is not null")
        shift = F.col("i") - F.col("j")
        hits = (at.join(small(seeds), "seed")
                .select("doc_id", "doc_hash", "item_key", shift.alias("shift"),
                        F.slice("words", F.greatest(shift, F.lit(0)) + 1,
                                F.col("n_item") + F.least(shift, F.lit(0))).alias("window"))
                .distinct())
        laid = hits.join(small(items), "item_key").withColumn("skip", F.greatest(-F.col("shift"), F.lit(0)))
        equal = F.zip_with("window", F.slice("words", F.col("skip") + 1, F.size("window")), lambda a, b: a == b)
        best = laid.select("doc_id", "doc_hash", "item_id", "shift", "skip", F.size("words").alias("n_item"),
                           _best_stretch(equal).alias("best"))
        needed = F.least(F.lit(min_words), F.col("n_item"))
        length = F.col("best.till") - F.col("best.since")
        found = best.select(
            "doc_id", "doc_hash", "item_id", F.col("best.hits").alias("matched_words"), length.alias("overlap_words"),
            (F.col("best.hits") / F.greatest(length, F.lit(1))).alias("similarity"),
            (F.col("skip") + F.col("best.since")).alias("item_word"),
            (F.col("shift") + F.col("skip") + F.col("best.since")).alias("doc_word"), needed.alias("needed")).filter(
                (F.col("matched_words") >= F.col("needed")) & (F.col("similarity") >= similarity))
        order = F.struct("matched_words", "similarity", -F.col("doc_word"), "overlap_words", "item_word", "doc_word")
        return keep(found.groupBy("doc_id", "doc_hash", "item_id").agg(F.max(order).alias("m")).select(
            "doc_id", "doc_hash", "item_id", "m.matched_words", "m.overlap_words", "m.similarity", "m.doc_word", "m.item_word"))


def _best_stretch(equal: F.Column) -> F.Column:
    """The stretch with the greatest score, the first of equals: one pass over the flags."""
    zero = F.expr("named_struct('i', 0, 'score', 0, 'since', 0, 'hits', 0, "
                  "'best', named_struct('score', 0, 'since', 0, 'till', 0, 'hits', 0))")

    def step(s, e):
        fresh = s["score"] <= 0
        score = F.when(fresh, 0).otherwise(s["score"]) + F.when(e, 1).otherwise(-2)
        since = F.when(fresh, s["i"]).otherwise(s["since"])
        hits = F.when(fresh, 0).otherwise(s["hits"]) + F.when(e, 1).otherwise(0)
        now = F.struct(score.alias("score"), since.alias("since"), (s["i"] + 1).alias("till"), hits.alias("hits"))
        return F.struct((s["i"] + 1).alias("i"), score.alias("score"), since.alias("since"), hits.alias("hits"),
                        F.when(score > s["best"]["score"], now).otherwise(s["best"]).alias("best"))

    return F.aggregate(equal, zero, step, lambda s: s["best"])


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, columns unchanged."""
    gone = contamination(docs, benchmark).select(F.col("doc_id").alias("gone_id"), F.col("doc_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_hash")), "left_anti")
