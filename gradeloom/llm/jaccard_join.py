"""Exact Jaccard self-join of word n-gram sets in metric space.

d = 1 - Jaccard is a metric, and sets link when d <= e. Two linked sets share an element of their prefixes, the
rarest |x| - ceil(t |x|) + 1 elements, so every list of sets with a common prefix element is a place where links may
be. A list holds sets of one size band and those of the band below, which as the smaller ones need fewer prefix elements; and a
pair counts only where the elements after the common one can still make a link. A short list is compared pair by pair. A long
one is split by pivots taken from it:

- Each of its sets goes to the Voronoi region of its nearest pivot, and to every other region whose pivot is at
  most 2e farther: by the triangle inequality both ends of a link meet in a region.
- In a region, sets within e of the pivot (the core) link to it and need no pairs among themselves. For the
  rest the region is joined again in the same way, with each set replaced by its difference to the pivot: a
  link needs |x ^ y| <= c (|x| + |y|), so the two differences overlap, and their sizes, which are distances to the pivot,
  differ by no more than that window. Differences are short, so their prefixes are, too.
- Sets that links connect by then are not compared again: a list or region within one component is done.
- On the last level the lists left are compared pair by pair, so nothing is lost. There, as in all regions, two sets are compared by
  their differences to the pivot, which are shorter: |x ^ y| = |dx ^ dy|.

Frequencies for the element order come from one array of counters over all texts, of fixed size; any order gives
the same links. Elements are 64-bit hashes of the n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import words as W
from gradeloom.llm.components import components
from gradeloom.llm.storage import scratch, small_batches, stored

SKETCH, PART = 1 << 22, 1 << 12  # counters, and how many of them travel together
LIST_MAX = (32, 1024)  # pairs of a list that are compared one by one; the last level has no such limit
BROADCAST_IDS = 500_000
BAND_SLACK = 1e-6  # size bands are wider than the ratio of linked sets by it, so rounding never puts two such sets two bands apart


def text_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted set of word k-gram hashes of each text; a shorter text is one gram, an empty one has none."""
    for _, part in W.slices(texts):
        cp, at = W.codes(part)
        cp = W.ascii_lower(cp)
        starts, ends = W.runs(W.not_space(cp))
        hashes = W.run_hashes(cp, starts, ends)
        doc = np.searchsorted(at, starts, "right") - 1
        grams, of = W.shingles(hashes, doc, k)
        cuts = np.searchsorted(of, np.arange(len(part) + 1))
        word_cuts = np.searchsorted(doc, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = hashes[word_cuts[i]:word_cuts[i + 1]]
            if 0 < len(own) < k:
                h = np.full(1, len(own), np.uint64)
                for w in own:
                    h = W.mix(h * np.uint64(31) + w)
                yield h
            else:
                yield np.unique(grams[cuts[i]:cuts[i + 1]])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % SKETCH  # 24 bits


def _packed(counts: np.ndarray) -> bytes:
    """Counters below 256 take one byte each."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, np.uint8 if len(counts) == PART else np.int32)


def _count(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int32)
        for batch in batches:
            sets = list(text_sets(batch.column(0).to_pylist(), k))
            np.add.at(total, _bucket(np.concatenate([np.zeros(0, np.uint64), *sets])), 1)
        parts = total.reshape(-1, PART)
        used = np.flatnonzero(parts.any(1))
        for some in np.array_split(used, max(1, len(used) // 256)):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_packed(parts[i]) for i in some], pa.binary())],
                                             ["part", "counts"])
    return run


def _add_up(rows: pa.Table) -> pa.Table:
    total = np.zeros(PART, np.int64)
    for c in rows["counts"]:
        total += _unpacked(c.as_py())
    return pa.table({"part": rows["part"][:1], "counts": pa.array([np.minimum(total, 2 ** 31 - 1).astype(np.int32).tobytes()], pa.binary())})


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many (text, gram) pairs fall into each of SKETCH counters."""
    shape = "part long, counts binary"
    rows = docs.select("text").mapInArrow(_count(k), shape).groupBy("part").applyInArrow(_add_up, shape)
    with small_batches(docs.sparkSession):
        table = rows.toArrow()  # SKETCH counters at most
    out = np.zeros((SKETCH // PART, PART), np.int32)
    for part, counts in zip(table["part"].to_pylist(), table["counts"], strict=True):
        out[part] = np.frombuffer(counts.as_py(), np.int32)
    return out.ravel()


def _prefixes(k: int, percent: int, counts):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            n, key, prefix, centre = [], [], [], []
            for s in text_sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest())
                often = counts.value[_bucket(s)]
                take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                order = np.lexsort((s, often))[:take]
                prefix.append(s[order].view(np.int64))
                centre.append(float(often[order[0]]) if len(s) else 0.0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())),
                 pa.array(centre, pa.float64())], ["doc_id", "n", "key", "prefix", "centre"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in text_sets(batch.column(1).to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary()).cast(pa.binary())], ["id", "grams"])
    return run


def _compare(percent: int):
    """Rows a, b, pivot, grams_a, n_a, grams_b, n_b -> linked, distance, and for a pivot b what its region needs of a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, dist, dn, delta_, bytes_, short, deep = [], [], [], [], [], [], []
            n_a, n_b = batch["n_a"].to_pylist(), batch["n_b"].to_pylist()
            a_sets, b_sets, pivots = batch["grams_a"], batch["grams_b"], batch["pivot"].to_pylist()
            for i, pivot in enumerate(pivots):
                x = np.frombuffer(a_sets[i].as_py(), np.uint64)
                p = np.frombuffer(b_sets[i].as_py(), np.uint64)
                delta = np.setxor1d(x, p, True)
                both = (n_a[i] + n_b[i] - len(delta)) // 2
                union = both + len(delta)
                core = both > 0 and 100 * both >= percent * union
                linked.append(core)
                dist.append(1 - both / union if union else 0.0)
                if not pivot:
                    dn.append(0), delta_.append(None), bytes_.append(None), short.append(0), deep.append(0)
                    continue
                m, c = len(delta), (100 - percent) / (100 + percent)
                # With a partner outside the core, |dy| > c (|y| + |p|): at least half of the difference is shared.
                half = (m + c * (len(p) - len(x))) / 2
                # A set outside the core may have a partner in it: |dy| >= m - c (|x| + |y|) and |y| <= |x| / t.
                least = half if core else min(half, m - c * len(x) * (1 + 100 / percent))
                dn.append(m)
                delta_.append(delta.view(np.int64))
                bytes_.append(delta.tobytes())
                short.append(m - max(1, int(np.ceil(half - 1e-9))) + 1 if m else 0)
                deep.append(m - max(1, int(np.ceil(least - 1e-9))) + 1 if m else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], batch["pivot"], pa.array(linked, pa.bool_()), pa.array(dist, pa.float64()),
                 pa.array(dn, pa.int64()), batch["n_a"],
                 pa.array(delta_, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()), pa.array(short, pa.int64()), pa.array(deep, pa.int64())],
                ["a", "b", "pivot", "linked", "dist", "dn", "n", "delta", "bytes", "short", "deep"])
    return run


_COMPARED = ("a long, b long, pivot boolean, linked boolean, dist double, dn long, n long, delta array<long>, bytes binary, "
             "short long, deep long")


# What an element is to its set: in the short prefix of a core set or of another one, or only in the longer prefix
# that sets outside the core need to meet core sets.
CORE, OUTER, DEEP = 0, 1, 2
WHOLE = -(1 << 63)  # the region of the first level, which is all sets and has the empty set as its pivot


def _postings(state: DataFrame) -> DataFrame:
    """region, id, c, h, kind, rank: the prefix elements of each difference, the ones rarest in the region first."""
    elements = state.select("region", "id", "c", "core", "short", "deep", F.explode("delta").alias("h"))
    rare = elements.groupBy("region", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Elements that no other set has can't meet one, but they fill the prefix.
    ranked = elements.join(rare, ["region", "h"], "left").withColumn("rank", F.row_number().over(
        Window.partitionBy("region", "id").orderBy(F.coalesce("n", F.lit(1)), "h")))
    kind = F.when(F.col("rank") > F.col("short"), DEEP).when(F.col("core"), CORE).otherwise(OUTER)
    return ranked.filter("rank <= deep and n > 1").select("region", "id", "c", "h", kind.alias("kind"), "rank")


def _short_pairs(lists: DataFrame, window: float) -> DataFrame:
    """Pairs of each list, without those that are connected already or that the distances to the region's pivot exclude.

    A link's differences share at least (x.dn + y.dn - window * (x.n + y.n)) / 2 elements. In the list of the first one, all
    others come after it in both, so the smaller number of elements that are left after it must do.
    """
    members = lists.groupBy("region", "h").agg(F.sort_array(F.collect_set(F.struct("kind", "id", "c", "dn", "n", "rank"))).alias("l"))
    first = members.select("region", "l", F.posexplode("l").alias("i", "x")).filter(F.col("x.kind") < DEEP)
    pairs = first.select("region", "x", F.explode(F.expr(
        f"filter(slice(l, i + 2, size(l)), y -> y.c <> x.c and (y.kind < {DEEP} or x.kind = {CORE}) "
        f"and abs(x.dn - y.dn) <= {window} * (x.n + y.n) + 1e-9 and abs(x.n - y.n) <= {window} * (x.n + y.n) + 1e-9 "
        f"and x.dn + y.dn - {window} * (x.n + y.n) <= 2 * (1 + least(x.dn - x.rank, y.dn - y.rank)) + 1e-9)")).alias("y"))
    return pairs.select("region", F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).groupBy("a", "b").agg(
        F.min("region").alias("region")).withColumn("pivot", F.lit(False))


def _with_sets(pairs: DataFrame, sets: DataFrame, state: DataFrame | None) -> DataFrame:
    """Pairs with what is to be compared: whole sets, or within a region (the pairs without a pivot) the differences."""
    def joined(rows, side, keys):
        for c in "ab":
            rows = rows.join(side(c), [*keys, c])
        return rows.select("a", "b", "pivot", *[f"{x}_{c}" for c in "ab" for x in ("grams", "n")])

    whole = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"grams_{c}"), (F.octet_length("grams") / 8).cast("long").alias(f"n_{c}"))
    if state is None:
        return joined(pairs, whole, [])
    part = lambda c: state.select("region", F.col("id").alias(c), F.col("bytes").alias(f"grams_{c}"), F.col("n").alias(f"n_{c}"))
    return joined(pairs.filter("pivot"), whole, []).unionByName(joined(pairs.filter("not pivot"), part, ["region"]))


def set_links(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_shingles, rep) and links (a, b) between representatives.

    Documents of equal sets share the least doc_id as ``rep``. The links connect exactly the sets that pairs of
    Jaccard at least percent/100 connect, but need not be such pairs; within a component no more of these than connect it
    are looked for.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(sketch(docs, k))  # SKETCH numbers, whatever the input
    rows = stored(docs.mapInArrow(_prefixes(k, percent, counts), "doc_id long, n long, key binary, prefix array<long>, centre double"))
    counts.destroy()
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("n", "key").agg(F.min("doc_id").alias("rep"))
    reps = stored(classes)
    window = (100 - percent) / (100 + percent)
    eps = 1 - percent / 100
    own = rows.join(reps.select("key", "rep"), "key").filter("doc_id = rep")
    # c: the component of a set by the links so far. Connected sets need not be compared.
    # A set meets those of its own size band and, as the smaller one, those of the next band.
    width = math.log(100 / percent) + BAND_SLACK
    band = F.floor(F.log(F.col("n").cast("double")) / width)
    least = F.greatest(F.col("n") + 1.0, F.exp((band + 1) * width))  # elements of a set of the next band
    shared = F.ceil(percent / (100 + percent) * (F.col("n") + least) - 1e-6)
    smaller = F.slice("prefix", F.lit(1), F.greatest(F.lit(0), F.col("n") - shared + 1).cast("int"))
    state = own.select(F.explode(F.array(F.struct((F.lit(WHOLE) + band).alias("region"), F.lit(True).alias("core"), F.col("prefix").alias("delta")),
                                         F.struct((F.lit(WHOLE) + band + 1).alias("region"), F.lit(False).alias("core"), smaller.alias("delta")))).alias("s"),
                       F.col("rep").alias("id"), "n", "centre").select(
        "s.region", "id", F.col("id").alias("c"), F.col("n").alias("dn"), "n", "centre", "s.delta", "s.core",
        F.lit(0).alias("short"), F.lit(0).alias("deep"), F.lit(None).cast("binary").alias("bytes"))
    sets, links, done = None, [], []
    for level in range(len(LIST_MAX) + 1):
        # Most elements stand in one set only: they go through two narrow shuffles and no further.
        post = _postings(state) if level else state.select(
            "region", "id", "c", F.when(F.col("core"), CORE).otherwise(DEEP).alias("kind"), F.posexplode("delta").alias("rank", "h")).withColumn(
                "rank", F.col("rank") + 1)
        kinds = [F.count_if(F.col("kind") == k) for k in (CORE, OUTER, DEEP)]
        size = (kinds[0] + kinds[1]) * (kinds[0] + kinds[1] - 1) / 2 + kinds[0] * kinds[2]
        stats = post.groupBy("region", "h").agg(size.alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter(
            "lo < hi and size > 0").drop("lo", "hi")
        lists = stored(post.drop("c").join(stats, ["region", "h"]).join(state.drop("delta", "bytes", "core", "short", "deep"), ["region", "id"]))
        last = level == len(LIST_MAX)
        short = lists if last else lists.filter(F.col("size") <= LIST_MAX[level])
        pairs = _short_pairs(short, window)
        if done:  # pairs that an earlier level has compared
            pairs = pairs.join(reduce(DataFrame.unionByName, done).distinct(), ["a", "b"], "left_anti")
        if not last:
            hot = lists.filter(F.col("size") > LIST_MAX[level])
            pivots = hot.groupBy("region", "h").agg(F.max(F.struct("centre", "id"))["id"].alias("p0"), F.min(
                F.struct(F.xxhash64("id", F.lit(level)), "id"))["id"].alias("p1"))
            long = hot.join(pivots, ["region", "h"]).select(
                "region", "h", "id", F.explode(F.array_distinct(F.array("p0", "p1"))).alias("p"))
            far = long.filter("id <> p").select(F.col("id").alias("a"), F.col("p").alias("b")).distinct()
            pairs = pairs.unionByName(far.select("a", "b", F.lit(WHOLE).alias("region"), F.lit(True).alias("pivot")))
        pairs = stored(pairs)
        if pairs.isEmpty():
            break
        if sets is None:  # all later levels are about documents of this one
            ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            ids = stored(ids)
            ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
            wanted = docs.join(ids, docs["doc_id"] == ids["id"], "left_semi")
            sets = stored(wanted.mapInArrow(_sets(k), "id long, grams binary"))
        compared = stored(_with_sets(pairs, sets, state if level else None).mapInArrow(_compare(percent), _COMPARED))
        links.append(compared.filter("linked").select("a", "b"))
        done.append(compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        if last:
            break
        measured = compared.filter("pivot")
        # A set's regions: per list the nearest pivot and all within 2e of that; a pivot is at 0 from itself.
        seen = long.join(measured.select(F.col("a").alias("id"), F.col("b").alias("p"), "dist"), ["id", "p"], "left").withColumn(
            "dist", F.when(F.col("id") == F.col("p"), 0.0).otherwise(F.col("dist")))
        near = seen.groupBy("region", "h", "id").agg(F.min("dist").alias("nearest"),
                                                     F.collect_list(F.struct("p", "dist")).alias("at"))
        regions = near.select("id", "nearest", F.explode("at").alias("at")).filter(
            (F.col("at.dist") <= F.col("nearest") + 2 * eps + 1e-9) & (F.col("at.p") != F.col("id"))).select(
                F.col("id").alias("a"), F.col("at.p").alias("b")).distinct()
        # As stars, the links so far need one more round only.
        known = components(reduce(DataFrame.unionByName, links))
        links = [known.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))]
        members = measured.join(regions, ["a", "b"]).join(known, F.col("a") == F.col("node"), "left").select(
            F.col("b").alias("region"), F.col("a").alias("id"), F.coalesce("component", "a").alias("c"), "dn", "n",
            (-F.col("dn")).cast("double").alias("centre"), "delta", "bytes", F.col("linked").alias("core"), "short", "deep")
        # A region that is one component by now is done.
        open_ = members.groupBy("region").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("region")
        state = stored(members.join(open_, "region", "left_semi"))
        if state.isEmpty():
            break
    none = spark.createDataFrame([], "a long, b long")
    known = rows.select("doc_id", F.col("n").alias("n_shingles"), "key").join(reps.select("key", "rep"), "key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    return known, reduce(DataFrame.unionByName, links, none)


def near_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least doc_id reachable by links, itself included.

    Texts are lower-cased in A-Z; words are runs of characters other than space and \\x09-\\x0D; a text of fewer
    than k words is one gram, one without words (or null) has none and is linked with nothing. Rows without
    doc_id have component_id null and take no part. Rows that share a doc_id are one document with several
    sets. Texts are read whole; other columns are ignored; no rows give no rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows, links = set_links(docs, k, percent)
        # Rows that share a doc_id but not a set are linked by the id itself.
        own = rows.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(links.unionByName(own))
        return keep(rows.join(found, F.col("doc_id") == F.col("node"), "left").select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def near_dedup(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the least doc_id. Columns unchanged.

    Rows without doc_id stay.
    """
    gone = near_groups(docs, k, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
