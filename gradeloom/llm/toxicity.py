"""Toxicity by bags of subwords: averaged embeddings into a linear softmax, trained jointly in NumPy.

A word, marked by a space on both sides, has its character n-grams of 3 to 5 and itself as subwords. A
subword's bucket has an embedding; a text is the mean of the embeddings of its subwords (a word that occurs n
times weighs sqrt(n), so repeated lines don't drown the rest), and a softmax over
two linear outputs gives the score. Embeddings and outputs are trained together by Adam. A misspelt word
that was never seen shares most of its n-grams with the word it stands for.

Training reads a bounded sample: at most ``sample`` labelled rows of class 0 and 1, the ones with the least
hash of doc_id, as bags of at most BUCKETS entries. Scoring needs only the product of embedding and output weights: one number a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import words as W
from gradeloom.llm.storage import scratch, stored

BUCKETS = 1 << 17
DIMS = 8
NGRAMS = (3, 4, 5)
SAMPLE = (3000, 1500)  # rows labelled 0 and 1
EPOCHS, LEAST_STEPS, BATCH, DECAY = 12, 240, 200, 3e-4
LEAST_ROWS = 5  # buckets of fewer training rows have no weight: they would only tell rows apart
THRESHOLD = 0.3
SCALE = 300.0  # the mean is multiplied by it, which only changes the step size
PART = 1 << 20  # entries of the sample that are looked at together
EMPTY = 300.0  # subwords without weight that every mean includes: a text of three words is no sure case


@dataclass(frozen=True)
class ToxicityModel:
    """weight: a bucket's part of the logit; bias: with the log odds of the labels in it."""

    weight: np.ndarray
    bias: float

    def score(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        logit = SCALE * total / (count + EMPTY) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def word_subwords(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the words, and the number of the word each belongs to."""
    size = ends - starts + 1
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) + 1 if len(size) else np.zeros(0, np.int64)
    # Words one after another with one space before each and one at the end.
    text = np.full(int(size.sum()) + 1, 32, np.uint32)
    word = np.repeat(np.arange(len(size)), size - 1)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    text[first[word] + inner] = cp[starts[word] + inner]
    owner = np.repeat(np.arange(len(size)), size)  # of the space before and of the word's characters
    space = np.concatenate([[0], np.cumsum(text == 32)])
    buckets, owners = [W.run_hashes(cp, starts, ends)], [np.arange(len(size))]
    for n in NGRAMS:
        if len(text) < n:
            continue
        at = np.arange(len(text) - n + 1)
        # No space inside, only as the first or the last character.
        at = at[space[at + n - 1] - space[at + 1] == 0]
        buckets.append(W.run_hashes(text, at, at + n))
        owners.append(owner[np.minimum(at, len(owner) - 1)])
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def _lower(texts: list[str]) -> list[str]:
    # A few characters change length in lower case; positions are not needed here.
    return [t.lower() for t in texts]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cp, at = W.codes(_lower(texts))
    starts, ends = W.runs(W.alphanumeric(cp))
    return cp, starts, ends, np.searchsorted(at, starts, "right") - 1


def _distinct(cp, starts, ends):
    """Distinct words: index of one occurrence each, and each word's number among them."""
    _, one, number = np.unique(W.run_hashes(cp, starts, ends), return_index=True, return_inverse=True)
    return one, number


def text_scores(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Score of each text; texts without words get the score of the bias alone."""
    out = np.zeros(len(texts))
    for first, part in W.slices(texts):
        cp, starts, ends, doc = _words(part)
        one, number = _distinct(cp, starts, ends)
        bucket, owner = word_subwords(cp, starts[one], ends[one])
        value = np.bincount(owner, model.weight[bucket], len(one))
        count = np.bincount(owner, minlength=len(one))
        pair, times = np.unique(doc * len(one) + number, return_counts=True)
        doc, number, times = pair // max(len(one), 1), pair % max(len(one), 1), np.sqrt(times)
        out[first:first + len(part)] = model.score(np.bincount(doc, times * value[number], len(part)),
                                                   np.bincount(doc, times * count[number], len(part)))
    return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, part in W.slices(texts):
            cp, starts, ends, doc = _words(part)
            one, number = _distinct(cp, starts, ends)
            bucket, owner = word_subwords(cp, starts[one], ends[one])
            order = np.argsort(owner, kind="stable")
            bucket, cuts = bucket[order], np.searchsorted(owner[order], np.arange(len(one) + 1))
            ids, counts = [], []
            for i in range(len(part)):
                kinds, times = np.unique(number[doc == i], return_counts=True)
                if len(kinds) == 0:
                    ids.append([]), counts.append([])
                    continue
                of = np.concatenate([bucket[cuts[k]:cuts[k + 1]] for k in kinds])
                bag = np.bincount(of, np.repeat(np.sqrt(times), cuts[kinds + 1] - cuts[kinds]), BUCKETS)
                ids.append(np.flatnonzero(bag).astype(np.int32))
                counts.append(bag[ids[-1]].astype(np.float32))
            yield pa.RecordBatch.from_arrays([
                pa.array(label[first:first + len(part)], pa.int32()),
                pa.array([np.array(x, np.int32).tobytes() for x in ids], pa.binary()),
                pa.array([np.array(x, np.float32).tobytes() for x in counts], pa.binary())], ["label", "ids", "counts"])


def fit_arrays(label: np.ndarray, cut: np.ndarray, ids: np.ndarray, share: np.ndarray, prior: float,
               seed: int = 7) -> ToxicityModel:
    """Joint training in small batches over sparse rows ids[cut[i]:cut[i+1]]; a share is count / (all counts + EMPTY)."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out = rng.uniform(-0.5, 0.5, (DIMS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    # In parts, as NumPy makes a wider copy of what it counts.
    parts = range(0, len(ids), PART)
    used = sum((np.bincount(ids[i:i + PART], minlength=BUCKETS) for i in parts), np.zeros(BUCKETS, np.int64)) >= LEAST_ROWS
    for i in parts:
        share[i:i + PART] *= used[ids[i:i + PART]]
    params, moments = [emb, out, bias], [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    weight = (0.5 / np.maximum(np.bincount(label, minlength=2) / len(label), 1e-9))[label]  # classes count alike
    mixed = rng.permutation(len(label))
    batches = np.array_split(mixed, max(1, len(label) // BATCH))
    step, kept, weight_sum, bias_sum = 0, 0, np.zeros(BUCKETS), 0.0
    epochs = max(EPOCHS, -(-LEAST_STEPS // len(batches)))
    for epoch in range(epochs):
        for part in batches:
            step += 1
            size = cut[part + 1] - cut[part]
            at = np.repeat(cut[part] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            row, bucket, value = np.repeat(np.arange(len(part), dtype=np.int32), size), ids[at], share[at] * np.float32(SCALE)
            hidden = np.stack([np.bincount(row, value * emb[bucket, k], len(part)) for k in range(DIMS)], 1)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.eye(2)[label[part]]) * weight[part][:, None] / len(part)
            back = (d @ out.T).astype(np.float32)
            grads = [np.stack([np.bincount(bucket, value * back[row, k], BUCKETS) for k in range(DIMS)], 1)
                     + DECAY * emb, hidden.T @ d + 1e-4 * out, d.sum(0)]
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        if epoch >= epochs // 2:  # the mean of the later epochs is steadier than the last one
            kept += 1
            weight_sum += emb @ (out[:, 1] - out[:, 0])
            bias_sum += float(bias[1] - bias[0])
    odds = np.log(prior / (1 - prior))
    return ToxicityModel(weight_sum / kept * used, float(bias_sum / kept + odds))


def learnable() -> F.Column:
    """Rows whose label may be learned from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> ToxicityModel | None:
    """Train on a bounded sample. None where a class has no labelled text.

    Labels other than 0 and 1, labels without text row and null ids are not used; a doc_id that is labelled
    both ways counts as toxic. Training sees texts and labels only.
    """
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(learnable())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))
    with_text = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    spark = docs.sparkSession
    counts = {r.label: r["count"] for r in with_text.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    order = F.xxhash64("doc_id")
    chosen = [with_text.filter(F.col("label") == y).orderBy(order, "doc_id").limit(sample[y]).collect() for y in (0, 1)]
    small = F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for part in chosen for r in part],
                                               "doc_id long, label int"))  # no more rows than the sample
    picked = docs.select("doc_id", "text").join(small, "doc_id").select("label", "text")
    with scratch(spark):
        bags = stored(picked.mapInArrow(_bags, "label int, ids binary, counts binary").withColumn("row", F.monotonically_increasing_id()))
        known = bags.select("row", "label", (F.octet_length("ids") / 4).cast("long").alias("n")).orderBy("row").collect()
        label = np.array([r.label for r in known], np.int32)
        size = np.array([r.n for r in known], np.int64)
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = {r.row: i for i, r in enumerate(known)}
        # One partition after another into arrays of the final size, so that the driver holds the sample once.
        ids, share = np.empty(cut[-1], np.int32), np.zeros(cut[-1] + 1, np.float32)
        for r in bags.select("row", "ids", "counts").toLocalIterator():
            i = at[r.row]
            ids[cut[i]:cut[i + 1]] = np.frombuffer(r.ids, np.int32)
            share[cut[i]:cut[i + 1]] = np.frombuffer(r.counts, np.float32)
    total = np.add.reduceat(share, cut[:-1]) if len(size) else size
    total = np.where(size > 0, total, 0).astype(np.float32) + np.float32(EMPTY)
    share = share[:-1]
    for i in range(len(size)):
        share[cut[i]:cut[i + 1]] /= total[i]
    prior = counts[1] / (counts[0] + counts[1])
    return fit_arrays(label, cut, ids, share, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` (an existing column of that name is replaced).

    Whole texts are scored, in one pass without a shuffle; null and empty texts get the score of the bias.
    Without a model every score is 0.
    """
    kept = [c for c in docs.columns if c != out]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias(out))
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # one number for each of BUCKETS

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(text_scores(fixed.value, text.to_pylist()))

    return docs.select(*kept, scored("text").alias(out))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, columns unchanged (a ``score`` column of the
    caller's too: the classifier's number goes to a name that no column of ``docs`` has)."""
    cols = docs.columns
    out = "_toxicity"
    while out in cols:
        out += "_"
    return score_toxicity(docs, fit_toxicity(docs, labels), out).filter(F.col(out) < threshold).select(*cols)
