"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key characters with a digit, or of a known key format. The forest (Spark ML) sees its length,
character classes and entropy, its character transitions (mean log-probability under a bigram table of ordinary words), the
share of its letters that dictionary words cover, its path (the source column) and the words beside it. Bigrams
and dictionary are counted over all texts that may hold a candidate; the dictionary is the ``DICTIONARY`` most frequent words.

Labelled findings train it: a table of (doc_id, start, end, is_secret). Without one, all findings are labelled by rule:
a known format, or a value that stands behind a key name and a sign of assignment, is a secret; other candidates are
not. ``sample`` bounds the documents of both (least hash of doc_id); by default none is left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.storage import scratch, stored

SAMPLE = None
DICTIONARY = 20_000
COUNTED_WORDS = 200_000  # distinct words a task counts before it hands them on
THRESHOLD = 0.5
TREES, DEPTH = 40, 8

# Formats of well-known keys, and names that secrets are assigned to.
FORMATS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abps]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}"
                     r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}")
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "credential", "auth", "bearer", "private")
# Key characters; the look-behind keeps a long run one candidate.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}")
_WORD = re.compile(r"[^\W\d_]{2,}")
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_CODE = {c: i for i, c in enumerate(_LETTERS)}
FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "hex", "transitions", "covered", "named_before", "assigned",
            "quoted", "word_before", "word_after", "format", *(f"path{i}" for i in range(8)))


def _pairs(counts: Mapping[str, int]) -> np.ndarray:
    """How often each character follows each other one."""
    pairs = np.zeros((len(_LETTERS) + 1,) * 2, np.int64)
    for word, n in counts.items():
        at = [_CODE.get(c, len(_LETTERS)) for c in word]
        for a, b in zip(at, at[1:]):
            pairs[a, b] += n
    return pairs


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: log-probabilities of character pairs, and frequent words."""

    pairs: np.ndarray
    words: frozenset

    @classmethod
    def of(cls, counts: Counter) -> Language:
        return cls.counted(_pairs(counts), sorted(counts, key=lambda w: (-counts[w], w))[:DICTIONARY])

    @classmethod
    def counted(cls, pairs: np.ndarray, frequent: list[str]) -> Language:
        pairs = pairs + 1.0
        return cls(np.log(pairs / pairs.sum(1, keepdims=True)), frozenset(w for w in frequent if len(w) >= 4))

    def transitions(self, text: str) -> float:
        at = [_CODE.get(c, len(_LETTERS)) for c in text.lower()]
        return float(np.mean([self.pairs[a, b] for a, b in zip(at, at[1:])])) if len(at) > 1 else 0.0

    def covered(self, text: str) -> float:
        """Share of the characters in dictionary words of 4 to 12 letters, longest first from the left."""
        low, i, hit = text.lower(), 0, 0
        while i < len(low):
            n = next((n for n in range(min(12, len(low) - i), 3, -1) if low[i:i + n] in self.words), 0)
            hit, i = hit + n, i + max(n, 1)
        return hit / max(len(low), 1)


def _named(before: str) -> tuple[bool, bool]:
    """Whether a key name stands in the last characters, and whether a sign of assignment ends them."""
    low = before.lower()
    return any(n in low for n in NAMES), bool(re.search(r"[=:]\s*[\"']?$", low))


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, rule, label by rule) of every candidate, in order; each run counts once."""
    out = []
    for m in _RUN.finditer(text):
        known = FORMATS.match(m[0])
        if not known and not any(c.isdigit() for c in m[0]):
            continue
        named, assigned = _named(text[max(0, m.start() - 24):m.start()])
        rule = "format" if known else "assigned" if named and assigned else "run"
        out.append((m.start(), m.end(), rule, rule != "run"))
    return out


def features(text: str, start: int, end: int, path: str, language: Language) -> list[float]:
    value, n = text[start:end], end - start
    near = text[max(0, start - 24):start]
    named, assigned = _named(near)
    times = Counter(value).values()
    count = lambda f: sum(map(f, value)) / n
    before, after = _WORD.findall(text[max(0, start - 40):start])[-2:], _WORD.findall(text[end:end + 40])[:2]
    known = lambda ws: sum(w.lower() in language.words for w in ws) / 2
    slot = int(hashlib.md5((path or "").encode()).hexdigest(), 16) % 8
    return [float(n), count(str.isdigit), count(str.isupper), count(str.islower), 1 - count(str.isalnum),
            -sum(t / n * math.log2(t / n) for t in times), float(all(c in "0123456789abcdefABCDEF" for c in value)),
            language.transitions(value), language.covered(value), float(named), float(assigned), float(near[-1:] in "\"'" and near != ""),
            known(before), known(after), float(FORMATS.match(value) is not None), *(float(slot == i) for i in range(8))]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def so_far() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            counts.update(w.lower() for w in _WORD.findall(text.as_py()))
            if len(counts) >= COUNTED_WORDS:
                yield so_far()
                counts.clear()
    yield so_far()


def _letter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros((len(_LETTERS) + 1,) * 2, np.int64)
    for batch in batches:
        pairs += _pairs(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
    at = np.nonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(pairs[at])], ["a", "b", "n"])


_SHAPE = "doc_id long, start long, end long, rule string, label boolean, secret_sha256 string, features array<double>"


def _found(language):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            # One text at a time: a batch may hold long ones.
            for doc, path, text in zip(*(batch.column(i).to_pylist() for i in range(2)), map(pa.StringScalar.as_py, batch.column(2)), strict=True):
                for start, end, rule, label in candidates(text):
                    rows.append((doc, start, end, rule, label, hashlib.sha256(text[start:end].encode()).hexdigest(),
                                 features(text, start, end, path, language.value)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["doc_id", "start", "end", "rule", "label", "secret_sha256", "features"])
    return run


@dataclass(frozen=True)
class SecretModel:
    language: Language
    forest: RandomForestClassificationModel | None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))


def fit_secrets(docs: DataFrame, labelled: DataFrame | None = None, sample: int | None = SAMPLE) -> SecretModel:
    """Train on the findings of all documents that hold a candidate (those of ``labelled`` where given), or of ``sample`` ones.

    Without findings of both classes there is no forest, and the rule's label decides.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labelled, sample)


def _fit(docs: DataFrame, labelled: DataFrame | None, sample: int | None) -> SecretModel:
    spark, own = docs.sparkSession, _rows(docs)
    picked = own.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[A-Za-z0-9+/_-]{12,}"))
    if labelled is not None:
        picked = picked.join(labelled.select("doc_id"), "doc_id", "left_semi")
    if sample is not None:
        ids = picked.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        picked = stored(picked.join(F.broadcast(spark.createDataFrame(ids, "doc_id long")), "doc_id").select(*own.columns))
    counted = stored(picked.select("text").mapInArrow(_vocabulary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    pairs = np.zeros((len(_LETTERS) + 1,) * 2)
    for r in counted.mapInArrow(_letter_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        pairs[r.a, r.b] = r.n
    language = Language.counted(pairs, [r.word for r in counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()])
    found = picked.mapInArrow(_found(spark.sparkContext.broadcast(language)), _SHAPE)
    if labelled is not None:
        truth = labelled.select("doc_id", "start", "end", F.col("is_secret").cast("boolean").alias("label")).filter("label is not null")
        found = found.drop("label").join(truth.groupBy("doc_id", "start", "end").agg(F.max("label").alias("label")), ["doc_id", "start", "end"])
    train = stored(found.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))
    if train.select("label").distinct().count() < 2:
        return SecretModel(language, None)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="sqrt")
    return SecretModel(language, forest.fit(train))


def scan_secrets(docs: DataFrame, model: SecretModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, rule, secret_sha256, score, is_secret: every candidate of every whole text.

    Offsets are code points, end exclusive. The value itself doesn't leave the text: its SHA-256 does. Null and empty texts
    have none; repeated rows and null ids come back as they are; columns other than doc_id, text and source are ignored.
    """
    fixed = docs.sparkSession.sparkContext.broadcast(model.language)  # DICTIONARY words
    with scratch(docs.sparkSession) as keep:  # small batches while the texts are read
        found = keep(_rows(docs).mapInArrow(_found(fixed), _SHAPE))
    if model.forest is None:
        scored = found.withColumn("score", F.col("label").cast("double"))
    else:
        scored = model.forest.transform(found.withColumn("features", array_to_vector("features")).drop("label")).withColumn(
            "score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "rule", "secret_sha256", "score", (F.col("score") >= threshold).alias("is_secret"))
