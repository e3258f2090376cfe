"""Personal data by patterns and a skip-chain conditional random field.

The patterns give base spans, which always stay. The field labels the other candidate tokens (runs without white
space that hold a digit or @; all other tokens are O). Its potentials: a linear function of token features; a
transition between neighbouring candidates; and a skip potential between each token and the next distant one in
the document that repeats it (equal letters and digits) or resembles it (equal last seven digits). Loopy belief
propagation passes what is known at base spans along these links, so that one entity has one label in the whole
document. Each occurrence links to the next alone: links grow with the tokens, not with their pairs.

Training is piecewise, in NumPy: features by softmax regression, transitions by smoothed log ratios of
label pairs, skips by how often linked base spans agree (a token without a base span is unknown there, not O), over a bounded sample (``sample`` documents with a candidate, least hash of doc_id) whose base spans
are the labels. Skips need no document's text beside its own: scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import words as W
from gradeloom.llm.storage import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = 5  # O and the kinds
FEATURES = 1 << 12
PER_TOKEN = 10
SAMPLE = 2000
ROUNDS = 8
SURE = 0.8
BASE_LOGIT = 30.0
AGREEING = 10_000  # linked pairs of one label assumed before any are seen

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_CANDIDATE = re.compile(r"[^\s]+")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: the run before it can't hold another one."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            after = found.end()
            yield start, after
        at = text.find("@", max(after, at + 1))


def _luhn(digits: str) -> bool:
    own = [int(d) for d in digits[::-1]]
    return (sum(own[::2]) + sum(sum(divmod(2 * d, 10)) for d in own[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by kind, then start; matches that fail a check are dropped without a retry."""
    out = [(0, a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            # No valid match is longer than 19 digits and 18 separators.
            if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
                out.append((2, *m.span()))
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % FEATURES


def _shape(token: str) -> str:
    out = re.sub("[0-9]+", "d", token)
    return re.sub(r"[^\W\d_]+", "a", out)[:12]


def _features(token: str, before: str, after: str, digits: str) -> list[int]:
    return [_hash(f) for f in (
        "bias", "s" + _shape(token), f"d{min(len(digits), 20)}", f"@{token.count('@')}", f".{min(token.count('.'), 4)}",
        f"+{token[:1] == '+'}", f"-{min(token.count('-'), 4)}{'(' in token}", f"l{min(len(token), 40) // 4}",
        "b" + _shape(before), "a" + _shape(after))]


@dataclass
class Graph:
    """Candidate tokens of some texts. label: of base spans, else 0; fixed: belongs to a base span."""

    doc: list
    start: list
    end: list
    feats: list
    label: list
    fixed: list
    chain: list
    skip: list

    @classmethod
    def of(cls, texts: list[str], spans: list[list[Span]]) -> Graph:
        g = cls([], [], [], [], [], [], [], [])
        for i, (text, own) in enumerate(zip(texts, spans, strict=True)):
            if not own and not re.search("[0-9@]", text):
                continue
            cover = sorted((a, b, k + 1) for k, a, b in own)
            at, seen, last_word, last_node = 0, {}, None, None
            words = list(_CANDIDATE.finditer(text))
            for w, m in enumerate(words):
                token = m[0]
                while at < len(cover) and cover[at][1] <= m.start():
                    at += 1
                inside = next((c for c in cover[at:at + 4] if c[0] < m.end() and c[1] > m.start()), None)
                if not inside and not _TOKEN.match(token):
                    continue
                digits = _digits(token)
                node = len(g.doc)
                g.doc.append(i), g.start.append(m.start()), g.end.append(m.end())
                g.feats.append(_features(token, words[w - 1][0] if w else "", words[w + 1][0] if w + 1 < len(words) else "", digits))
                g.label.append(inside[2] if inside else 0), g.fixed.append(inside is not None)
                if last_word == w - 1 and last_node is not None:
                    g.chain.append((last_node, node))
                last_word, last_node = w, node
                plain = "".join(c for c in token.lower() if c.isalnum())
                for key in {"=" + plain, "~" + digits[-7:] if len(digits) >= 7 else "=" + plain}:
                    if len(plain) > 2 and seen.get(key, node) != node:
                        g.skip.append((seen[key], node))
                    seen[key] = node
        return g


@dataclass(frozen=True)
class PiiModel:
    weight: np.ndarray  # FEATURES x LABELS
    chain: np.ndarray   # LABELS x LABELS
    skip: np.ndarray

    def unary(self, feats: np.ndarray) -> np.ndarray:
        return self.weight[feats].sum(1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def propagate(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs (probabilities) by loopy belief propagation; exact on trees once rounds cover their depth.

    unary: nodes x labels; edges: m x 2; potentials: m x labels x labels (log), first index for the first node.
    """
    n, labels = unary.shape
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    pot = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.roll(np.arange(len(src)), len(edges))  # the same edge the other way
    messages = np.zeros((len(src), labels))

    def beliefs():
        return unary + np.stack([np.bincount(dst, messages[:, k], n) for k in range(labels)], 1) if len(src) else unary

    for _ in range(rounds if len(src) else 0):
        out = _log_sum((beliefs()[src] - messages[back])[:, :, None] + pot, 1)
        messages = out - out.max(1, keepdims=True)
    b = beliefs()
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str], spans: list[list[Span]], model: PiiModel) -> list[list[Span]]:
    """Spans that the field adds to each text: sure tokens outside base spans, neighbours of one kind together."""
    out: list[list[Span]] = [[] for _ in texts]
    g = Graph.of(texts, spans)
    if not g.doc:
        return out
    unary = model.unary(np.array(g.feats))
    fixed, label = np.array(g.fixed), np.array(g.label)
    unary[fixed] = 0
    unary[fixed, label[fixed]] = BASE_LOGIT
    edges = np.array(g.chain + g.skip, np.int64).reshape(-1, 2)
    pots = np.concatenate([np.repeat(model.chain[None], len(g.chain), 0), np.repeat(model.skip[None], len(g.skip), 0)])
    p = propagate(unary, edges, pots)
    best = p.argmax(1)
    joined = set(g.chain)
    last = None
    for i in np.flatnonzero((best > 0) & (p.max(1) >= SURE) & ~fixed).tolist():
        kind = int(best[i]) - 1
        own = out[g.doc[i]]
        if last == i - 1 and (i - 1, i) in joined and own and own[-1][0] == kind and g.doc[i - 1] == g.doc[i]:
            own[-1] = (kind, own[-1][1], g.end[i])
        else:
            own.append((kind, g.start[i], g.end[i]))
        last = i
    return out


def _log_ratio(pairs: np.ndarray) -> np.ndarray:
    """log P(x, y) / (P(x) P(y)) of label pairs, smoothed and made symmetric."""
    joint = pairs + pairs.T + 0.5
    joint = joint / joint.sum()
    one = joint.sum(1)
    return np.log(joint / (one[:, None] * one[None]))


def fit_arrays(feats: np.ndarray, label: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 200) -> PiiModel:
    weight = np.zeros((FEATURES, LABELS))
    truth = np.eye(LABELS)[label]
    second = np.full((FEATURES, LABELS), 1e-8)
    for _ in range(steps if len(label) else 0):
        z = weight[feats].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - truth) / len(label)
        grad = np.stack([np.bincount(feats.ravel(), np.repeat(d[:, k], feats.shape[1]), FEATURES) for k in range(LABELS)], 1) + 1e-5 * weight
        second += grad * grad
        weight -= 0.2 * grad / np.sqrt(second)
    count = lambda e: np.bincount(label[e[:, 0]] * LABELS + label[e[:, 1]], minlength=LABELS ** 2).reshape(LABELS, LABELS).astype(float)
    known = count(skip)[1:, 1:]
    strength = np.log((np.trace(known) + AGREEING) / (known.sum() - np.trace(known) + 1))
    return PiiModel(weight, _log_ratio(count(chain)), strength * np.eye(LABELS))


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flat = lambda x: pa.array([np.array(v, np.int32).ravel() for v in x], pa.list_(pa.int32()))
    for batch in batches:
        for first in range(0, len(batch), 64):
            texts = batch.column(0).slice(first, 64).to_pylist()
            g = Graph.of(texts, [base_spans(t) for t in texts])
            yield pa.RecordBatch.from_arrays([flat([g.feats]), flat([g.label]), flat([g.chain]), flat([g.skip])],
                                             ["feats", "label", "chain", "skip"])


def fit_pii(docs: DataFrame, sample: int = SAMPLE) -> PiiModel:
    """Train on at most ``sample`` documents with a candidate; without any the field adds nothing."""
    some = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")).select("doc_id").distinct()
    ids = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long"))  # at most ``sample`` rows
    with small_batches(docs.sparkSession):
        table = docs.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").select("text").mapInArrow(
            _graphs, "feats array<int>, label array<int>, chain array<int>, skip array<int>").toArrow().to_pylist()
    sizes = np.concatenate([[0], np.cumsum([len(r["label"]) for r in table])]).astype(np.int64)
    get = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.array(r[c], np.int64) for r in table]])
    edges = lambda c: np.concatenate([np.zeros((0, 2), np.int64), *[np.array(r[c], np.int64).reshape(-1, 2) + at for r, at in zip(table, sizes)]])
    return fit_arrays(get("feats").reshape(-1, PER_TOKEN), get("label"), edges("chain"), edges("skip"))


def find_pii(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, base (spans of the patterns), added (spans of the field): arrays of (kind, start, end), a row for each row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. Texts are read whole; repeated rows and
    null ids come back as they are; other columns are ignored.
    """
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x LABELS numbers
    schema = "struct<kind:string,start:int,end:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = lambda x: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in x], kind)
        for batch in batches:
            ids, done = batch.column(0), 0
            for first in range(0, len(batch), 512):
                for _, part in W.slices(batch.column(1).slice(first, 512).to_pylist()):
                    base = [base_spans(t) for t in part]
                    more = added_spans(part, base, fixed.value)
                    yield pa.RecordBatch.from_arrays([ids.slice(done, len(part)), rows(base), rows(more)], ["doc_id", "base", "added"])
                    done += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base array<{schema}>, added array<{schema}>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_pii's rows: the contract of the registered query."""
    rank = "array_position(array({}), s.kind)".format(",".join(f"'{k}'" for k in KINDS))

    def joined(spans: str) -> F.Column:
        keyed = f"sort_array(transform({spans}, s -> struct({rank} as r, s.start as a, s.end as b, s.kind as k)))"
        return F.expr(f"array_join(transform({keyed}, s -> concat(s.k, ':', s.a, ':', s.b)), ',')")
    return found.select(
        "doc_id", *[F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("concat(base, added)").alias("spans"))
