"""Packing by lexical retrieval: a sharded BM25 index finds unused neighbours that fill a seed's window.

Texts are tokenised once, into a stored table; the same pass counts in how many documents each id occurs and the
lengths, over all documents. Documents are then range-partitioned by a minimum hash of their id trigrams, so that like
documents meet and equal hashes are split by doc_id. A partition is read in shards of bounded size; each shard has an
inverted index with the global statistics. A seed's highest-weighted ids are its query. Neighbours that fit are
taken whole, best first; the best of the others is cut to fill the window and goes on as the next seed. Windows run on
across shards, so only the last one of a partition isn't full; it is cut into powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import words as W
from gradeloom.llm.storage import scratch, stored

WINDOW = 1024
SHARD_DOCS, SHARD_TOKENS = 512, 1 << 20
QUERY_TERMS = 12
NEIGHBOURS = 32
K1, B = 1.2, 0.75
PARTITION_TOKENS = 8_000_000
# Fixed value: how the byte-level vocabulary cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Ids of a byte-level BPE vocabulary file, in one worker."""

    cached: dict[str, Tokens] = {}

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", [])}
        # The file writes bytes as printable characters: those that print stand for themselves, the others follow from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.size = max(*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", [])), 0) + 1
        self.special = special
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls.cached:
            cls.cached[path] = cls(path)
        return cls.cached[path]

    def ids(self, text: str) -> list[int]:
        """The same ids by the faster of the two libraries; texts that hold a special token's string by the other."""
        if any(s in text for s in self.special):
            return self.plain.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # a very long run can pass the fast library's limits, which it reports as a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit)):
                raise
            return self.plain.encode(text, add_special_tokens=False).ids


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path)
        names = ["doc_id", "ids", "like", "df"]
        df = np.zeros(tokens.size, np.int64)

        def batch_of(doc, ids, like, freq):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.binary()),
                                               pa.array(like, pa.int64()), pa.array(freq, pa.list_(pa.int64()))], names)
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, part in W.slices(texts):
                out, like = [], []
                for text in part:
                    ids = np.array([*tokens.ids(text), 0], np.uint16 if tokens.size <= 65536 else np.uint32)
                    df[np.unique(ids)] += 1
                    wide = ids.astype(np.uint64)
                    grams = W.mix(wide[:-2] << np.uint64(40) | wide[1:-1] << np.uint64(20) | wide[2:]) if len(ids) > 2 else wide
                    out.append(ids.tobytes())
                    like.append(int(grams.min() >> np.uint64(1)))
                yield batch_of(docs[first:first + len(part)], out, like, [None] * len(part))
        yield batch_of([None], [None], [None], [df])
    return run


class Shard:
    """An inverted index over some documents, with statistics of all documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        terms, times, owner = [], [], []
        for i, ids in enumerate(docs):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t), times.append(n), owner.append(np.full(len(t), i))
        cut = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        term, tf, doc = np.concatenate(terms).astype(np.int64), np.concatenate(times), np.concatenate(owner)
        length = np.array([len(d) for d in docs])[doc]
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
        self.queries = [term[a:b][np.argsort(-weight[a:b], kind="stable")[:QUERY_TERMS]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.cuts = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents with the best scores for the seed's query, ties in order."""
        spans = [slice(self.cuts[t], self.cuts[t + 1]) for t in self.queries[seed]]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        score[~unused] = 0
        best = np.argsort(-score, kind="stable")[:NEIGHBOURS]
        return best[score[best] > 0].tolist()


class Packer:
    """Pieces of one partition's sequences, in order."""

    def __init__(self, first: int):
        self.sequence, self.used, self.rows, self.open = first, 0, [], []

    def put(self, doc, ids: np.ndarray, start: int, length: int) -> None:
        self.open.append((doc, ids, start, length))
        self.used += length
        if self.used == WINDOW:
            self.close()

    def close(self) -> None:
        offset = 0
        for doc, ids, start, length in self.open:
            crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
            self.rows.append((doc, start, length, crc, len(ids), self.sequence, offset))
            offset += length
        self.sequence, self.used, self.open = self.sequence + 1, 0, []

    def finish(self) -> None:
        """The last window in powers of two, so that nothing is padded."""
        left, self.open, self.used = self.open, [], 0
        rest = sum(p[3] for p in left)
        for size in (1 << k for k in range(WINDOW.bit_length() - 1, -1, -1)):
            if rest & size:
                need = size
                while need:
                    doc, ids, start, length = left.pop(0)
                    take = min(need, length)
                    self.open.append((doc, ids, start, take))
                    if take < length:
                        left.insert(0, (doc, ids, start + take, length - take))
                    need -= take
                self.close()


def pack_shard(packer: Packer, names: list, docs: list[np.ndarray], shard: Shard) -> None:
    unused = np.ones(len(docs), bool)
    following, nxt = 0, None
    while True:
        if nxt is None:
            while following < len(docs) and not unused[following]:
                following += 1
            if following == len(docs):
                return
            seed, start = following, 0
        else:
            seed, start = nxt
        nxt, unused[seed] = None, False
        # The seed fills what is open, then whole windows; its rest opens one.
        while start < len(docs[seed]):
            take = min(WINDOW - packer.used, len(docs[seed]) - start)
            packer.put(names[seed], docs[seed], start, take)
            start += take
        if not packer.used:
            continue
        near = shard.neighbours(seed, unused)
        for i in near:
            if packer.used and len(docs[i]) <= WINDOW - packer.used:
                packer.put(names[i], docs[i], 0, len(docs[i]))
                unused[i] = False
        # One that doesn't fit is cut as the next seed.
        nxt = next(((i, 0) for i in near if unused[i]), None) if packer.used else None


def _pack(idf, mean_length: float, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 40)
        names, docs, size = [], [], 0

        def flush():
            if docs:
                pack_shard(packer, names, docs, Shard(docs, idf.value, mean_length))
            rows, packer.rows = packer.rows, []
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(doc), docs.append(np.frombuffer(raw, width))
                size += len(docs[-1])
                if len(docs) >= SHARD_DOCS or size >= SHARD_TOKENS:
                    yield flush()
                    names, docs, size = [], [], 0
        yield flush()
        names, docs = [], []
        packer.finish()
        yield flush()
    return run


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    ``vocabulary`` is the path of a byte-level BPE file on every executor. A document is its text's ids (null text:
    none) and id 0; each id lies in exactly one piece. Every row is packed, repeated ones and those without
    doc_id, too; other columns are ignored; no rows give no rows. Memory follows a shard and the longest text.
    """
    with scratch(docs.sparkSession) as keep:
        table = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
            _tokenise(vocabulary), "doc_id long, ids binary, like long, df array<long>"))
        rows = table.filter("ids is not null").select("doc_id", "ids", "like")
        frequent = (table.filter("df is not null").select(F.posexplode("df").alias("id", "n")).filter("n > 0")
                    .groupBy("id").agg(F.sum("n").alias("n")).toArrow())  # one row for each id of the vocabulary at most
        size = Tokens.of(vocabulary).size
        width = 2 if size <= 65536 else 4
        total = rows.agg(F.count(F.lit(1)).alias("docs"), (F.sum(F.octet_length("ids")) / width).cast("long").alias("ids")).first()
        df = np.zeros(size)
        df[frequent["id"].to_numpy()] = frequent["n"].to_numpy()
        idf = docs.sparkSession.sparkContext.broadcast(np.log(1 + (total.docs - df + 0.5) / (df + 0.5)))
        slots = docs.sparkSession.sparkContext.defaultParallelism
        parts = max(slots, (total.ids or 0) // PARTITION_TOKENS + 1)
        near = rows.repartitionByRange(parts, "like", "doc_id").sortWithinPartitions("like", "doc_id", F.octet_length("ids"))
        return keep(near.select("doc_id", "ids").mapInArrow(
            _pack(idf, (total.ids or 0) / max(total.docs, 1) or 1.0, "<u2" if width == 2 else "<u4"),
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))
