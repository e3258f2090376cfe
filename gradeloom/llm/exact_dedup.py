"""Exact duplicates by composable polynomial fingerprints.

A text is cut into pieces of ``PIECE_BYTES``. The hash of a piece is the polynomial of its bytes modulo
the prime 2^31 - 1, at three bases. Hashes combine by arithmetic on lengths: the text's hash is the sum of
its pieces' hashes, each shifted by base^(bytes after the piece). The sum is an ordinary aggregate, so the
pieces of one huge text can be hashed anywhere and in any order.

Texts of equal length and hash are then compared piece by piece: the least and the greatest bytes of every
(fingerprint, piece number) must agree. Least and greatest combine on the map side, so a group that holds a
third of all rows sends one piece a task, not one a row. A fingerprint that fails is grouped by SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.llm.storage import scratch, stored

PIECE_BYTES = 1 << 16
PRIME = (1 << 31) - 1
BASES = (1_234_567_891, 987_654_323, 1_500_450_271)
KEY = ["n_bytes", "f0", "f1", "f2"]


def _powers(base: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:count]


def _shift(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^exponent modulo PRIME for each exponent."""
    out, square, left = np.ones(len(exponents), np.uint64), base % PRIME, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square) % np.uint64(PRIME), out)
        square, left = square * square % PRIME, left >> np.uint64(1)
    return out


@F.arrow_udf(StructType([StructField(f"f{k}", LongType()) for k in range(3)]))
def _piece_hash(piece: pa.Array, after: pa.Array) -> pa.Array:
    """Hash of each piece, shifted by the bytes that follow it in its text. Bytes count from 1."""
    powers = _piece_hash_tables()
    n = len(piece)
    out = np.zeros((3, n), np.uint64)
    ends = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset:piece.offset + n + 1].astype(np.int64)
    data = np.frombuffer(piece.buffers()[2], np.uint8) if piece.buffers()[2] is not None else np.zeros(0, np.uint8)
    for i in range(n):
        part = data[ends[i]:ends[i + 1]].astype(np.uint64) + np.uint64(1)
        for k in range(3):
            # At most 2^16 products below 2^8.1 * 2^31: the sum stays below 2^56.
            out[k, i] = np.dot(part, powers[k][PIECE_BYTES - len(part):]) if len(part) else 0
    tail = after.to_numpy(zero_copy_only=False)
    cols = [pa.array((out[k] % np.uint64(PRIME) * _shift(BASES[k], tail) % np.uint64(PRIME)).astype(np.int64))
            for k in range(3)]
    return pa.StructArray.from_arrays(cols, ["f0", "f1", "f2"])


_TABLES: list[np.ndarray] = []


def _piece_hash_tables() -> list[np.ndarray]:
    """Powers in falling order, made once in a worker."""
    if not _TABLES:
        _TABLES.extend(_powers(b, PIECE_BYTES)[::-1].copy() for b in BASES)
    return _TABLES


def _pieces(rows: DataFrame) -> DataFrame:
    """One row per piece; an empty text has one empty piece. Cutting bytes costs no scan from the start."""
    cut = (f"transform(sequence(0, greatest(0, int((n_bytes - 1) div {PIECE_BYTES}))), "
           f"i -> substring(body, i * {PIECE_BYTES} + 1, {PIECE_BYTES}))")
    return rows.select(*[c for c in rows.columns if c != "body"], F.posexplode(F.expr(cut)).alias("pos", "piece"))


def _bodies(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.cast("binary").alias("body"), F.octet_length(text).cast("long").alias("n_bytes"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sha (SHA-256 bytes), n_bytes, f0..f2, copies: one row per distinct (doc_id, text)."""
    rows = _bodies(docs).select("doc_id", F.unhex(F.sha2("body", 256)).alias("sha"), "n_bytes", "body")
    after = F.greatest(F.lit(0), F.col("n_bytes") - (F.col("pos") + 1) * PIECE_BYTES)
    hashed = _pieces(rows).select("doc_id", "sha", "n_bytes", "pos", _piece_hash("piece", after).alias("h"))
    # Rows that repeat both id and text add the same sum again; dividing by their number undoes that.
    sums = hashed.groupBy("doc_id", "sha", "n_bytes").agg(
        *[F.sum(f"h.f{k}").alias(f"s{k}") for k in range(3)], F.count_if(F.col("pos") == 0).alias("copies"))
    return sums.select("doc_id", "sha", "n_bytes", *[F.expr(f"(s{k} div copies) % {PRIME}").alias(f"f{k}")
                                                     for k in range(3)], "copies")


def clashing(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Keys of fingerprints shared by texts that differ in some piece (as good as never any)."""
    multi = prints.groupBy(*KEY).count().filter("count > 1").select(*KEY)
    members = prints.join(multi, KEY, "left_semi").select(F.col("doc_id").alias("id"), *KEY).distinct()
    bodies = _bodies(docs).withColumnRenamed("n_bytes", "own_bytes")
    rows = bodies.join(members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_bytes") == F.col("n_bytes")))
    ends = _pieces(rows.select(*KEY, "body")).groupBy(*KEY, "pos").agg(
        F.min("piece").alias("least"), F.max("piece").alias("most"))
    return ends.filter("least <> most").select(*KEY).distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group documents of identical text: doc_id, keep_id, group_size, kept, text_sha256.

    One row per distinct (doc_id, text): rows that repeat both are one document. Null text counts as empty,
    and all empty texts are one group. Of a group the largest doc_id stays (a null id only where all are
    null). Texts of any length are read whole, in pieces. Other columns are ignored; no rows give no rows.
    """
    with scratch(docs.sparkSession) as keep:
        prints = stored(fingerprints(docs))
        clashes = stored(clashing(docs, prints))
        sizes = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        if clashes.isEmpty():
            groups = prints.groupBy(*KEY).agg(*sizes).filter("group_size > 1")
            found = prints.join(groups, KEY, "left")
        else:
            # A clashing fingerprint is split by SHA-256; for all others the additional key is null.
            keyed = prints.join(clashes.withColumn("clash", F.lit(True)), KEY, "left").withColumn(
                "split", F.when(F.col("clash"), F.col("sha")))
            groups = keyed.groupBy(*KEY, "split").agg(*sizes).withColumnRenamed("split", "split_key")
            names = [F.col(f"keyed.{c}") == F.col(f"groups.{c}") for c in KEY]
            found = keyed.alias("keyed").join(groups.alias("groups"), [
                *names, F.col("split").eqNullSafe(F.col("split_key"))]).select(
                    "doc_id", "sha", "keep_id", "group_size")
        return keep(found.select(
            "doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("keep_id"), F.col("doc_id")).eqNullSafe(F.col("doc_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without copies, columns unchanged; see exact_groups for the rule.

    Rows without doc_id cannot be told apart by a join and are kept once per distinct row.
    """
    gone = exact_groups(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "text_sha256")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    left = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (sha == gone["text_sha256"]), "left_anti")
    repeated = docs.groupBy("doc_id").count().filter("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])
