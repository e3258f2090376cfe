"""Text preparation: token normalisation, lemmas, and the prepared dataset."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.functions.patterns import SPACE
from gradeloom.functions.stopwords import ENGLISH
from gradeloom.operators.labels import encode_labels
from gradeloom.operators.lookup import lookup_join
from gradeloom.operators.sizes import SMALL_ROWS, cut_lineage, small_table

MIN_LEMMA = 3
ROW_SLOTS = 64     # maps of a row's own forms
MARK_BITS = 1 << 23


def _lemma_lookup(dictionary: DataFrame) -> tuple[Column, int]:
    """A small dictionary as one constant: an array of maps, addressed by CRC-32.

    A single map constant would be searched from its start for every token; here a
    look-up touches only the few entries of one slot.
    """
    rows = dictionary.toArrow().to_pylist()
    slots: list[dict[str, str]] = [{} for _ in range(max(1, len(rows) // 4))]
    for row in rows:
        slots[zlib.crc32(row["form"].encode()) % len(slots)][row["form"]] = row["lemma"]
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>"), len(slots)


def _slot(token: Column | str, n: int) -> Column:
    token = F.col(token) if isinstance(token, str) else token
    return F.pmod(F.crc32(token.cast("binary")), F.lit(n)).cast("int")


def _marked_forms(dictionary: DataFrame) -> Callable[[Column], Column]:
    """A test that each form of the dictionary passes, and of other tokens the fewer, the smaller it is.

    Each form sets one of MARK_BITS bits by its hash, so the constant (1 MB) does not grow with the dictionary.
    """
    bit = lambda t: F.pmod(F.xxhash64(t), F.lit(MARK_BITS))
    rows = (dictionary.select(bit(F.col("form")).alias("b"))
            .groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")))
    words = [0] * (MARK_BITS // 64)
    for row in rows.toArrow().to_pylist():
        words[row["word"]] = row["bits"]
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    return lambda t: F.getbit(F.get(table, F.shiftright(bit(t), 6).cast("int")), (bit(t) % 64).cast("int")) == 1


def lemmatize(df: DataFrame, tokens: str, dictionary: DataFrame, out: str,
              row_id: Sequence[str] = (), small_rows: int = SMALL_ROWS) -> DataFrame:
    """Replace each token by its lemma; tokens outside the dictionary stay.

    ``dictionary`` has (form, lemma); of a form's lemmas the first in order counts. A
    small dictionary is looked up within each row, so the texts are not shuffled. Of a
    larger one each row gets the part it needs, by ``row_id`` (a unique key) or, without
    one, by a number that each row gets: a row's distinct tokens are joined to it, without
    most of those that it lacks.
    """
    pairs = (dictionary.select("form", "lemma").filter("form is not null and lemma is not null")
             .groupBy("form").agg(F.min("lemma").alias("lemma")))
    local = small_table(pairs, small_rows)
    if local is not None:
        table, n_slots = _lemma_lookup(local)
        entries = lambda t: F.get(table, _slot(t, n_slots))
        return df.withColumn(out, F.transform(tokens, lambda t: F.coalesce(F.element_at(entries(t), t), t)))
    numbered = not row_id
    if numbered:
        # Written once, so that both uses below see the same numbers.
        df, row_id = cut_lineage(df.withColumn("_row_number", F.monotonically_increasing_id())), ["_row_number"]
    ids = list(row_id)
    pairs = cut_lineage(pairs)
    marked = _marked_forms(pairs)
    forms = df.select(*ids, F.explode(F.filter(F.array_distinct(tokens), marked)).alias("_token"))
    table = pairs.select(F.col("form").alias("_form"), F.col("lemma").alias("_found"))
    # Equal forms of a row have one lemma, so rows that share an id can share their forms, too.
    known = (lookup_join(forms, table, {"_token": "_form"}, spread_by=[*ids, "_token"], small_rows=small_rows)
             .withColumn("_slot", _slot("_token", ROW_SLOTS)).repartition(*ids)
             .groupBy(*ids, "_slot").agg(F.map_from_entries(F.collect_set(F.struct("_token", "_found"))).alias("_map"))
             .groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_map"))).alias("_maps"))
             .withColumnsRenamed({i: f"_id_{i}" for i in ids}))
    same_row = [F.col(i).eqNullSafe(F.col(f"_id_{i}")) for i in ids]
    condition = same_row[0]
    for c in same_row[1:]:
        condition = condition & c
    found = lambda t: F.element_at(F.element_at("_maps", _slot(t, ROW_SLOTS)), t)
    lemmas = F.transform(F.filter(tokens, lambda t: t.isNotNull()), lambda t: F.coalesce(found(t), t))
    return (df.join(known, condition, "left")
            .withColumn(out, F.coalesce(lemmas, F.array().cast("array<string>")))
            .drop("_maps", *[f"_id_{i}" for i in ids], *(["_row_number"] if numbered else [])))


def normalize_tokens(df: DataFrame, text: str, out: str, *, mode: str = "plain",
                     stop_words: Sequence[str] = ENGLISH, dictionary: DataFrame | None = None,
                     row_id: Sequence[str] = ()) -> DataFrame:
    """Text to normalised text.

    ``plain`` joins the tokens again. ``content`` keeps alphabetic tokens that are
    not stop words, replaces them by their lemma, and drops lemmas of one or two
    letters.
    """
    tokens = X.words(text)
    if mode == "plain":
        return df.withColumn(out, F.array_join(tokens, " "))
    if mode != "content":
        raise ValueError("mode must be 'plain' or 'content'")
    kept = df.withColumn("_tokens", X.content_words(tokens, stop_words))
    if dictionary is not None:
        kept = lemmatize(kept, "_tokens", dictionary, "_tokens", row_id)
    long_enough = F.filter("_tokens", lambda t: F.char_length(t) >= MIN_LEMMA)
    return kept.withColumn(out, F.array_join(long_enough, " ")).drop("_tokens")


def prepare_texts(df: DataFrame, text: str, *, mode: str = "plain", stop_words: Sequence[str] = ENGLISH,
                  dictionary: DataFrame | None = None, row_id: Sequence[str] = ()) -> DataFrame:
    """Add cleaned_text, processed_text and medical_keywords."""
    cleaned = df.withColumn("cleaned_text", X.clean(text))
    processed = normalize_tokens(cleaned, "cleaned_text", "processed_text", mode=mode,
                                 stop_words=stop_words, dictionary=dictionary, row_id=row_id)
    return processed.withColumn("medical_keywords", X.keywords("cleaned_text"))


def prepare_dataset(df: DataFrame, text: str, label: str, mapping: DataFrame, **options) -> DataFrame:
    """Texts prepared as above, plus label_encoded from the label map."""
    return encode_labels(prepare_texts(df, text, **options), label, mapping)


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """Add num_chars, num_words and avg_word_length (0 without words), from one regex pass.

    With runs of white space collapsed to one space, the words number one more than
    the spaces, and the other characters are the summed word lengths. Each step is a
    column of its own, so that none is computed twice.
    """
    spaced = df.withColumn("_spaced", F.trim(F.regexp_replace(X.filled(text), f"[{SPACE}]+", F.lit(" "))))
    counted = spaced.withColumns({"_n": F.char_length("_spaced"),
                                  "_letters": F.char_length(F.replace("_spaced", F.lit(" "), F.lit("")))})
    n_words = F.when(F.col("_letters") == 0, F.lit(0)).otherwise(F.col("_n") - F.col("_letters") + 1)
    worded = counted.withColumns({"num_chars": F.char_length(X.filled(text)), "num_words": n_words})
    mean = F.when(F.col("num_words") == 0, F.lit(0.0)).otherwise(
        F.col("_letters").cast("double") / F.col("num_words"))
    return worded.withColumn("avg_word_length", mean).drop("_spaced", "_n", "_letters")
