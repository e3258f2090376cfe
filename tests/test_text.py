"""Cleaning, tokens, keywords, statistics and lemmas."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.functions.stopwords import ENGLISH
from gradeloom.operators.text_prep import lemmatize, normalize_tokens, prepare_texts, text_statistics


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_stop_words_are_the_default_list(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_clean(spark):
    assert one(spark, "A 12[*x3*] b_c, d!", X.clean("t")) == "a b_c d"
    assert one(spark, None, X.clean("t")) == ""
    # Digits go first, so a mask of digits alone is left as "[**]", which is a mask as well.
    assert one(spark, "x [*12*] y", X.clean("t")) == "x y"
    # A mask does not span lines.
    assert one(spark, "[*a\nb*]", X.clean("t")) == "a b"


def python_clean(text):
    text = re.sub(r"\d+", "", text.lower())
    text = re.sub(r"\[\*.*?\*\]", "", text)
    return " ".join(re.sub(r"[^\w\s]", " ", text).split())


def test_clean_and_statistics_match_python(spark):
    """Many random texts in one Spark job."""
    texts = []

    @settings(max_examples=300, database=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet=st.sampled_from("ab é_Z09[*].,\n\t  \u001c²ßç-"), max_size=40))
    def gather(t):
        texts.append(t)

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = text_statistics(df, "t").withColumns({"c": X.clean("t"), "w": X.words("t")}).collect()
    for r in rows:
        words = r["t"].split()
        assert r["c"] == python_clean(r["t"]), repr(r["t"])
        assert r["w"] == words
        assert (r["num_chars"], r["num_words"]) == (len(r["t"]), len(words))
        mean = sum(map(len, words)) / len(words) if words else 0
        assert abs(r["avg_word_length"] - mean) < 1e-12


def test_statistics_of_nothing(spark):
    for value in ("", None):
        df = spark.createDataFrame([(value,)], "t string")
        assert tuple(text_statistics(df, "t").drop("t").first()) == (0, 0, 0.0)


def test_keywords_are_substrings_in_list_order(spark):
    assert one(spark, "abnormal fluid", X.keywords("t")) == ["fluid", "normal"]
    assert one(spark, "", X.keywords("t")) == []


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), ([],), (["a"],)], "t array<string>")
    got = [r[0] for r in df.select(X.ngrams("t", 1, 3)).collect()]
    assert got == [["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"], [], ["a"]]
    assert [r[0] for r in df.select(X.ngrams("t", 2, 2)).collect()] == [["a b", "b c", "c d"], [], []]


DICTIONARY = [("walls", "wall"), ("was", "be"), ("thickened", "thicken"), ("ab", "abc"), ("longer", "lo")]


def test_token_modes(spark):
    df = spark.createDataFrame([(1, "the walls appear thickened ab x9 longer in 2d")], "id int, t string")
    dictionary = spark.createDataFrame(DICTIONARY, "form string, lemma string")
    plain = normalize_tokens(df, "t", "o").first()["o"]
    assert plain == "the walls appear thickened ab x9 longer in 2d"
    content = normalize_tokens(df, "t", "o", mode="content").first()["o"]
    assert content == "walls appear thickened longer"
    lemmas = normalize_tokens(df, "t", "o", mode="content", dictionary=dictionary, row_id=["id"]).first()["o"]
    assert lemmas == "wall appear thicken abc"


def test_lemma_paths_agree(spark):
    rows = [(i, ["walls", "x", "was"] * (i % 4) + ["ab"] * (i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    dictionary = spark.createDataFrame(DICTIONARY, "form string, lemma string")
    small = lemmatize(df, "w", dictionary, "l").orderBy("id").collect()
    joined = lemmatize(df, "w", dictionary, "l", ["id"], small_rows=0).orderBy("id").collect()
    assert [r["l"] for r in small] == [r["l"] for r in joined]
    assert small[5]["l"] == ["wall", "x", "be", "abc", "abc"]


def test_a_large_dictionary_moves_only_the_forms_that_rows_need(spark, monkeypatch):
    from gradeloom.operators import text_prep

    rows = [(i, ["walls", "was", f"x{i}", "walls", None] * 20) for i in range(50)] + [(None, ["ab"]), (50, None), (51, [])]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    moved, join = [], text_prep.lookup_join
    monkeypatch.setattr(text_prep, "lookup_join", lambda left, *a, **b: moved.append(left.count()) or join(left, *a, **b))
    out = lemmatize(df, "w", spark.createDataFrame(DICTIONARY, "form string, lemma string"), "l", ["id"], small_rows=0)
    got = {r["id"]: r["l"] for r in out.collect()}
    assert got == {**{i: ["wall", "be", f"x{i}", "wall"] * 20 for i in range(50)}, None: ["abc"], 50: [], 51: []}
    # Two forms of each of 50 rows and one of another; the rest is not in the dictionary (4,000 tokens before).
    assert 101 <= moved[0] <= 103


def test_prepared_columns(spark):
    df = spark.createDataFrame([("Free FLUID, 12 mm",), (None,)], "t string")
    rows = prepare_texts(df, "t").collect()
    assert (rows[0]["cleaned_text"], rows[0]["processed_text"], rows[0]["medical_keywords"]) == (
        "free fluid mm", "free fluid mm", ["fluid"])
    assert (rows[1]["cleaned_text"], rows[1]["medical_keywords"]) == ("", [])


def test_bind_evaluates_once(spark):
    df = spark.createDataFrame([([3, 1, 2],)], "a array<int>")
    got = df.select(X.bind(F.sort_array("a"), lambda s: F.transform(s, lambda x, i: x + i))).first()[0]
    assert got == [1, 3, 5]
