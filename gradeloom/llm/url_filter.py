"""URL filter by a ratio of two character language models, in DataFrame functions only.

URLs that a rule accepts and URLs that a rule rejects each train a variable-order Markov model over characters
(contexts of up to ``ORDER``, Witten-Bell smoothing: an unseen context falls back to the next shorter one).
A URL's score is the difference of the two log-likelihoods over its length. One in ``HOLD_OUT`` of the
labelled URLs stays out of the counts and sets the threshold, where both classes lie equally many
standard deviations from their means.

Models are counted over all rows. Probabilities are worked out once for each distinct gram, so URLs
only look up one number a character; sums are of integers (1e-6 of a nat) and don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.storage import stored

ORDER = 3
HOLD_OUT = 5
ALPHABET = 256
MICRO = 1_000_000
BROADCAST_GRAMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]  # ("org/", "allow"): host and path as one text; verdict allow or block


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path: between the first :// and / ? # or the end; from there up to ? # or the end."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def matching_rule(host: F.Column, path: F.Column, rules: list[Rule]) -> F.Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain and begins the path.

    Of rules of equal length block comes first, then the text decides. Null without a fitting rule.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    chosen = None
    for text, verdict in sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != "block", r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def _grams(urls: DataFrame, *cols: str) -> DataFrame:
    """One row for each character and the end mark, with the ORDER characters before it."""
    padded = F.concat(F.lit("\u0002" * ORDER), F.lower("url"), F.lit("\u0003"))
    return urls.select(*cols, padded.alias("s"), F.explode(F.sequence(F.lit(1), F.length(padded) - ORDER)).alias("i")).select(
        *cols, F.expr(f"substring(s, i, {ORDER + 1})").alias("gram"))


def _log_ratios(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """gram, micro: log p(accepted) - log p(rejected) of the last character after the ones before it."""
    out = wanted
    p = {c: F.lit(1.0 / ALPHABET) for c in "ar"}
    for k in range(ORDER + 1):
        tail = F.expr(f"right(gram, {k + 1})")
        own = counts.groupBy(tail.alias(f"g{k}")).agg(F.sum("a").alias(f"na{k}"), F.sum("r").alias(f"nr{k}"))
        context = F.expr(f"left(g{k}, {k})")
        before = own.groupBy(context.alias(f"c{k}")).agg(*[
            f for c in "ar" for f in (F.sum(f"n{c}{k}").alias(f"t{c}{k}"), F.count_if(F.col(f"n{c}{k}") > 0).alias(f"d{c}{k}"))])
        out = out.join(own, tail == F.col(f"g{k}"), "left").drop(f"g{k}")
        out = out.join(before, F.expr(f"left(right(gram, {k + 1}), {k})") == F.col(f"c{k}"), "left").drop(f"c{k}")
        for c in "ar":
            n, t, d = (F.coalesce(F.col(f"{x}{c}{k}"), F.lit(0)) for x in "ntd")
            out = out.withColumn(f"p{c}", F.when(t + d > 0, (n + d * p[c]) / F.greatest(t + d, F.lit(1))).otherwise(p[c]))
        out = out.select("gram", "pa", "pr")
        p = {c: F.col(f"p{c}") for c in "ar"}
    return out.select("gram", F.round((F.log("pa") - F.log("pr")) * MICRO).cast("long").alias("micro"))


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict, score: a row for each row of ``pages``.

    The rule decides where one fits, else the score against the calibrated threshold (allow at or above it).
    A null url counts as empty. Without accepted or without rejected URLs the score is 0 and the verdict allow;
    a class without held-out URLs leaves the threshold at 0. Repeated rows stay; ids are not looked at.
    Rules are a list passed by the caller, and part of the plan. Models look at distinct urls.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    host, path = split_url(F.col("url"))
    with_rule = rows.withColumns({"host": host, "path": path}).withColumn(
        "hit", matching_rule(F.col("host"), F.col("path"), rules))
    urls = stored(with_rule.groupBy("url").agg(F.first("hit.verdict").alias("label")))  # a url has one label
    trained = urls.filter(F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HOLD_OUT)) != 0))
    counts = stored(_grams(trained, "label").groupBy("gram").agg(
        F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("r")))
    ratios = stored(_log_ratios(_grams(urls).distinct(), counts))
    small = F.broadcast if ratios.count() <= BROADCAST_GRAMS else (lambda df: df)
    sums = _grams(urls, "url", "label").join(small(ratios), "gram").groupBy("url", "label").agg(F.sum("micro").alias("micro"))
    scores = stored(sums.select("url", "label", (F.col("micro") / (F.length("url") + 1) / MICRO).alias("score")))
    threshold = _threshold(scores, counts)
    judged = with_rule.join(scores.select("url", "score"), "url", "left")
    usable = threshold is not None
    score = F.coalesce("score", F.lit(0.0)) if usable else F.lit(0.0)
    return judged.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(score >= (threshold or 0.0), "allow").otherwise("block")).alias("verdict"),
        score.alias("score"))


def _threshold(scores: DataFrame, counts: DataFrame) -> float | None:
    """Between the held-out means, weighted by the other class's deviation; None without both models."""
    seen = counts.agg(F.sum("a"), F.sum("r")).first()
    if not (seen[0] and seen[1]):
        return None
    held = scores.filter(F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(HOLD_OUT)) == 0))
    per = {r.label: r for r in held.groupBy("label").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).collect()}
    if len(per) < 2:
        return 0.0
    a, r = per["allow"], per["block"]
    return (a.m * (r.s + 1e-9) + r.m * (a.s + 1e-9)) / (a.s + r.s + 2e-9)
