"""Text expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions import patterns as P
from gradeloom.functions.stopwords import ENGLISH


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is computed again for every element, and one used
    several times may be computed as often. A lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(col: Column | str) -> Column:
    """Trim every Unicode white-space character, in time linear in what is trimmed."""
    return F.trim(_c(col), F.lit(P.SPACE_CHARS))


def filled(col: Column | str) -> Column:
    return F.coalesce(_c(col), F.lit(""))


def first_match(col: Column | str, pattern: str, *, ignore_case: bool = False) -> Column:
    """First group of the first match, NULL without a match.

    For patterns whose group is never empty: ``regexp_extract`` returns '' only
    when nothing matched, so one regex pass answers both questions.
    """
    flags = "(?iud)" if ignore_case else "(?d)"
    return F.nullif(F.regexp_extract(_c(col), flags + pattern, 1), F.lit(""))


def section(col: Column | str, heading: str, stop: str, *, multiline: bool = True) -> Column:
    """Trimmed text after ``heading`` up to ``stop``; '' if empty, NULL if absent.

    The whole match always holds the heading, so it is '' only when the section
    is absent. The heading is then cut off the (short) match, not off the report.
    """
    flags = "(?iuds)" if multiline else "(?iud)"
    lead = rf"{heading}[:{P.SPACE}]*"
    whole = F.nullif(F.regexp_extract(_c(col), rf"{flags}{lead}(.*?)(?={stop})", 0), F.lit(""))
    return strip(F.regexp_replace(whole, rf"(?iud)\A{lead}", F.lit("")))


def contains_any(col: Column | str, terms: Iterable[str]) -> Column:
    hit = None
    for term in terms:
        one = F.contains(_c(col), F.lit(term))
        hit = one if hit is None else hit | one
    return hit


def grade(lowered: Column | str, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """First rule with a matching substring; ``lowered`` is already lower case."""
    chain = None
    for label, terms in rules:
        hit = contains_any(lowered, terms)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(default))


def report_grade(lowered: Column | str) -> Column:
    """Severity of a section; an absent section has no severity."""
    return F.when(_c(lowered).isNotNull(),
                  grade(lowered, P.REPORT_GRADES, P.REPORT_GRADE_DEFAULT))


def response_grade(response: Column | str) -> Column:
    """Severity named in a responder's free text; a missing answer is unknown."""
    return grade(strip(F.lower(_c(response))), P.RESPONSE_GRADES, P.RESPONSE_GRADE_DEFAULT)


def case_id(text: Column | str, name: Column | str) -> Column:
    return F.coalesce(first_match(text, P.CASE_ID_IN_TEXT), first_match(name, P.CASE_ID_IN_NAME))


def exam_date(text: Column | str) -> Column:
    return F.coalesce(*[first_match(text, f"{prefix}.*?{P.MONTH_DAY_YEAR}", ignore_case=True)
                        for prefix in P.EXAM_DATE_PREFIXES])


def number_of(col: Column | str, pattern: str) -> Column:
    return first_match(col, pattern, ignore_case=True).try_cast("double")


def clean(text: Column | str) -> Column:
    """Lower case without digits, ``[*...*]`` masks and punctuation, single-spaced.

    Digits go before masks, and underscores count as word characters.
    """
    out = F.lower(filled(text))
    out = F.regexp_replace(out, f"{P.DIGIT}+", F.lit(""))
    out = F.regexp_replace(out, r"(?d)\[\*.*?\*\]", F.lit(""))
    # Punctuation and white space both end up as one space, so one class covers
    # "replace by a space" and "collapse spaces".
    out = F.regexp_replace(out, f"[^{P.WORD}]+", F.lit(" "))
    return F.trim(out)


def words(text: Column | str) -> Column:
    """White-space separated tokens; [] for empty or missing text."""
    return F.filter(F.split(filled(text), f"[{P.SPACE}]+"), lambda w: w != "")


def keywords(text: Column | str, terms: Sequence[str] = P.KEYWORDS) -> Column:
    """Terms that occur as substrings, in the order of ``terms``."""
    def found(lowered: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t)), F.lit(t)) for t in terms]))

    return bind(F.lower(filled(text)), found)


def keyword_items(col: Column | str, *, keep_empty: bool) -> Column:
    """Items of a comma-separated keyword string, trimmed."""
    items = F.transform(F.split(_c(col), ","), lambda k: strip(k))
    return items if keep_empty else F.filter(items, lambda k: k != "")


def content_words(tokens: Column | str, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Alphabetic tokens that are not stop words (lengths are judged on the lemma)."""
    stops = list(stop_words)
    return F.filter(_c(tokens), lambda t: F.rlike(t, F.lit(r"\A\p{L}+\z")) & ~t.isin(stops))


def ngrams(tokens: Column | str, low: int, high: int) -> Column:
    """All n-grams of ``low`` to ``high`` tokens, joined by one space."""
    def of(toks: Column) -> Column:
        gram, parts = toks, [toks] if low == 1 else []
        for n in range(2, high + 1):
            # Each n-gram is the (n-1)-gram at its place and the token n - 1 places on.
            count = F.greatest(F.size(toks) - (n - 1), F.lit(0))
            gram = F.zip_with(F.slice(gram, F.lit(1), count), F.slice(toks, F.lit(n), count),
                              lambda g, t: F.concat(g, F.lit(" "), t))
            if n >= low:
                parts.append(gram)
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return bind(_c(tokens), of)


def term_tokens(text: Column | str, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Runs of two or more word characters, lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(filled(text)), F.lit(f"[{P.WORD}]{{2,}}"), F.lit(0))
    stops = list(stop_words)
    return F.filter(found, lambda t: ~t.isin(stops)) if stops else found


def terms(text: Column | str, ngram_range: tuple[int, int] = (1, 2),
          stop_words: Sequence[str] = ENGLISH) -> Column:
    return ngrams(term_tokens(text, stop_words), *ngram_range)
