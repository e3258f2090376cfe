import math
import zlib
from collections import Counter

from gradeloom.llm import url_filter as m
from gradeloom.llm.queries import URL_RULES, op10_url_filter
from tests.conftest import SF

PAGES = "page_id long, url string, host int, score string"


def split(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return rest[:cut].translate(str.maketrans(m.UPPER, m.LOWER)), path[:end]


def rule(host, path):
    fit = [(len(r), v == "block", r, v) for r, v in URL_RULES
           if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit)[2:] if fit else (None, None)


def brute(rows):
    label = {u or "": rule(*split(u))[1] for _, u, *_ in rows}
    held = {u for u in label if zlib.crc32(u.encode()) % m.HOLD_OUT == 0}

    def grams(u):
        s = "\x02" * m.ORDER + u.lower() + "\x03"
        return [s[i:i + m.ORDER + 1] for i in range(len(u) + 1)]

    count = {v: Counter(g[-k - 1:] for u in label if label[u] == v and u not in held for g in grams(u) for k in range(m.ORDER + 1))
             for v in ("allow", "block")}

    def prob(v, g, k):
        if k < 0:
            return 1 / m.ALPHABET
        tail = g[-k - 1:]
        after = [n for x, n in count[v].items() if len(x) == k + 1 and x[:-1] == tail[:-1]]
        return (count[v][tail] + len(after) * prob(v, g, k - 1)) / (sum(after) + len(after)) if after else prob(v, g, k - 1)

    score = {u: sum(round(math.log(prob("allow", g, m.ORDER) / prob("block", g, m.ORDER)) * 1e6) for g in grams(u)) / (len(u) + 1) / 1e6
             for u in label}
    per = {v: [score[u] for u in held if label[u] == v] for v in ("allow", "block")}
    mean = {v: sum(x) / len(x) for v, x in per.items()}
    sd = {v: math.sqrt(sum((y - mean[v]) ** 2 for y in x) / len(x)) + 1e-9 for v, x in per.items()}
    cut = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / (sd["allow"] + sd["block"])
    return [(i, *split(u), rule(*split(u))[0], label[u or ""] or ("allow" if score[u or ""] >= cut else "block"), score[u or ""])
            for i, u, *_ in rows]


def test_against_brute_force(spark):
    rows = [(r.page_id, r.url, 0, "") for r in spark.read.parquet(SF + "/pages.parquet").collect()]
    rows += [(None, None, 1, ""), (7, "", 1, ""), (7, "no scheme", 1, ""), rows[0], (8, "a://B.Example.ORG/es/x?y://z", 1, ""),
             (9, "ftp://x.com", 1, ""), (10, "http://x.net/" + "é" * 30_000, 1, "")]
    got = sorted(map(tuple, m.judge_urls(spark.createDataFrame(rows, PAGES), URL_RULES).collect()), key=str)
    for a, b in zip(got, sorted(brute(rows), key=str), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5


def test_defined_results(spark):
    empty = spark.createDataFrame([], PAGES)
    assert m.judge_urls(empty, URL_RULES).collect() == []
    one = spark.createDataFrame([(1, "http://a.net/x", 0, "")], PAGES)
    assert tuple(m.judge_urls(one, URL_RULES).first()) == (1, "a.net", "/x", None, "allow", 0.0)
    assert m.judge_urls(one, []).first().rule is None


def test_no_python_in_the_plan(spark):
    assert "Python" not in op10_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
