import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from shelfspark.llm import url_filter as U
from tests.conftest import SF_SMALL


def parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "http://x.www.example.com/en/",
            "http://com/", "http://com", "http://notexample.com/en/", "http://a.net/es/q", "http://net/fr/", "ftp://É.net/de/", "a://b://c.com/x",
            "http://a.com?x/en/", "http://example.com/EN/"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(None, urls[4], "v"), (4, urls[4], "v")], "page_id long, url string, verdict string")
    got = U.filter_urls(df).collect()
    assert len(got) == len(urls) + 2
    for x in got:
        u = urls[4 if x["page_id"] is None else x["page_id"]]
        host, path = parse(u)
        assert (x["host"], x["path"]) == (host, path), u
        name, verdict = rule(host, path)
        assert x["rule"] == name and (verdict is None or x["verdict"] == verdict), u
        assert x["verdict"] in ("allow", "block")
    assert U.filter_urls(df.limit(0)).count() == 0


def brute_scores(urls, aside, order=4):
    shown = lambda u: (lambda h: h + u.split("://", 1)[1][len(h):])(parse(u)[0])
    counts = {v: [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)] for v in ("allow", "block")}
    letters = set()
    for u in urls:
        s = "\x02" * order + shown(u) + "\x03"
        letters |= set(s[order:])
        v = rule(*parse(u))[1]
        if v and not aside[u]:
            for i in range(order, len(s)):
                for k in range(order + 1):
                    counts[v][k][s[i - k:i]][s[i]] += 1

    def p(v, context, c):
        out = 1 / (len(letters) + 1)
        for k in range(order + 1):
            f = counts[v][k].get(context[order - k:])
            if f:
                out = (f.get(c, 0) + len(f) * out) / (sum(f.values()) + len(f))
        return out

    scores = {}
    for u in urls:
        s = "\x02" * order + shown(u) + "\x03"
        logs = [math.log(p("allow", s[i - order:i], s[i]) / p("block", s[i - order:i], s[i])) for i in range(order, len(s))]
        scores[u] = sum(logs) / len(logs)
    return scores


def test_scores_and_cutoff_against_plain_python(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    got = U.filter_urls(pages).join(pages, "page_id").collect()
    urls = sorted({x["url"] for x in got})
    part = spark.createDataFrame([(u,) for u in urls], "url string").select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("a"))
    aside = {x["url"]: x["a"] for x in part.collect()}
    want = brute_scores(urls, aside)
    assert all(abs(x["score"] - want[x["url"]]) < 1e-6 for x in got)
    held = [(want[u], rule(*parse(u))[1]) for u in urls if aside[u] and rule(*parse(u))[1]]
    n = {v: sum(w == v for _, w in held) for v in ("allow", "block")}
    errors = lambda cut: (sum(v == "allow" and math.floor(s * 1000) < cut for s, v in held) * n["block"]
                          + sum(v == "block" and math.floor(s * 1000) >= cut for s, v in held) * n["allow"])
    cut = got[0]["cutoff"]
    assert errors(round(cut * 1000)) == min(errors(math.floor(s * 1000)) for s, _ in held)
    assert all(x["verdict"] == ("allow" if x["score"] >= cut else "block") for x in got if x["rule"] is None)
