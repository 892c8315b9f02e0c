"""Parts, rules, segmentation and verdicts by hand."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.llm import url_filter as u

SCHEMA = "page_id long, url string, html string, host string, word string, row string, score double"


def frame(spark, urls, html="<p>fresh bread and fresh butter from the bakery</p>"):
    return spark.createDataFrame([(i, x, html, "h", "w", "r", 0.5) for i, x in enumerate(urls)], SCHEMA).repartition(2)


def test_parts(spark):
    cases = {
        "http://WWW.Example.ORG/A/b?q#f": ("www.example.org", "/A/b"), "x://h#a/b": ("h", ""), "http://h?x/y": ("h", ""), "a://b://c/d": ("b:", "//c/d"),
        "no scheme/path": ("", ""), "": ("", ""), None: ("", ""), "://é.com/ü": ("é.com", "/ü"), "http://": ("", ""), "http://h\n.x/a\nb#": ("h\n.x", "/a\nb"),
    }
    df = frame(spark, list(cases)).select("page_id", "url", *[c.alias(n) for c, n in zip(u.url_parts(F.col("url")), ("h", "p"))])
    for r in df.collect():
        assert (r["h"], r["p"]) == cases[r["url"]]


def rule_by_hand(host, path):
    best = (None, None)
    for says, rule in u.RULES:
        domain, slash, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + rest) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, says)
    return best


def test_rules(spark):
    urls = [f"http://{h}{p}" for h in ("a.org", "org", "xorg", "example.org", "b.example.org", "notexample.org", "x.com", "com", "n.net")
            for p in ("", "/", "/es/1", "/es", "/en/1", "/en/123", "/en/2", "/fr/9", "/de/", "/de", "/DE/1")]
    rows = u.judge_urls(frame(spark, urls)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        rule, says = rule_by_hand(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and (says is None or r["verdict"] == says)


def test_segmentation_is_the_most_probable_split():
    known = {"fresh": 40, "bread": 30, "breadth": 2, "the": 90, "her": 20, "there": 25, "re": 8, "fre": 1}
    total = 1000

    def score(words):
        return sum(np.log(known[w] / total) if w in known else -np.log(total) - np.log(10) * len(w) for w in words)

    for name in ("freshbread", "thereher", "breadthe", "qqfresh", "a", "there", "freshthere"):
        splits = [[name[a:b] for a, b in zip((0, *cut), (*cut, len(name)))] for k in range(len(name)) for cut in combinations(range(1, len(name)), k)]
        got = u.split_name(name, known, total)
        assert "".join(got) == name and score(got) == pytest.approx(max(map(score, splits)))
    assert u.split_name("freshbread", known, total) == ["fresh", "bread"]


def test_names_meet_their_counts(spark):
    names = spark.createDataFrame([("freshbread",), ("butter",), ("zzz",)], "name string")
    got = {r["name"]: r["words"] for r in u.segment_names(names, u.word_counts(frame(spark, ["http://a"]), "html")).collect()}
    assert got["freshbread"] == ["fresh", "bread"] and got["butter"] == ["butter"] and "".join(got["zzz"]) == "zzz"


def test_bayes_blocks_what_looks_like_blocked(spark):
    urls = [f"http://freshbread{i}.net/list/{i}" for i in range(3)] + [f"http://freshbread.org/list/{i}" for i in range(20)]
    urls += [f"http://cheap-pills.x{i}.net/buy/{i}" for i in range(20)] + ["http://cheapbuy.net/buy/7", "http://bread.net/list/7"]
    got = {r["host"] + r["path"]: r["verdict"] for r in u.judge_urls(frame(spark, urls)).collect()}
    assert got["cheapbuy.net/buy/7"] == "block" and got["bread.net/list/7"] == "allow"


def test_messy_rows(spark):
    urls = [None, "", "http://a.org/x", "http://a.org/x", "nothing", "http://" + "y" * 3000 + ".com/" + "z" * 20000, "http://例え.jp/パス"]
    df = frame(spark, urls, html=None)
    rows = u.judge_urls(df).collect()
    assert sorted(map(str, df.collect())) == sorted(str(r["row"]) for r in rows)
    assert all(r["verdict"] == "allow" and r["score"] == 0 for r in rows)          # no example of what to block
    assert u.judge_urls(df.limit(0)).isEmpty()
