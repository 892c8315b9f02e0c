"""URL filters: rules first, then host word segmentation and multinomial naive Bayes.

A host such as ``freshbread`` is split by a unigram Viterbi search whose word counts come from the
pages' own texts. The words that could stand anywhere in a host meet their counts in a join, so no
dictionary is sent around; the search itself sees one host name at a time, at most 63 letters a
label. The segmented words of host and path are scored by multinomial naive Bayes, fitted on the
pages that rules or seed words judge. Every distinct pair of host and path shape is scored once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import ascii_lower

#: The rules of the sample query, as (verdict, host/path prefix).
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: Words whose hosts are examples of what to block, where no rule judges them.
SEEDS = ("ads", "adult", "bets", "casino", "pills", "poker", "porn", "spam")
LONGEST_WORD = 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to / ? # or the end, A-Z lower-cased; then up to ? or #."""
    parts = lambda group: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(parts(1)), parts(2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does.

    A rule is a host, which fits itself and all its subdomains, and from its first slash on a
    prefix of the path. Of rules of equal length the first by code point wins.
    """
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each run of a-z stands in the texts, tags left out."""
    plain = ascii_lower(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), "<[^<>]*>", " "))
    words = texts.select(F.explode(F.split(plain, "[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count("*").alias("n"))


def split_name(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words of a name; of equals the one with the longer last words.

    A word never seen has the chance of a tenth of one count for each letter beyond the first.
    """
    best = [0.0] + [-np.inf] * len(name)
    back = [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            n = known.get(word)
            chance = np.log(n / total) if n else -np.log(total) - np.log(10.0) * len(word)
            if best[start] + chance > best[end] + 1e-12:
                best[end], back[end] = best[start] + chance, start
    words, end = [], len(name)
    while end:
        words.append(name[back[end] : end])
        end = back[end]
    return words[::-1]


def segment_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names of a-z, by unigram counts (word, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("name"))
    pieces = names.select("name", F.explode(starts).alias("at")).select(
        "name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name") - F.col("at") + 1)), lambda n: F.substring("name", F.col("at"), n))).alias("word")
    ).distinct()
    # at most one entry per place and length of one name
    seen = pieces.join(counts, "word", "left").groupBy("name").agg(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known")
    )

    @F.arrow_udf("array<string>")
    def split(name: pa.Array, known: pa.Array) -> pa.Array:
        rows = zip(name.to_pylist(), known.to_pylist())
        return pa.array([split_name(x, {w["word"]: w["n"] for w in k}, total) for x, k in rows], pa.list_(pa.string()))

    return seen.select("name", split("name", "known").alias("words"))


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS, smoothing: float = 1.0
) -> DataFrame:
    """(row, page_id, host, path, rule, verdict, score) for every row of ``pages``.

    ``row`` is the page's own row. ``verdict`` is the longest fitting rule's; else block where the
    naive Bayes log-odds ``score`` of its words are above zero, and allow otherwise. A missing url
    or one without ``://`` has an empty host and path, fits no rule and scores the prior alone.
    Repeated rows are judged alike but each count as an example. Without an example of either kind
    every score is zero. No rows: no rows.
    """
    host, path = url_parts(F.col("url"))
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    shape = F.regexp_replace(ascii_lower(F.col("path")), "[0-9]+", "0")        # numbers are one word
    whole = whole.withColumns({"rule": rule, "says": says, "shape": shape})
    seeded = F.arrays_overlap(F.split("host", "[^a-z0-9]+"), F.array(*[F.lit(s) for s in seeds])) if seeds else F.lit(False)
    shapes = whole.groupBy("host", "shape").agg(
        F.sum((F.col("says") == "allow").cast("long")).alias("allowed"),
        F.sum(((F.col("says") == "block") | (F.col("says").isNull() & seeded)).cast("long")).alias("blocked"),
    ).na.fill(0)
    labels = shapes.select("host").distinct().select("host", F.explode(F.split("host", "[^a-z]+")).alias("name")).filter("name <> ''")
    split = segment_names(labels.select("name").distinct(), word_counts(pages, "html"))
    host_words = labels.join(split, "name").select("host", F.explode("words").alias("word")).select("host", F.concat(F.lit("h:"), "word").alias("word"))
    path_words = shapes.select("host", "shape", F.explode(F.split("shape", "[^a-z0-9]+")).alias("word")).filter("word <> ''")
    words = path_words.select("host", "shape", F.concat(F.lit("p:"), "word").alias("word")).unionByName(
        shapes.select("host", "shape").join(host_words, "host")
    )
    examples = words.join(shapes, ["host", "shape"])
    weights = examples.groupBy("word").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    a, b, v = weights.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    pa_, pb = shapes.agg(F.sum("allowed"), F.sum("blocked")).first()
    if not (a and b):
        scored = shapes.select("host", "shape", F.lit(0.0).alias("score"))
    else:
        odds = F.log((F.col("b") + smoothing) / (b + smoothing * v)) - F.log((F.col("a") + smoothing) / (a + smoothing * v))
        prior = float(np.log(pb / pa_)) if pa_ and pb else 0.0
        told = words.join(weights.select("word", odds.alias("odds")), "word").groupBy("host", "shape").agg(F.sum("odds").alias("odds"))
        scored = shapes.select("host", "shape").join(told, ["host", "shape"], "left").select(
            "host", "shape", (F.coalesce("odds", F.lit(0.0)) + prior).alias("score")
        )
    verdict = F.coalesce("says", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return whole.join(scored, ["host", "shape"]).select("row", "page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
