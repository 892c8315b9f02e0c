"""Queries over the key corpus: standardizing, subsets, leakage, sparse labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keys, splits
from ..session import stage
from . import bindings as b
from .catalog import query

_FIXED = """sides AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id))
                      <= round_even(0.1 * count(*) OVER (), 0) THEN 'val' ELSE 'train' END AS side
  FROM std WHERE canonical IS NOT NULL)"""


def _standard(spark, sf):
    return keys.standardize_keys(b.corpus(spark, sf), "text", keys.text_canonical)[0].drop("text")


def _sides(spark, sf):
    std = stage(_standard(spark, sf).select("doc_id", "lang", "canonical"), "std")
    return splits.fixed_split(std, std.count(), "doc_id")


@query("standardize_keys", f"""
WITH {b.CORPUS}, {b.CANONICAL}
SELECT row_id, doc_id, canonical, stripped FROM std WHERE canonical IS NOT NULL""")
def standardize_keys(spark, sf):
    return _standard(spark, sf).select("row_id", "doc_id", "canonical", "stripped")


@query("standardize_counts", f"""
WITH {b.CORPUS}, {b.CANONICAL}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE canonical IS NULL) AS failed,
       count(*) FILTER (WHERE stripped AND canonical IS NOT NULL) AS stripped FROM std""")
def standardize_counts(spark, sf):
    kept, counts = keys.standardize_keys(b.corpus(spark, sf), "text", keys.text_canonical)
    kept.agg(F.count("*")).collect()
    n = counts.get
    return spark.createDataFrame([(n["rows"], n["failed"], n["stripped"])],
                                 "n_rows long, failed long, stripped long")


@query("largest_fragment", """
WITH parts AS (
  SELECT doc_id, list_filter(list_transform(string_split(trim(text), '.'), lambda s: trim(s)), lambda s: length(s) > 0) AS p
  FROM documents)
SELECT doc_id, list_reduce(p, lambda a, c: CASE WHEN length(c) > length(a) THEN c ELSE a END) AS canonical,
       len(p) > 1 AS stripped
FROM parts WHERE len(p) > 0""")
def largest_fragment(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return keys.standardize_keys(docs, "text")[0].drop("text")


@query("seeded_subset", f"""
WITH {b.CORPUS}, {b.CANONICAL}
SELECT row_id, doc_id, canonical FROM (
  SELECT *, row_number() OVER (ORDER BY md5('7:' || row_id)) AS rn FROM std WHERE canonical IS NOT NULL)
WHERE rn <= 250""")
def seeded_subset(spark, sf):
    std = stage(_standard(spark, sf), "std")
    return keys.seeded_subset(std, 250, 7).select("row_id", "doc_id", "canonical")


@query("subset_counts", f"""
WITH {b.CORPUS}, {b.CANONICAL}, ranked AS (
  SELECT *, md5('7:' || row_id) AS h FROM std),
cut AS (SELECT max(h) AS c FROM (SELECT h FROM ranked WHERE canonical IS NOT NULL ORDER BY h LIMIT 250))
SELECT count(*) FILTER (WHERE canonical IS NOT NULL) AS kept, count(*) FILTER (WHERE canonical IS NULL) AS failed,
       count(*) FILTER (WHERE stripped AND canonical IS NOT NULL) AS stripped FROM ranked, cut WHERE h <= c""")
def subset_counts(spark, sf):
    return keys.subset_counts(b.corpus(spark, sf), 250, 7, keys.text_canonical, "row_id", "text")


@query("fixed_split", f"""
WITH {b.CORPUS}, {b.CANONICAL}, {_FIXED}
SELECT doc_id, lang, side FROM sides WHERE canonical IS NOT NULL""")
def fixed_split(spark, sf):
    return _sides(spark, sf).select("doc_id", "lang", "side")


@query("drop_leakage", f"""
WITH {b.CORPUS}, {b.CANONICAL}, {_FIXED}
SELECT doc_id, canonical FROM sides
WHERE side = 'train' AND canonical NOT IN (SELECT canonical FROM sides WHERE side = 'val')""")
def drop_leakage(spark, sf):
    sides = _sides(spark, sf)
    train, val = sides.filter("side = 'train'"), sides.filter("side = 'val'")
    return keys.drop_leakage(train, [val], "canonical").select("doc_id", "canonical")


@query("held_out_keys", f"""
WITH {b.CORPUS}, {b.CANONICAL}, {_FIXED}
SELECT DISTINCT canonical FROM sides WHERE side = 'val' AND canonical IS NOT NULL""")
def held_out_keys(spark, sf):
    val = stage(_sides(spark, sf).filter("side = 'val'"), "val")
    languages = [r["lang"] for r in val.select("lang").distinct().collect()]          # a held-out set for each
    return keys.held_out_keys([val.filter(F.col("lang").eqNullSafe(F.lit(name))) for name in languages], "canonical")


@query("split_overlap", f"""
WITH {b.CORPUS}, {b.CANONICAL}, {_FIXED}
SELECT canonical FROM sides WHERE side = 'train' INTERSECT SELECT canonical FROM sides WHERE side = 'val'""")
def split_overlap(spark, sf):
    sides = _sides(spark, sf)
    return splits.overlap(sides.filter("side = 'train'"), sides.filter("side = 'val'"), "canonical")


@query("filter_key_length", f"""
WITH {b.CORPUS}, {b.CANONICAL}
SELECT row_id, canonical FROM std WHERE length(canonical) < 100""")
def filter_key_length(spark, sf):
    return keys.filter_key_length(_standard(spark, sf), "canonical").select("row_id", "canonical")


@query("harmonize_labels", """
SELECT d.doc_id AS key, lang AS grp, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def harmonize_labels(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left").withColumns(
        {"quality": F.col("quality").cast("double"), "toxic": F.col("toxic").cast("double")})
    return keys.harmonize(joined, {"key": "doc_id", "grp": "lang", "quality": "quality", "toxic": "toxic"},
                          ["key", "quality", "toxic"])


@query("dropna_targets", """
WITH sparse AS (SELECT d.doc_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE END AS quality,
                       CASE WHEN toxic = 0 THEN length(text)::DOUBLE END AS size
                FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'single' AS recipe, count(*) AS n_rows, count(size) AS n_size FROM sparse WHERE quality IS NOT NULL
UNION ALL SELECT 'multi', count(*), count(size) FROM sparse""")
def dropna_targets(spark, sf):
    docs, labels = b.table(spark, sf, "documents"), b.table(spark, sf, "labels")
    sparse = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, 1.0).alias("quality"),
        F.when(F.col("toxic") == 0, F.length("text").cast("double")).alias("size"))
    single, multi = keys.apply_dropna(sparse, ["quality"], True), keys.apply_dropna(sparse, ["quality", "size"], False)
    count = lambda df, name: df.agg(F.count("*").alias("n_rows"), F.count("size").alias("n_size")).select(
        F.lit(name).alias("recipe"), "n_rows", "n_size")
    return count(single, "single").unionByName(count(multi, "multi"))
