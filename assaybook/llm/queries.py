"""The operators over their whole sample tables, each with check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_codec, line_dedup, lpf_dedup, mixing, multi_index, ngram_join, pii, piece_codec, pivot_clusters, quality_trees, token_counts, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def vocabulary(name: str) -> str:
    """Where the machine keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).drop("row")


LINES_SQL = r"""
with lines as materialized (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as materialized (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as materialized (
  select key, min(doc_id) as first from keyed where length(key) >= 10
  group by key having count(distinct doc_id) >= 2),
judged as (
  select k.doc_id, k.pos, k.line, s.key is not null and k.doc_id <> s.first as gone
  from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query("op6_quality_trees")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_trees.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op7_pivotal_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.mix_units(table(spark, sf_dir, "documents"))
    rows = units.select("*", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return rows.select(
        F.col("doc").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query("op10_piece_codec")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


@query("op3_multi_index")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("row")


@query("op9_ngram_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(table(spark, sf_dir, "documents")).select(
        F.col("doc").alias("doc_id"), "n_shingles", "component_id", "n_links"
    )


PASSAGES_SQL = """
with blocks as materialized (
  select doc_id, b * 500 as base, substring(hex(encode(coalesce(text, ''))), cast(b * 1000 + 1 as bigint), 1098) as part
  from (select doc_id, text, unnest(range(0, greatest(1, (octet_length(encode(coalesce(text, ''))) + 499) // 500))) as b from documents)),
windows as materialized (
  select doc_id, base + i as pos, substring(part, cast(2 * i + 1 as bigint), 100) as w
  from (select doc_id, base, part, unnest(range(0, least(500, length(part) // 2 - 49))) as i from blocks where length(part) >= 100)),
firsts as materialized (select w, min(doc_id) as doc_id from windows group by w having min(doc_id) <> max(doc_id)),
later as materialized (
  select windows.doc_id, pos from windows join firsts using (w) where windows.doc_id > firsts.doc_id),
runs as (
  select doc_id, min(pos) as s, max(pos) + 50 as e
  from (select doc_id, pos, sum(fresh) over (partition by doc_id order by pos) as run
        from (select doc_id, pos, (coalesce(pos - lag(pos) over (partition by doc_id order by pos), 51) > 50)::int as fresh from later))
  group by doc_id, run),
gaps as (
  select doc_id, s, e, coalesce(lag(e) over (partition by doc_id order by s), 0) as before,
         row_number() over (partition by doc_id order by s desc) = 1 as last from runs),
cut as (
  select d.doc_id, any_value(hex(encode(coalesce(d.text, '')))) as h, coalesce(sum(e - s), 0) as n_removed, count(s) as n_spans,
         string_agg(substring(hex(encode(coalesce(d.text, ''))), cast(2 * before + 1 as bigint), cast(2 * (s - before) as bigint)), '' order by s) as kept,
         max(e) as e
  from documents d left join gaps on d.doc_id = gaps.doc_id group by d.doc_id)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(n_removed as bigint) as n_removed, cast(n_spans as bigint) as n_spans,
       sha256(unhex(case when e is null then h else kept || substring(h, cast(2 * e + 1 as bigint)) end)) as kept_sha256
from cut
"""


@query("op2_suffix_dedup", PASSAGES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


@query("op1_personal_data")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base, added = pii.span_list(F.col("base")), pii.span_list(F.col("added"))
    return found.select(
        "doc_id", *[count(kind) for kind in pii.KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(added, F.lit(""))).alias("spans"),
    )


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    lined = alignment.align_tokenizers(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups"), 256))
    return lined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


@query("op13_byte_codec")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    coded = byte_codec.encode_documents(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _clusters_sql(rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    steps = []
    for r in range(rounds + 1):
        # distance and number in one integer, so that its minimum breaks ties
        steps.append(f"""
near{r} as materialized (
  select id, min(16 * cast(list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) as bigint) + k) as m
  from kept, centroids{r} group by id)""")
        if r < rounds:
            steps.append(f"""
sums{r} as (
  select k, i, sum(x) as s, count(*) as n
  from (select m % 16 as k, unnest(v) as x, generate_subscripts(v, 1) as i from kept join near{r} using (id)) group by k, i),
centroids{r + 1} as materialized (
  select old.k, coalesce(new.c, old.c) as c
  from centroids{r} old left join (select k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from sums{r} group by k) new using (k))""")
    return f"""
with kept as materialized (
  select row_number() over () as id, vec_id, embedding, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(embedding) = 64),
centroids0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id) nulls last, embedding) - 1 as k, v as c from kept qualify k < 16),{",".join(steps)},
told as (
  select k, any_value(c) as c, cast(sum(m // 16) as bigint) as s from near{rounds} join centroids{rounds} on m % 16 = k group by k)
select vec_id, cast(m % 16 as integer) as cluster, cast(m // 16 as bigint) as distance, s as cluster_inertia,
       cast((select sum(s) from told) as bigint) as inertia, sha256(list_aggregate(c, 'string_agg', ',')) as centroid_sha256
from kept join near{rounds} using (id) join told on m % 16 = k
"""


@query("op12_pivot_clusters", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")
