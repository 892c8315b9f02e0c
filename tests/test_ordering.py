import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.operators import ordering


@pytest.fixture
def skewed(spark):
    """One group holds most rows; values repeat."""
    rng = np.random.default_rng(0)
    rows = [("hot" if i % 4 else f"g{i % 7}", int(rng.integers(0, 50)), int(rng.integers(1, 4)), i) for i in range(2000)]
    return rows, spark.createDataFrame(rows, "g string, v int, w int, id int")


def test_row_id_is_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")).repartition(7)
    got = {r["v"]: r["row_id"] for r in ordering.with_row_id(df, ["v"]).collect()}
    assert got == {v: v for v in range(5000)}


def test_running_total(skewed):
    rows, df = skewed
    got = {r["id"]: (r["before"], r["total"]) for r in ordering.running_total(df, ["g"], ["v", "id"], "w").collect()}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3]))
        total, seen = sum(r[2] for r in members), 0
        for r in members:
            assert got[r[3]] == (seen, total)
            seen += r[2]


def test_value_ranks_and_quantiles(skewed):
    rows, df = skewed
    got = {(r["g"], r["v"]): r["rank"] for r in ordering.value_ranks(df.withColumn("one", F.lit(1)), ["g"], "v", "one").collect()}
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 1.0]
    cuts = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in
            ordering.quantiles(df.withColumn("v", F.col("v").cast("double")), ["g"], "v", probs, [f"q{i}" for i in range(6)]).collect()}
    for g in {r[0] for r in rows}:
        values = np.array([r[1] for r in rows if r[0] == g], float)
        for v in np.unique(values):
            assert got[(g, int(v))] == (values < v).sum() + ((values == v).sum() + 1) / 2
        np.testing.assert_allclose(cuts[g], np.quantile(values, probs), atol=1e-9)


def test_hash_cutoff(spark):
    ids = spark.range(3000)
    hashes = sorted(hashlib.md5(f"7:{i}".encode()).hexdigest() for i in range(3000))
    df = ids.select(ordering.hash_order(7, "id").alias("h"))
    for n in (1, 2, 777, 3000):
        assert ordering.hash_cutoff(df, n) == hashes[n - 1]
    assert ordering.hash_cutoff(df, 3001) is None
    assert df.filter(F.col("h") <= ordering.hash_cutoff(df, 0)).count() == 0


def test_hot_group_is_spread(spark):
    """Sorting a single group uses several partitions, not one."""
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.rand(1).alias("v"), "id")
    slices = ordering._sorted_slices(df, ["g", "v", "id"]).groupBy("_slice").count().collect()
    assert len(slices) > 1 and max(r["count"] for r in slices) < 15000


def test_input_row_ids_need_neither_a_shuffle_nor_a_copy(spark, tmp_path):
    from assaybook.operators.ordering import input_row_ids

    for k, n in enumerate((7, 0, 30, 1)):
        spark.range(n).select((F.col("id") + 100 * k).alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/part={k}")
    numbered = input_row_ids(spark, str(tmp_path))
    got = [tuple(r) for r in numbered.orderBy("row_id").select("row_id", "v").collect()]
    assert got == list(enumerate([*range(7), *range(200, 230), 300]))
    text = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "Exchange rangepartitioning" not in text and "Window" not in text


def test_positions_need_no_second_shuffle(spark):
    """Unweighted totals shuffle the rows once, by range, and store only the columns asked for."""
    from pyspark.sql import functions as F

    from assaybook.operators.ordering import running_total

    df = spark.range(200).select((F.col("id") % 3).alias("g"), (-F.col("id")).alias("o"), F.col("id").alias("v"))
    out = running_total(df, ["g"], ["o"], None, "at", "n", keep=["g", "v"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and set(out.columns) == {"g", "v", "at", "n"}
    rows = out.collect()
    for g in range(3):
        own = sorted((r for r in rows if r["g"] == g), key=lambda r: -r["v"])
        assert [r["at"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
