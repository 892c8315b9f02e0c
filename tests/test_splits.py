import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.operators import splits


def sides(spark, split):
    rows = split.ranges(spark).collect()
    by = {s: sorted(r["chunk_id"] for r in rows if r["side"] == s) for s in ("train", "val")}
    return by["train"], by["val"], rows


@pytest.mark.parametrize("order", ["md5", "numpy"])
def test_chunk_split(spark, order):
    split = splits.chunk_split(spark, 100 * 128 - 5, order=order)
    train, val, rows = sides(spark, split)
    assert split.n_chunks == 100 and len(train) == 90 and len(val) == 9
    assert not set(train) & set(val) and set(train) | set(val) == set(range(99))
    assert all(r["end_row"] - r["start_row"] == 128 and r["start_row"] == r["chunk_id"] * 128 for r in rows)
    assert sides(spark, splits.chunk_split(spark, 100 * 128 - 5, order=order))[0] == train
    assert sides(spark, splits.chunk_split(spark, 100 * 128 - 5, order=order, seed=1))[0] != train


def test_numpy_order_is_the_generators(spark):
    ids = np.arange(40)[:-1]
    np.random.default_rng(42).shuffle(ids)
    train, val, _ = sides(spark, splits.chunk_split(spark, 40 * 16, 16, order="numpy"))
    assert train == sorted(ids[:36]) and val == sorted(ids[36:])


def test_md5_order_is_the_hashes(spark):
    ranked = sorted(range(39), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert sides(spark, splits.chunk_split(spark, 40 * 16, 16))[0] == sorted(ranked[:36])


def test_degenerate_splits(spark):
    for rows, fraction in ((128, 0.9), (3 * 128, 0.1), (5 * 128, 1.0)):
        with pytest.raises(ValueError):
            splits.chunk_split(spark, rows, fraction=fraction)
    with pytest.raises(ValueError):
        splits.chunk_split(spark, 1000, order="other")


def test_last_chunk_has_no_side(spark):
    df = spark.range(1500).withColumnRenamed("id", "row_id")
    split = splits.chunk_split(spark, 1500, 128)
    got = {r["row_id"]: r["side"] for r in split.attach(df).collect()}
    assert all((got[i] is None) == (i >= 1408) for i in range(1500))


def test_evenly_spaced(spark):
    df = spark.range(1003).withColumnRenamed("id", "row_id")
    take = lambda n: sorted(r[0] for r in splits.evenly_spaced(df, 1003, n).collect())
    assert take(5000) == list(range(1003))
    assert take(100) == list(range(0, 1003, 10))[:100]
    assert take(600) == list(range(600))


def test_fit_sample_is_train_only(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    split = splits.chunk_split(spark, 5000, 100)
    got = [r[0] for r in splits.fit_sample(df, split, 0.3, 500, 1000).collect()]
    train, _, _ = sides(spark, split)
    assert sorted(got) == [i for i in range(0, 5000, 5) if i // 100 in train][:1000]


def test_fixed_split_and_overlap(spark):
    df = spark.range(205).withColumnRenamed("id", "k")
    made = splits.fixed_split(df, 205, "k")
    train, val = made.filter("side = 'train'"), made.filter("side = 'val'")
    assert val.count() == round(20.5) and train.count() == 205 - round(20.5)
    assert splits.overlap(train, val, "k").isEmpty()
    assert splits.overlap(train, train.limit(3), "k").count() == 3


def test_folds(spark):
    rows = [("a", i) for i in range(23)] + [("b", i) for i in range(7)] + [("c", i) for i in range(3)]
    got = splits.assign_folds(spark.createDataFrame(rows, "u string, row_id long"), ["u"], "row_id", 5, 0).collect()
    sizes = lambda u: sorted(np.bincount([r["fold"] for r in got if r["u"] == u]).tolist(), reverse=True)
    assert sizes("a") == [5, 5, 5, 4, 4]
    assert sizes("b") == [3, 2, 2]          # seven rows allow three folds
    assert not [r for r in got if r["u"] == "c"]
    assert splits.assign_folds(spark.createDataFrame(rows, "u string, row_id long"), ["u"], "row_id", 5, 0).filter(
        F.col("fold").isNull()).isEmpty()
