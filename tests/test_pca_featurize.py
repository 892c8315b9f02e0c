import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.operators import featurize, pca
from assaybook.operators.splits import chunk_split
from test_prescale import back, frame


def test_pca(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(960, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) @ rng.normal(size=(6, 6))
    x[17] = np.nan
    df, split = frame(spark, x).cache(), chunk_split(spark, 960, 32)
    model = pca.fit_pca_targets(df, split, "base", [0.8, 0.95])
    train = sorted(r[0] for r in split.train(df.select("row_id")).collect())
    clean = np.nan_to_num(x)
    centred = clean[train] - clean[train].mean(0)
    share = np.linalg.svd(centred, compute_uv=False) ** 2
    share /= share.sum()
    np.testing.assert_allclose(model.explained, share, atol=1e-10)
    for t in (0.8, 0.95):
        assert model.sizes[t] == np.searchsorted(np.cumsum(share), t) + 1
    big, small = back(model.transform(df, 0.95)), back(model.transform(df, 0.8))
    np.testing.assert_allclose(big[:, : small.shape[1]], small)         # thresholds share prefixes
    np.testing.assert_allclose(big[train].mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(big[train].std(0, ddof=1), 1, atol=1e-9)
    assert np.isfinite(big[17]).all()                                    # a failed row still gets scores
    model.keep_failed_missing = True
    assert np.isnan(back(model.transform(df, 0.8))[17]).all()
    names = {r["name"]: r["n_components"] for r in model.summary(spark).collect()}
    assert names == {"base_pca80": model.sizes[0.8], "base_pca95": model.sizes[0.95]}
    table = pca.components_for(pca.explained_table(spark, model), [0.8, 0.95]).collect()
    assert {r["threshold"]: r["n_components"] for r in table} == model.sizes


def test_featurize_isolates_failures(spark):
    def fn(keys):
        if any(k == "bad" for k in keys):
            raise RuntimeError("cannot")
        return np.array([[len(k), k.count("a")] for k in keys], float)

    keys = ["aa", "bad", "b", "", "aba"] * 40
    df = spark.createDataFrame(list(enumerate(keys)), "id int, key string").repartition(3)
    got = {r["id"]: r["features"] for r in featurize.featurize(df, "key", fn, 2, block_rows=16).collect()}
    for i, k in enumerate(keys):
        assert got[i] == ([None, None] if k == "bad" else [len(k), k.count("a")])


def test_featurize_wrong_width_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "key string")
    with pytest.raises(Exception, match="expected"):
        featurize.featurize(df, "key", lambda keys: np.zeros((len(keys), 3)), 2).collect()


def test_ragged_rows_and_blocks(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, features array<double>")
    got = {r["id"]: (r["features"], r["malformed"]) for r in featurize.coerce_width(df, 2).collect()}
    assert got == {1: ([1.0, 2.0], False), 2: ([None, None], True), 3: ([None, None], True)}
    f = F.col("features")
    made = df.select("id", featurize.concat_blocks([(F.array(F.lit(9.0)), 1), (f, 2)]).alias("x")).collect()
    assert {r["id"]: r["x"] for r in made} == {1: [9.0, 1.0, 2.0], 2: [9.0, None, None], 3: [9.0, None, None]}


def test_builtin_featurizers(spark):
    df = spark.createDataFrame([(1, "Ab1 ab\nx"), (2, ""), (3, "ab"), (4, "Ab1 ab\nx")], "id int, t string")
    positions = featurize.hashed_bits(F.col("t"), 64)
    rows = df.select("id", positions.alias("p"), featurize.dense_bits(positions, 64).alias("d")).collect()
    assert all(np.flatnonzero(r["d"]).tolist() == r["p"] for r in rows) and rows[0]["p"] == sorted(set(rows[0]["p"]))
    bits = {r["id"]: np.array(r["d"]) for r in rows}
    assert set(np.unique(bits[1])) <= {0.0, 1.0} and 1 <= bits[1].sum() <= 6 and bits[3].sum() >= 1
    assert (bits[1] == bits[4]).all()
    d = {r["id"]: r["d"] for r in df.select("id", featurize.text_descriptors(F.col("t")).alias("d")).collect()}
    assert d[1] == [8.0, 3.0, 2.0, 1.0, 1 / 8, 1 / 8, 2.0]
    assert d[2][0] == 0 and d[2][2] is None


def test_hashed_bits_match_runs_one_by_one(spark, monkeypatch):
    """In slices of a few bytes, for several run lengths; no run is hashed once per place."""
    import hashlib

    texts = [None, "", "a", "ab", "abc", "abcabcabc", "añ😀b\nñ😀b", "x" * 50, "the quick brown fox"]
    monkeypatch.setattr(featurize, "SLICE_BYTES", 8)
    assert "ArrowEvalPython" in spark.createDataFrame([("a",)], "t string").select(
        featurize.hashed_bits(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for gram, n_bits in ((1, 16), (3, 2048), (5, 64)):
        got = {r["id"]: r["p"] for r in df.select("id", featurize.hashed_bits(F.col("t"), n_bits, gram).alias("p")).collect()}
        for i, text in enumerate(texts):
            t = text or ""
            runs = {t[k : k + gram] for k in range(len(t) - gram + 1)} if len(t) >= gram else set(t)
            want = {int(hashlib.md5(r.encode()).hexdigest()[:8], 16) % n_bits for r in runs}
            assert got[i] == sorted(want)
