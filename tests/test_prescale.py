import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.operators import blocks, matrix, power, prescale, steps
from assaybook.operators.splits import chunk_split
from assaybook.operators.steps import RECIPES

N, CHUNK = 1500, 25


# what each column of the fixture is there for
PLAIN, TWIN, HEAVY, FLAT, HOLES, LIMITS, EMPTY, SPARSE, SKEWED, OTHER, WIDE = range(11)
BLANK = 777                                     # a row that failed throughout


def raw_matrix():
    rng = np.random.default_rng(20240607)
    x = rng.uniform(-2, 2, size=(N, 11))
    x[:, TWIN] = 7 - 3 * x[:, PLAIN] + rng.uniform(-1e-4, 1e-4, size=N)
    x[:, HEAVY] = rng.standard_t(2, size=N)
    x[:, FLAT] = -0.625
    x[rng.choice(N, 90, replace=False), HOLES] = np.nan
    x[410:418, LIMITS], x[903, LIMITS] = -np.inf, np.inf
    x[:, EMPTY] = np.nan
    x[: N // 2, SPARSE] = np.nan                # half missing: beyond the default share
    x[:, SKEWED] = rng.gamma(1.5, 4.0, size=N)
    x[:, WIDE] = rng.integers(-3, 4, size=N) * 1e5
    x[BLANK] = np.nan
    return x


def frame(spark, x):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>").repartition(5)


def back(df, width=None):
    rows = sorted(df.select("row_id", "features").collect())
    return np.array([[np.nan if v is None else v for v in r[1]] for r in rows], float)


@pytest.fixture(scope="module")
def setup(spark):
    x = raw_matrix()
    split = chunk_split(spark, N, CHUNK)
    df = frame(spark, x).cache()
    train = np.array([r["row_id"] for r in split.train(df.select("row_id")).collect()])
    return x, split, df, np.sort(train)


def fit(df, split, recipe):
    return prescale.fit_recipe(df, split, recipe)


def has(recipe, step):
    return any(isinstance(s, step) for s in recipe)


@pytest.mark.parametrize("name", list(RECIPES))
def test_missing_stays_missing(setup, name):
    x, split, df, _ = setup
    model = fit(df, split, RECIPES[name])
    out, kept = back(model.transform(df)), model.columns.keep
    assert model.gone("invalid") == [EMPTY, SPARSE]
    assert (np.isfinite(out) == np.isfinite(x[:, kept])).all()
    assert np.isnan(out[BLANK]).all()
    assert (TWIN in model.gone("correlated")) == has(RECIPES[name], steps.DropCorrelated)
    assert (FLAT in model.gone("low_variance")) == has(RECIPES[name], steps.DropFlat)


def in_numpy(x, train, clip):
    """A recipe without correlation, power or variance steps, told in numpy; ``clip`` gives its limits."""
    known = np.isfinite(x)
    keep = np.flatnonzero((known.sum(0) >= 0.8 * len(x)) & known.any(0))
    masked = np.ma.masked_invalid(x[:, keep])
    c = np.nan_to_num(x[:, keep], nan=0.0, posinf=np.inf, neginf=-np.inf)
    c = np.minimum(np.maximum(c, masked.min(0).filled()), masked.max(0).filled())
    c = np.where(np.isnan(x[:, keep]), 0.0, c)
    limits = clip(c[train]) if clip else (-np.inf, np.inf)
    c = np.clip(c, *limits)
    spread = c[train].std(0, ddof=1)
    z = (c - c[train].mean(0)) / np.where(spread > 1e-9, spread, 1)
    return keep, np.where(known[:, keep], z, np.nan)


def quantile_limits(c):
    return np.quantile(c, 0.01, axis=0), np.quantile(c, 0.99, axis=0)


def spread_limits(c):
    return c.mean(0) - 6 * c.std(0, ddof=1), c.mean(0) + 6 * c.std(0, ddof=1)


BY_SPREAD = (steps.DropInvalid(), steps.ClipSpread(), steps.Scale())


@pytest.mark.parametrize("recipe, clip", [(RECIPES["minimal"], None), (RECIPES["order_fix"], quantile_limits), (BY_SPREAD, spread_limits)])
def test_values_equal_numpy_over_all_train_rows(setup, recipe, clip):
    x, split, df, train = setup
    keep, want = in_numpy(x, train, clip)
    model = fit(df, split, recipe)
    assert model.columns.keep.tolist() == keep.tolist()
    np.testing.assert_allclose(back(model.transform(df)), want, atol=1e-7)


def test_raw_zscore(setup):
    x, split, df, train = setup
    clipped = (steps.DropInvalid(), steps.ClipQuantiles())
    model = fit(df, split, (*clipped, steps.Scale(raw=True)))
    plain = back(fit(df, split, clipped).transform(df))
    raw = np.nan_to_num(x[train, PLAIN])
    np.testing.assert_allclose(back(model.transform(df))[:, 0], (plain[:, 0] - raw.mean()) / raw.std(ddof=1), atol=1e-9)


def test_validation_rows_leave_train_rows_alone(spark, setup):
    x, split, df, train = setup
    changed = x.copy()
    changed[np.setdiff1d(np.arange((split.n_chunks - 1) * CHUNK), train)] = -321.0
    ours, other = fit(df, split, RECIPES["order_fix"]), fit(frame(spark, changed), split, RECIPES["order_fix"])
    # infinite cells take their value from all rows by design, and so do the shares of missing cells
    shared = [c for c in ours.columns.keep if c in other.columns.keep and c != LIMITS]
    a = back(ours.transform(df))[:, [list(ours.columns.keep).index(c) for c in shared]]
    b = back(other.transform(frame(spark, changed)))[:, [list(other.columns.keep).index(c) for c in shared]]
    np.testing.assert_allclose(a[train], b[train], atol=1e-9)


def test_all_invalid_is_an_error(setup):
    _, split, df, _ = setup
    gone = df.withColumn("features", F.transform("features", lambda v: F.lit(None).cast("double")))
    with pytest.raises(ValueError):
        fit(gone, split, RECIPES["minimal"])


def test_recipes():
    assert list(RECIPES) == ["minimal", "order_fix", "plus_drop_corr", "plus_drop_low_var", "plus_yeo_johnson", "full"]
    with pytest.raises(KeyError):
        steps.get_recipe("nope")


def test_summary_and_stats(spark, setup):
    _, split, df, _ = setup
    model = prescale.fit_recipe(df, split, RECIPES["full"], "full")
    row = model.summary(spark).first()
    assert row["name"] == "full" and row["n_cols_in"] == 11
    assert row["n_cols_out"] == len(model.columns.keep) == model.column_stats(spark).count()
    assert (row["dropped_invalid"], row["dropped_correlated"], row["dropped_low_variance"]) == ([EMPTY, SPARSE], [TWIN], [FLAT])


def test_block_statistics_equal_numpy(spark, setup):
    x, _, df, _ = setup
    good = np.where(np.isfinite(x), x, np.nan)
    stats = matrix.masked_moments(df).orderBy("col_id").collect()
    for j, r in enumerate(stats):
        own = good[~np.isnan(good[:, j]), j]
        assert r["n"] == len(own)
        if len(own) > 1:
            assert r["mean"] == pytest.approx(own.mean(), rel=1e-9, abs=1e-12) and r["std"] == pytest.approx(own.std(ddof=1), rel=1e-9, abs=1e-12)
    profile = {r["col_id"]: r for r in matrix.profile_columns(df).collect()}
    assert profile[EMPTY]["col_min"] is None and profile[EMPTY]["invalid"] == N
    assert profile[LIMITS]["invalid"] == 10 and profile[LIMITS]["col_max"] == np.nanmax(good[:, LIMITS])


def test_quantiles_narrow_to_the_exact_ones(spark, setup, monkeypatch):
    x, _, df, _ = setup
    finite = frame(spark, np.where(np.isfinite(x), x, np.nan))
    want = np.nanquantile(np.where(np.isfinite(x), x, np.nan)[:, :EMPTY], [0, 0.013, 0.5, 1], axis=0)
    for fetched in (matrix.FETCHED, 1):                   # with one cell a bracket, all the narrowing passes run
        monkeypatch.setattr(matrix, "FETCHED", fetched)
        got = matrix.block_quantiles(finite, 11, [0, 0.013, 0.5, 1])
        np.testing.assert_allclose(got[:, :EMPTY], want, rtol=1e-12)
        assert np.isnan(got[:, EMPTY]).all()


def test_ragged_rows_are_an_error(spark):
    ragged = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0] * 5)], "row_id long, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="cells, not"):
        blocks.map_blocks(ragged, lambda x: x, 4).collect()


def test_legacy(setup):
    x, split, df, train = setup
    out = prescale.legacy_rescale(df, split)
    assert out.filter("side is null").isEmpty()
    rows = sorted(r["row_id"] for r in out.select("row_id").collect())
    got = back(out)
    finite = np.where(np.isfinite(x[train]), x[train], np.nan)
    mean, std = np.nanmean(finite, 0), np.nanstd(finite, 0, ddof=1)
    with np.errstate(all="ignore"):
        want = (np.clip(x[rows], mean - 6 * std, mean + 6 * std) - mean) / std
    for c in (PLAIN, HEAVY, HOLES, LIMITS, SPARSE):
        np.testing.assert_allclose(got[:, c], want[:, c], atol=1e-8)
    at = np.array(rows)
    assert np.isfinite(got[(at >= 410) & (at < 418), LIMITS]).all()             # infinite cells become limits
    assert np.isnan(got[:, FLAT]).all() and np.isnan(got[:, EMPTY]).all()       # no spread, no value


def test_greedy_correlation_drop(spark):
    pairs = [(0, 1, 0.99), (1, 2, -0.99), (2, 3, 0.99), (0, 3, 0.1), (4, 5, 0.5)]
    df = spark.createDataFrame(pairs, "i int, j int, r double")
    assert matrix.drop_correlated(df, 0.98) == [1, 3]      # 1 falls to 0, so 2 stays and takes 3


@pytest.mark.parametrize("last", [0, 40, 1 << 18])
def test_parallel_drop_equals_the_scan_in_order(spark, monkeypatch, last):
    """Random graphs, a chain and a star, in rounds only, in rounds and a scan, and as a scan."""
    monkeypatch.setattr(matrix, "LAST_PAIRS", last)
    rng = np.random.default_rng(6)
    graphs = [[(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < p] for p in (0.02, 0.1, 0.5)]
    graphs += [[(i, i + 1) for i in range(9)], [(0, j) for j in range(1, 30)] + [(j, 30) for j in range(1, 30)], []]
    for pairs in graphs:
        gone = set()
        for i, j in sorted(pairs):
            if i not in gone and j not in gone:
                gone.add(j)
        df = spark.createDataFrame([(i, j, float(rng.choice([-1, 1]))) for i, j in pairs] + [(0, 1, 0.1)], "i int, j int, r double")
        assert matrix.drop_correlated(df) == sorted(gone)


def shuffled_bytes(df):
    """Bytes that all exchanges of a plan wrote when it ran."""
    df._jdf.collect()
    seen, open_, total = set(), [df._jdf.queryExecution().executedPlan()], 0
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            open_.append(node.plan())
        if name == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply("shuffleBytesWritten").value()
        children = node.children()
        open_ += [children.apply(k) for k in range(children.size())]
    return total


def test_gram_tiles_and_what_they_shuffle(spark, monkeypatch):
    """Tiles of any size give Z'Z; more input splits do not send more."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 37))
    x[5, 3], x[9] = np.nan, np.nan
    df = frame(spark, x)
    shift, scale = rng.normal(size=37), rng.uniform(1, 2, size=37)
    z = (np.nan_to_num(x) - shift) / scale
    for tile, fan in ((512, 32), (10, 2), (37, 2), (1, 3)):
        monkeypatch.setattr(matrix, "TILE", tile)
        monkeypatch.setattr(matrix, "GRAM_FAN", fan)
        got = matrix.gram_matrix(matrix.gram_tiles(df, 37, shift, scale), 37)
        np.testing.assert_allclose(got, z.T @ z, rtol=1e-10)
    monkeypatch.setattr(matrix, "TILE", 16)
    sent = [shuffled_bytes(matrix.gram_tiles(df.repartition(n), 37, shift, scale)) - shuffled_bytes(df.repartition(n)) for n in (8, 64)]
    assert sent[1] < 1.1 * sent[0]
    few, many = (shuffled_bytes(matrix.gram_tiles(df, 37, shift, scale, rows=n)) - shuffled_bytes(df) for n in (600, None))
    assert few < 0.5 * many


def test_correlation_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    x[:, 3], x[:, 4] = x[:, 0] * -2 + 0.1 * x[:, 1], 1.0
    want = np.corrcoef(x[:, :4].T)
    got = {(r["i"], r["j"]): r["r"] for r in matrix.correlation_pairs(frame(spark, x), 5).collect()}
    assert len(got) == 10 and all(got[(i, 4)] == pytest.approx(0, abs=1e-12) for i in range(4))
    for i in range(4):
        for j in range(i + 1, 4):
            assert got[(i, j)] == pytest.approx(want[i, j], abs=1e-10)


def test_yeo_johnson_fit_is_the_maximum(spark):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.lognormal(size=800), rng.normal(size=800), -rng.gamma(2, size=800), np.full(800, 2.0)])
    got = {r["col_id"]: r["lam"] for r in power.fit_yeo_johnson(frame(spark, x)).collect()}
    assert got[3] is None or np.isnan(got[3])
    for j in range(3):
        best = power.log_likelihood(x[:, j], got[j])
        assert all(power.log_likelihood(x[:, j], got[j] + d) <= best + 1e-9 for d in (-1, -0.1, -1e-3, 1e-3, 0.1, 1))
    assert abs(got[1] - 1) < 0.3


@pytest.mark.parametrize("name, most", [("minimal", 2), ("order_fix", 4), ("plus_drop_corr", 5), ("plus_drop_low_var", 4), ("full", 14)])
def test_scans_of_a_fit(spark, setup, name, most):
    """Steps share what is known, so a fit reads the matrix few times."""
    x, split, _, _ = setup
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = frame(spark, x)
    fit(df.mapInArrow(counted, df.schema), split, RECIPES[name])
    assert seen.value < (most + 1) * N                     # the width takes part of another scan


def test_aligned_tables_join_without_an_exchange(spark, setup):
    from assaybook.session import stage_aligned

    _, _, df, _ = setup
    keys = spark.range(N).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), "id").alias("key"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = [stage_aligned(side, "row_id", 3, "aligned") for side in (keys, df)]
        joined = matrix.align(*stored)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == N and joined.filter("key <> concat('k', row_id)").isEmpty()
        assert "Exchange" in matrix.align(keys, df)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_written_tables_align(spark, setup, tmp_path):
    from assaybook.sources.writers import write_aligned

    _, _, df, _ = setup
    write_aligned(df, "aligned_matrix", 3, str(tmp_path / "m"))
    assert spark.table("aligned_matrix").count() == N
    with pytest.raises(Exception):
        write_aligned(df, "aligned_matrix", 3, str(tmp_path / "m"))
    spark.sql("DROP TABLE aligned_matrix")


def test_align(spark, setup):
    _, _, df, _ = setup
    keys = spark.range(N).select(F.col("id").alias("row_id"), F.concat(F.lit("k"), "id").alias("key"))
    assert matrix.align(keys, df).count() == N
    with pytest.raises(ValueError):
        matrix.align(keys.filter("row_id < 5"), df)
    with pytest.raises(ValueError):
        matrix.align(keys.withColumn("row_id", F.col("row_id") + 1), df)
    twice = spark.createDataFrame([(i, [0.0]) for i in (0, 0, 3, 3)], "row_id long, features array<double>")
    with pytest.raises(ValueError):                        # as many rows, the same last id and the same sum
        matrix.align(keys.filter("row_id < 4"), twice)


def test_aligned_buckets_follow_the_rows():
    from assaybook.session import BUCKET_ROWS, aligned_buckets

    assert aligned_buckets(0) == aligned_buckets(8 * BUCKET_ROWS) == 8
    assert aligned_buckets(400 * BUCKET_ROWS + 1) == 401
