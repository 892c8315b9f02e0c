import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.operators import stacking, trees

FLAVORS = ["good", "noise", "absent"]
UNIT = ("endpoint", "seed")


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(7)
    rows = []
    for seed, n in ((0, 40), (1, 55)):
        y = rng.normal(size=n)
        for flavor, p in (("good", y + rng.normal(scale=0.3, size=n)), ("noise", rng.normal(size=n))):
            rows += [("e", seed, i, flavor, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))]
    rows += [("e", 0, 999, "good", 0.5, 0.5), ("tiny", 0, 0, "good", 1.0, 1.0), ("tiny", 0, 0, "noise", 1.0, 1.0)]
    return spark.createDataFrame(rows, "endpoint string, seed long, row_id long, flavor string, y_true double, y_pred double")


def test_features_keep_seeds_apart(pred):
    flavors = stacking.present_flavors(pred, FLAVORS)
    assert flavors == ["good", "noise"]
    f = stacking.stack_features(pred, flavors, UNIT)
    assert {(r["seed"], r["count"]) for r in f.filter("endpoint = 'e'").groupBy("seed").count().collect()} == {(0, 40), (1, 55)}
    with pytest.raises(ValueError):
        stacking.present_flavors(pred.filter("flavor = 'good'"), FLAVORS)


def r2(y, f):
    return 1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_ridge_and_best_single_equal_brute_force(pred):
    flavors = ["good", "noise"]
    folded = stacking.assign_folds(stacking.stack_features(pred, flavors, UNIT), ["endpoint", "seed"], "row_id").cache()
    got = {r["seed"]: r for r in stacking.stack_oof(stacking.stack_features(pred, flavors, UNIT), flavors, UNIT, alpha=1.0).collect()}
    assert set(got) == {0, 1}                               # the one-row endpoint has no folds
    for seed in (0, 1):
        rows = folded.filter((F.col("seed") == seed) & (F.col("endpoint") == "e")).collect()
        y = np.array([r["y"] for r in rows])
        x = np.array([[r["f_good"], r["f_noise"]] for r in rows])
        fold = np.array([r["fold"] for r in rows])
        meta, single = np.empty(len(y)), np.empty(len(y))
        for k in range(fold.max() + 1):
            tr, te = fold != k, fold == k
            mx, my = x[tr].mean(0), y[tr].mean()
            w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + np.eye(2), (x[tr] - mx).T @ (y[tr] - my))
            meta[te] = my + (x[te] - mx) @ w
            best = int(np.argmax([r2(y[tr], x[tr, j]) for j in range(2)]))
            single[te] = x[te, best]
        r = got[seed]
        assert r["meta_r2"] == pytest.approx(r2(y, meta), abs=1e-9)
        assert r["best_single_r2"] == pytest.approx(r2(y, single), abs=1e-9)
        assert r["delta_r2"] == pytest.approx(r2(y, meta) - r2(y, single), abs=1e-9)
        assert r["meta_rmse"] == pytest.approx(np.sqrt(((y - meta) ** 2).mean()))
        assert r["best_single_flavor"] == "good" and r["n_test"] == len(y)


def test_report_averages_scores(pred):
    report = stacking.stack_report(pred, FLAVORS, UNIT)
    row = report.filter("endpoint = 'e'").first()
    assert row["n_seeds"] == 2 and row["n_flavors"] == 2 and row["n_test"] == round((40 + 55) / 2)
    assert row["best_single_flavor"] == "good"
    s = stacking.stack_summary(report).first()
    assert s["total"] == 1 and s["mean_delta"] == pytest.approx(row["delta_r2"])


def test_seed_aggregation_ties_and_single_seed(spark):
    rows = [("e", 1, 10, 2, "m", 0.5, 1.0, "b", 0.4, 0.1), ("e", 2, 13, 3, "m", 0.7, 2.0, "a", 0.4, 0.3), ("s", 1, 5, 2, "m", 0.1, 1.0, "a", 0.2, -0.1)]
    df = spark.createDataFrame(rows, "endpoint string, seed int, n_test long, n_flavors int, estimator string, meta_r2 double, "
                               "meta_rmse double, best_single_flavor string, best_single_r2 double, delta_r2 double")
    got = {r["endpoint"]: r for r in stacking.aggregate_stack_seeds(df, ["a", "b"]).collect()}
    assert got["e"]["best_single_flavor"] == "a" and got["e"]["n_flavors"] == 3 and got["e"]["n_test"] == 12
    assert got["e"]["meta_r2_std"] == pytest.approx(np.std([0.5, 0.7], ddof=1)) and got["s"]["meta_r2_std"] == 0.0


def test_trees(pred):
    f = stacking.stack_features(pred.filter("endpoint = 'e' and seed = 0"), ["good", "noise"], UNIT)
    r = stacking.stack_oof(f, ["good", "noise"], UNIT, k=2, estimator="rf").first()
    assert r["estimator"] == "rf" and r["meta_r2"] > 0.3
    with pytest.raises(ValueError):
        stacking.stack_oof(f, ["good", "noise"], UNIT, estimator="magic")


def tree_rows(spark, n=900, units=2):
    rng = np.random.default_rng(11)
    rows = []
    for u in range(units):
        x = rng.normal(size=(n, 3))
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] ** 2 + rng.normal(scale=0.2, size=n)
        rows += [(f"u{u}", i, int(i % 3), float(y[i]), *map(float, x[i])) for i in range(n)]
    rows.append(("tiny", 0, 0, 1.0, 0.0, 0.0, None))
    rows.append(("tiny", 1, 1, 2.0, 0.0, 0.0, None))
    return spark.createDataFrame(rows, "unit string, row_id long, fold int, y double, a double, b double, c double")


def held(df):
    return {(r["unit"], r["row_id"]): r["meta"] for r in df.collect()}


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_of_spread_units_equal_those_of_whole_ones(spark, monkeypatch, kind):
    """The grouped aggregate per level grows the same trees as one task, and few scans do for all of them."""
    df = tree_rows(spark)
    whole = held(trees.held_out_predictions(df, ["unit"], ["a", "b", "c"], kind, seed=3, trees=4, depth=3))
    assert len(whole) == df.count()
    assert whole["tiny", 0] == pytest.approx(2.0) and whole["tiny", 1] == pytest.approx(1.0) or kind == "rf"
    monkeypatch.setattr(trees, "SLICE_ROWS", 200)
    scans = spark.sparkContext.accumulator(0)
    level = trees._level
    monkeypatch.setattr(trees, "_level", lambda *args: (scans.add(1), level(*args))[1])
    spread = held(trees.held_out_predictions(df, ["unit"], ["a", "b", "c"], kind, seed=3, trees=4, depth=3))
    assert scans.value == (3 if kind == "rf" else 12)
    assert spread.keys() == whole.keys() and all(spread[k] == pytest.approx(whole[k], abs=1e-9) for k in whole)


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_score_like_those_of_spark(spark, kind):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    df = tree_rows(spark, units=1).filter("unit = 'u0'").cache()
    got = held(trees.held_out_predictions(df, ["unit"], ["a", "b", "c"], kind))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    maker = RandomForestRegressor if kind == "rf" else GBTRegressor
    theirs = {}
    for fold in range(3):
        model = maker(featuresCol="features", labelCol="y", predictionCol="meta", seed=1).fit(rows.filter(F.col("fold") != fold))
        theirs |= held(model.transform(rows.filter(F.col("fold") == fold)))
    truth = {(r["unit"], r["row_id"]): r["y"] for r in df.collect()}
    y = np.array([truth[k] for k in sorted(truth)])
    ours, spark_ml = (r2(y, np.array([p[k] for k in sorted(truth)])) for p in (got, theirs))
    assert ours > 0.75 and ours == pytest.approx(spark_ml, abs=0.05)


def test_a_tree_finds_the_best_split():
    rng = np.random.default_rng(12)
    bins, y = rng.integers(0, 8, (300, 2)).astype(np.int32), rng.normal(size=300)
    y[bins[:, 1] > 4] += 3
    hist = trees.histogram(bins, y[None], np.ones((1, 300)), np.zeros((1, 300), np.int32), 0)
    best = trees.best_splits(hist, np.ones((1, 1, 2), bool))
    errors = {(f, c): sum(((y[s] - y[s].mean()) ** 2).sum() for s in (bins[:, f] <= c, bins[:, f] > c)) for f in range(2) for c in range(7)}
    assert (best["feature"][0, 0], best["cut"][0, 0]) == min(errors, key=errors.get) == (1, 4)
    assert best["gain"][0, 0] == pytest.approx(((y - y.mean()) ** 2).sum() - min(errors.values()))


def test_labelled_predictions(pred):
    labelled = pred.filter("endpoint = 'e'").select(
        F.concat(F.lit("lr_reduced__"), "flavor", F.lit("__s"), F.col("seed").cast("string")).alias("label"),
        F.lit("gauge_st").alias("recipe"), "endpoint", "row_id", "y_true", "y_pred")
    made = stacking.labelled_predictions(labelled, "lr_reduced__")
    assert {(r["flavor"], r["seed"], r["dataset"]) for r in made.select("flavor", "seed", "dataset").distinct().collect()} == {
        (f, s, "gauge") for f in ("good", "noise") for s in (0, 1)}
    unit = ("dataset", "recipe", "endpoint", "seed")
    row = stacking.stack_report(made, FLAVORS, unit).first()
    assert (row["dataset"], row["recipe"], row["endpoint"], row["n_seeds"]) == ("gauge", "gauge_st", "e", 2)
    bare = stacking.labelled_predictions(labelled.withColumn("label", F.lit("good")))
    assert {r["seed"] for r in bare.select("seed").distinct().collect()} == {-1}


def ragged(spark):
    rng = np.random.default_rng(3)
    rows = []
    for recipe, shift in (("r1_st", 0.0), ("r2_st", 5.0)):
        for endpoint, flavors in (("e1", "abc"), ("e2", "ab"), ("e3", "a")):
            y = rng.normal(size=30) + shift
            rows += [("d", recipe, endpoint, 1, i, f, float(v), float(v + rng.normal(scale=0.2 + k))) for k, f in enumerate(flavors) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "dataset string, recipe string, endpoint string, seed long, row_id long, flavor string, y_true double, y_pred double")


def test_units_stack_the_flavors_they_have(spark):
    pred = ragged(spark)
    report = {(r["recipe"], r["endpoint"]): r for r in stacking.stack_report(pred, ["a", "b", "c", "d"]).collect()}
    assert set(report) == {(x, e) for x in ("r1_st", "r2_st") for e in ("e1", "e2")}       # e3 has one flavor
    assert report["r1_st", "e1"]["n_flavors"] == 3 and report["r1_st", "e2"]["n_flavors"] == 2
    alone = stacking.stack_report(pred.filter("endpoint = 'e2'"), ["a", "b"])
    for r in alone.collect():
        assert report[r["recipe"], "e2"]["meta_r2"] == pytest.approx(r["meta_r2"], abs=1e-9)


def test_recipes_never_mix(spark):
    pred = ragged(spark)
    assert stacking.stack_features(pred, ["a", "b", "c"]).filter("endpoint = 'e1'").count() == 60
    with pytest.raises(Exception, match="two predictions"):
        stacking.stack_features(pred, ["a", "b"], ("endpoint", "seed")).collect()


def test_best_single_with_a_large_mean(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(size=60)
    rows = [("e", 1, i, f, float(v + 1e8), float(v + 1e8 + rng.normal(scale=s))) for f, s in (("x", 0.1), ("y", 0.3)) for i, v in enumerate(y)]
    pred = spark.createDataFrame(rows, "endpoint string, seed long, row_id long, flavor string, y_true double, y_pred double")
    scored = stacking.stack_oof(stacking.stack_features(pred, ["y", "x"], UNIT), ["y", "x"], UNIT).first()
    assert scored["best_single_flavor"] == "x" and 0.9 < scored["best_single_r2"] <= 1


def test_few_units_are_not_joined_by_key(spark):
    """Which flavors a unit has goes to the rows; the rows do not go to one task a unit."""
    rows = [("d", "r", "e", s, i, fl, float(i), float(i) + k) for s in (1, 2) for i in range(6) for k, fl in enumerate(("f0", "f1"))]
    pred = spark.createDataFrame(rows, "dataset string, recipe string, endpoint string, seed long, row_id long, flavor string, y_true double, y_pred double")
    out = stacking.stack_features(pred, ["f0", "f1"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.count() == 12 and {r["n_flavors"] for r in out.collect()} == {2}
