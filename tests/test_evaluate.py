import numpy as np
import pytest

from assaybook.operators import evaluate, rankings

KEYS = ["label", "recipe", "endpoint"]


def kendall_brute(y, f):
    dy, df = np.sign(y[:, None] - y[None]), np.sign(f[:, None] - f[None])
    top = (dy * df).sum() / 2
    ny, nf = (dy != 0).sum() / 2, (df != 0).sum() / 2
    return top / np.sqrt(ny * nf) if ny * nf else None


def avg_rank(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("hot", 900), ("mid", 60), ("two", 2), ("one", 1), ("flat", 20)):
        y = rng.integers(0, 40, n).astype(float) if g != "flat" else np.full(n, 3.0)
        f = np.round(y + rng.normal(scale=8, size=n))
        rows += [(g, "r_st", "e", float(a), float(b)) for a, b in zip(y, f)]
    rows.append(("mid", "r_st", "e", None, 1.0))                 # an unlabelled item
    return rows, spark.createDataFrame(rows, "label string, recipe string, endpoint string, y_true double, y_pred double")


def group(rows, g):
    v = [(r[3], r[4]) for r in rows if r[0] == g and r[3] is not None]
    return np.array(v, float).T


def test_regression(spark, pred):
    rows, df = pred
    got = {r["label"]: r for r in evaluate.regression_metrics(df).collect()}
    for g in ("hot", "mid", "two"):
        y, f = group(rows, g)
        assert got[g]["n_test"] == len(y)
        assert got[g]["mse"] == pytest.approx(((y - f) ** 2).mean())
        assert got[g]["mae"] == pytest.approx(np.abs(y - f).mean())
        assert got[g]["rmse"] == pytest.approx(np.sqrt(((y - f) ** 2).mean()))
        assert got[g]["r2"] == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["one"]["r2"] is None and got["flat"]["r2"] == 0.0
    perfect = spark.createDataFrame([("p", "r", "e", 2.0, 2.0)] * 3, df.schema)
    assert evaluate.regression_metrics(perfect).first()["r2"] == 1.0


@pytest.mark.parametrize("rows_of_a_slice, branches", [(rankings.SLICE_ROWS, 64), (64, 64), (24, 3)])
def test_rank_metrics(pred, monkeypatch, rows_of_a_slice, branches):
    """Groups inside one slice, and groups of many slices below trees of several levels."""
    monkeypatch.setattr(rankings, "SLICE_ROWS", rows_of_a_slice)
    monkeypatch.setattr(rankings, "TASK_ROWS", min(rows_of_a_slice, 100))
    monkeypatch.setattr(rankings, "BRANCHES", branches)
    rows, df = pred
    got = {r["label"]: r for r in evaluate.rank_metrics(df).collect()}
    for g in ("hot", "mid", "two"):
        y, f = group(rows, g)
        assert got[g]["kendall"] == pytest.approx(kendall_brute(y, f), abs=1e-12)
        assert got[g]["spearman"] == pytest.approx(np.corrcoef(avg_rank(y), avg_rank(f))[0, 1], abs=1e-12)
    assert [got[g][m] for g in ("flat", "one") for m in ("kendall", "spearman")] == [None] * 4


@pytest.mark.parametrize("kind", ["one value of y", "one value of f", "one pair", "reversed", "missing key"])
def test_runs_over_many_slices(spark, monkeypatch, kind):
    """A run of equal values, or a group without a name, that goes on through several slices."""
    monkeypatch.setattr(rankings, "SLICE_ROWS", 20)
    monkeypatch.setattr(rankings, "TASK_ROWS", 20)
    monkeypatch.setattr(rankings, "BRANCHES", 3)
    rng = np.random.default_rng(8)
    y, f = rng.integers(0, 90, 300).astype(float), rng.integers(0, 90, 300).astype(float)
    if kind == "one value of y":
        y[40:260] = 44.0
    if kind == "one value of f":
        f[40:260] = 44.0
    if kind == "one pair":
        y[40:260], f[40:260] = 44.0, 44.0
    if kind == "reversed":
        y, f = np.arange(300.0), -np.arange(300.0)
    name = None if kind == "missing key" else "g"
    rows = [(name, a, b) for a, b in zip(y.tolist(), f.tolist())] + [("z", a, b) for a, b in zip(f[:30].tolist(), y[:30].tolist())]
    df = spark.createDataFrame(rows, "g string, y_true double, y_pred double")
    got = {r["g"]: r for r in evaluate.rank_metrics(df, ["g"]).collect()}
    for g, a, b in ((name, y, f), ("z", f[:30], y[:30])):
        want = kendall_brute(a, b)
        assert got[g]["kendall"] == (None if want is None else pytest.approx(want, abs=1e-12))
        assert got[g]["spearman"] == (None if want is None else pytest.approx(np.corrcoef(avg_rank(a), avg_rank(b))[0, 1], abs=1e-12))


def test_no_pairs(spark):
    empty = spark.createDataFrame([], "g string, y_true double, y_pred double")
    assert evaluate.rank_metrics(empty, ["g"]).isEmpty()


def test_inversions():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        q, w = rng.permutation(n), rng.integers(1, 5, n)
        brute = sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if q[i] > q[j])
        assert rankings.inversions(q, w) == brute
    owner = np.sort(rng.integers(0, 5, 100))
    split = [rankings.inversions(q[owner == g], w[owner == g]) for g in range(5)]
    assert rankings.inversions_of(q, w, owner, 5).tolist() == split


def test_rae_and_tidy(spark, pred):
    rows, df = pred
    train = spark.createDataFrame([("hot", "r_st", "e", float(i)) for i in range(10)] + [("hot", "r_st", "e", None)]
                                  + [("flat", "r_st", "e", 3.0)], "label string, recipe string, endpoint string, y double")
    got = {r["flavor"]: r for r in evaluate.tidy_metrics(df, train).collect()}
    y, f = group(rows, "hot")
    assert got["hot"]["rae"] == pytest.approx(np.abs(y - f).mean() / np.abs(y - 4.5).mean())
    assert got["hot"]["n_train"] == 10 and got["hot"]["dataset"] == "r"
    assert got["flat"]["rae"] is None and got["mid"]["rae"] is None and got["mid"]["n_train"] == 0
    assert set(got) == {"hot", "mid", "two", "one", "flat"}


def test_a_missing_prediction_leaves_every_statistic(spark):
    rows = [("f", "r_st", "e", float(y), p) for y, p in ((1, 1.0), (2, None), (3, 2.0), (5, 4.0))]
    df = spark.createDataFrame(rows, "label string, recipe string, endpoint string, y_true double, y_pred double")
    got = evaluate.regression_metrics(df).first()
    assert got["n_test"] == 3 and got["mse"] == pytest.approx(2 / 3)
    y, p = np.array([1, 3, 5.0]), np.array([1, 2, 4.0])
    assert got["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert evaluate.missing_predictions(df).first()["n_missing"] == 1
    train = spark.createDataFrame([("f", "r_st", "e", 0.0)], "label string, recipe string, endpoint string, y double")
    assert evaluate.rae(df, train).first()["rae"] == pytest.approx((2 / 3) / 3)
