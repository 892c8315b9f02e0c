import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.functions.normal import normal_cdf
from assaybook.operators import significance as sig

SCHEMA = "family string, arm string, value double"


def tails(spark, t, n, n0, df):
    """P-values of one family of arms, given their statistics."""
    rows = [("f", f"a{i}", float(x), int(size), int(n0), float(df)) for i, (x, size) in enumerate(zip(t, n))]
    stats = spark.createDataFrame(rows, "family string, arm string, t double, n long, n0 long, df double")
    return [r["p"] for r in sig.dunnett_tails(stats, ["family"], "arm").orderBy("arm").collect()]


def t_tail(spark, t, df):
    return spark.range(1).select(sig.t_tail(F.lit(float(t)), F.lit(float(df))).alias("p")).first()["p"]


def brute_tail(t, n, n0, df):
    """The same integral on plain grids, with the error function."""
    cdf = lambda x: 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2))
    z, s = np.arange(-8, 8.01, 0.05), np.arange(0.005, 4, 0.02)
    ws, wz = np.exp((df - 1) * np.log(s) - df * (s * s - 1) / 2), np.exp(-z * z / 2)
    inside = np.ones((s.size, z.size))
    for size in n:
        lam = math.sqrt(size / (size + n0))
        width = math.sqrt(1 - lam * lam)
        inside *= cdf((t * s[:, None] + lam * z) / width) - cdf((-t * s[:, None] + lam * z) / width)
    return 1 - ws @ inside @ wz / ws.sum() / wz.sum()


def test_normal_cdf(spark):
    x = np.linspace(-9, 9, 2001)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", normal_cdf(F.col("x")).alias("p"))
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=1e-11) for r in df.collect())


def test_published_critical_values(spark):
    """Two-sided 5 % Dunnett points for equal groups: (arms, df, t)."""
    for k, df, t in [(1, 10, 2.228), (2, 10, 2.57), (3, 20, 2.54), (5, 20, 2.73), (9, 60, 2.78)]:
        assert tails(spark, [t] * k, [5] * k, 5, df)[0] == pytest.approx(0.05, abs=0.002)


def test_tails_equal_plain_grids(spark):
    for t, n, n0, df in [([0.4, 2.2, 3.1], [5, 9, 5], 12, 27), ([1.0, 2.5], [3, 30], 4, 34), ([6.5], [4], 4, 9)]:
        got = tails(spark, t, n, n0, df)
        assert got == pytest.approx([brute_tail(x, n, n0, df) for x in t], abs=1e-8)


def test_one_arm_is_the_t_test(spark):
    for t, df in [(0.5, 3), (2.0, 8), (3.3, 30)]:
        assert tails(spark, [t], [4], 6, df)[0] == pytest.approx(t_tail(spark, t, df), abs=1e-9)


def test_t_tail(spark):
    assert t_tail(spark, 0.0, 5) == pytest.approx(1.0)
    assert t_tail(spark, 1.0, 1) == pytest.approx(0.5)                       # Cauchy
    assert t_tail(spark, 2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert t_tail(spark, 2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_tail(spark, 1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_published_example(spark):
    """Blood counts of two drugs against a control, a textbook unequal-size example."""
    data = {"control": [7.40, 8.50, 7.20, 8.24, 9.84, 8.32], "a": [9.76, 8.80, 7.68, 9.36],
            "b": [12.80, 9.68, 12.16, 9.20, 10.55]}
    rows = [("f", arm, v) for arm, values in data.items() for v in values]
    got = {r["arm"]: r["p"] for r in sig.dunnett(spark.createDataFrame(rows, SCHEMA), ["family"], "arm", "value", "control").collect()}
    assert got["a"] == pytest.approx(0.6200, abs=2e-3) and got["b"] == pytest.approx(0.0059, abs=2e-4)


def test_families(spark):
    ctl = [0.300, 0.291, 0.310, 0.298, 0.295]
    rows = [("one", "ctl", v) for v in ctl]
    rows += [("one", "up", v + 0.1) for v in ctl] + [("one", "same", v + 0.001) for v in ctl]
    rows += [("one", "lone", 0.9)]                                           # one value: missing, outside the family
    rows += [("nocontrol", "ctl", 0.3), ("nocontrol", "up", 0.4), ("nocontrol", "up", 0.5)]
    rows += [("flat", a, v) for a, v in (("ctl", 0.3), ("up", 0.4)) for _ in range(4)]
    got = {(r["family"], r["arm"]): r for r in sig.dunnett(spark.createDataFrame(rows, SCHEMA), ["family"], "arm", "value", "ctl").collect()}
    assert got[("one", "up")]["p"] < 1e-4 and got[("one", "same")]["p"] > 0.5
    assert got[("one", "lone")]["p"] is None and got[("one", "up")]["arms"] == 2
    assert got[("nocontrol", "up")]["p"] is None and got[("flat", "up")]["p"] is None
    assert len(got) == 5
    g = [np.array(ctl), np.array(ctl) + 0.1, np.array(ctl) + 0.001]
    pooled = sum(((x - x.mean()) ** 2).sum() for x in g) / 12
    assert got[("one", "up")]["t"] == pytest.approx(0.1 / math.sqrt(pooled * 2 / 5))


def test_correction_grows_with_the_family(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0.3, 0.01, 5)
    p = {}
    for k in (1, 3, 8):
        rows = [("f", "ctl", float(v)) for v in base] + [("f", "x", float(v)) for v in base + 0.012]
        rows += [("f", f"o{i}", float(v)) for i in range(k - 1) for v in base]
        p[k] = {r["arm"]: r["p"] for r in sig.dunnett(spark.createDataFrame(rows, SCHEMA), ["family"], "arm", "value", "ctl").collect()}["x"]
    assert p[1] < p[3] < p[8]


def test_welch(spark):
    a, b = [1.0, 2.0, 3.5, 4.0], [2.0, 2.5, 6.0]
    frame = lambda v: spark.createDataFrame([("k", x) for x in v], "k string, value double")
    r = sig.with_t_pvalue(sig.welch_stats(frame(a), frame(b), ["k"], "value")).first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 3
    assert r["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    df = (va + vb) ** 2 / (va**2 / 3 + vb**2 / 2)
    assert r["df"] == pytest.approx(df) and r["p"] == pytest.approx(t_tail(spark, r["t"], df))
    short = sig.with_t_pvalue(sig.welch_stats(frame(a[:1]), frame(b), ["k"], "value")).first()
    assert short["t"] is None and short["p"] is None
