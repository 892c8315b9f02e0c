import numpy as np
import pytest

from assaybook.operators import cards, reports
from assaybook.plans.names import SAMPLE
from test_cards import SCHEMA, frame, tidy_rows  # noqa: F401


def cells_of(spark, table):
    rows = [(row, arm, v, i) for row, values in table.items() for i, (arm, v) in enumerate(values.items())]
    return spark.createDataFrame(rows, "row string, flavor string, value double, col_ord int")


def test_ranking_and_wins(spark):
    cells = cells_of(spark, {"a": {"x": 0.9, "y": 0.5, "z": 0.5}, "b": {"x": 0.1, "y": 0.3, "z": 0.3}, "c": {"x": None, "y": 0.2, "z": 0.1}})
    best = [(r["flavor"], r["wins"]) for r in reports.rank_arms(cells, "r2").collect()]
    assert best == [("x", 1), ("y", 2), ("z", 0)]             # ties go to the first in order
    low = {r["flavor"]: (r["mean"], r["median"], r["wins"]) for r in reports.rank_arms(cells, "mae").collect()}
    assert low["y"] == (pytest.approx(1 / 3), pytest.approx(0.3), 1) and low["x"][2] == 1 and low["z"][2] == 1


def test_column_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("ctl", 0.1)], "column string, average double")
    order = lambda asc: [r["column"] for r in reports.rank_columns(df, asc, "ctl").orderBy("position").collect()]
    assert order(False) == ["ctl", "c", "a", "b"] and order(True) == ["ctl", "a", "c", "b"]
    assert [r["column"] for r in reports.rank_columns(df, True).orderBy("position").collect()] == ["ctl", "a", "c", "b"]


def test_protocols(spark):
    rows = [(f"{p}f__s{s}", "e", v + 0.01 * s) for p, v in (("", 0.3), ("lr_reduced__", 0.5), ("lr_unlocked__", 0.2)) for s in (1, 2)]
    rows += [("stranger__s1", "e", 0.9)]
    df = spark.createDataFrame(rows, "flavor string, endpoint string, r2 double")
    frame_ = reports.mode_flavor_frame(df, "r2", ["f", "g"])
    matrix = reports.mode_matrix(frame_)
    assert [tuple(r) for r in matrix.collect()] == [("f · e", pytest.approx(0.315), pytest.approx(0.515), pytest.approx(0.215))]
    s = {r["mode"]: r for r in reports.mode_summary(matrix, "r2").collect()}
    assert s["frozen"]["wins"] is None and s["reduced"]["wins"] == 1 and s["unlocked"]["wins"] == 0
    assert s["reduced"]["mean_delta"] == pytest.approx(0.2) and s["reduced"]["n"] == 1
    flipped = {r["mode"]: r["wins"] for r in reports.mode_summary(matrix, "mae").collect()}
    assert flipped["reduced"] == 0 and flipped["unlocked"] == 1


def test_comparison_verdict(spark):
    means = spark.createDataFrame([("x", "frozen", 0.5), ("y", "frozen", 0.4), ("x", "reduced", 0.1), ("y", "reduced", 0.2)],
                                  "flavor string, mode string, value double")
    matrix, winners = reports.mode_comparison(means, "r2")
    assert matrix.columns == ["flavor", "frozen", "reduced", "unlocked"]
    assert {(r["mode"], r["winner"], r["stable"]) for r in winners.collect()} == {("frozen", "x", False), ("reduced", "y", False)}


def test_control(spark):
    rows = [("sub__s1", "a", 0.2), ("sub__s1", "b", 0.4), ("sub__s2", "a", 0.7), ("ctl__s1", "a", 0.99), ("ctl__s2", "a", 0.95),
            ("near__s1", "a", 0.45), ("far__s1", "a", 0.9)]
    df = spark.createDataFrame(rows, "flavor string, endpoint string, r2 double")
    s = {r["flavor"]: r for r in reports.arm_summary(df).collect()}
    assert s["sub"]["mean"] == pytest.approx(0.5) and s["sub"]["std"] == pytest.approx(np.std([0.3, 0.7], ddof=1)) and s["sub"]["n"] == 2
    assert s["near"]["std"] == 0.0
    r = reports.control_comparison(df, "sub", "ctl", ["near", "far", "absent"]).first()
    assert r["nearest"] == "near" and r["distance"] == pytest.approx(0.05) and r["delta"] == pytest.approx(-0.47)
    assert r["t"] is not None and r["significant"] in (True, False)
    lone = reports.control_comparison(df, "near", "ctl", ["far"]).first()
    assert lone["p"] is None and lone["significant"] is False


def test_external(spark):
    got = reports.external_test_report(spark.createDataFrame([("ns__" + r[0], *r[1:]) for r in tidy_rows()], SCHEMA),
                                       "gauge_st", "ctl", prefix="ns__").collect()
    assert [r["flavor"] for r in got][0] == "better" and got[-1]["flavor"] == "worse"
    star = {r["flavor"]: r["star"] for r in got}
    assert star == {"better": True, "worse": True, "equal": False, "ctl": False}
    assert {r["flavor"]: r["delta"] for r in got}["ctl"] is None


def test_boxes(spark, frame):  # noqa: F811
    values = [1.0, 2.0, 2.5, 3.0, 4.0, 50.0, -40.0]
    df = spark.createDataFrame([(f"r{i}", "x", v) for i, v in enumerate(values)] + [("r0", "y", 7.0), ("r1", "y", None)],
                               "row string, flavor string, value double")
    got = {r["flavor"]: r for r in reports.box_stats(df).collect()}
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    assert (got["x"]["q1"], got["x"]["median"], got["x"]["q3"]) == (pytest.approx(q1), pytest.approx(med), pytest.approx(q3))
    assert got["x"]["whisker_low"] == 1.0 and got["x"]["whisker_high"] == 4.0 and got["x"]["n"] == 7
    assert got["y"]["whisker_low"] == got["y"]["whisker_high"] == 7.0 and got["y"]["n"] == 1
    cells = cards.seed_matrix(frame, "r2").select("row", "flavor", "value")
    table = {r["flavor"]: r for r in reports.average_summary(cells, cards.per_seed_average(frame, frame, "r2")).collect()}
    card = {r["column"]: r["value"] for r in cards.r2_card(frame, "ctl", ["better", "worse", "equal"]).collect() if r["row"] == "AVERAGE"}
    for arm in ("better", "worse", "equal"):
        assert table[arm]["average"] == pytest.approx(card[arm]) and table[arm]["n_seeds"] == 5


def test_holm_variance_depth_runoff(spark):
    tests = spark.createDataFrame([("r", a, p) for a, p in (("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None))], "row string, flavor string, p double")
    got = {r["flavor"]: r["p_holm"] for r in reports.holm(tests).collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None
    df = spark.createDataFrame([("r", "a", 1.0), ("r", "a", 3.0), ("r", "b", 1.0), ("r", "b", 2.0)], "row string, flavor string, mae double")
    assert reports.variance_ratio(df, "mae").first()["variance_ratio"] == pytest.approx(4.0)
    ballots = {f"r{i}": dict(zip("xyz", v)) for i, v in enumerate([(3, 2, 1)] * 4 + [(1, 3, 2)] * 3 + [(1, 2, 3)] * 2)}
    cells = cells_of(spark, {k: {a: float(v) for a, v in d.items()} for k, d in ballots.items()})
    got = [(r["round"], r["flavor"], r["votes"], r["eliminated"]) for r in reports.instant_runoff(cells, "r2").collect()]
    assert got == [(1, "x", 4, False), (1, "y", 3, False), (1, "z", 2, True), (2, "x", 4, False), (2, "y", 5, False)]


def test_ablation_scope(spark):
    rows = [(f"ablation_{arm}__s{s}{m}", r, "x", v, 1.0) for arm, v in (("full", 0.4), ("minimal", 0.2)) for s in (1, 2)
            for m in ("", "__reduced") for r in ("press_mt", "press1_st")] + [("ctl__s1", "press_mt", "x", 0.3, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    frame_ = reports.ablation_frame(df, ["press_mt"], ["reduced"], SAMPLE)
    got = {(r["mode"], r["row"]) for r in frame_.select("mode", "row").distinct().collect()}
    assert got == {("frozen", "press_line · x (press_mt)"), ("frozen", "press_line · x (press1_st)"), ("reduced", "press_line · x")}
    cells = reports.ablation_cells(frame_, "r2", ["minimal", "full"])
    ranked = [(r["mode"], r["flavor"], r["wins"]) for r in reports.rank_arms(cells, "r2", ["mode"]).collect()]
    assert ranked == [("frozen", "full", 2), ("frozen", "minimal", 0), ("reduced", "full", 1), ("reduced", "minimal", 0)]
    with pytest.raises(ValueError):
        reports.ablation_frame(df, ["typo"], ["reduced"])


def test_summary_without_the_baseline_protocol(spark):
    df = spark.createDataFrame([("lr_reduced__f__s1", "e", 0.5)], "flavor string, endpoint string, r2 double")
    matrix = reports.mode_matrix(reports.mode_flavor_frame(df, "r2", ["f"]), ["reduced"])
    r = reports.mode_summary(matrix, "r2", ["reduced"]).first()
    assert r["mean"] == 0.5 and r["wins"] is None and r["mean_delta"] is None
