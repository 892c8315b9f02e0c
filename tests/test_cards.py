import numpy as np
import pytest
from pyspark.sql import functions as F

from assaybook.functions.labels import collapse_seeds
from assaybook.operators import cards, keys, reports, significance
from assaybook.plans.names import SAMPLE
from assaybook.vocabulary import Arm, arm_names, find_arm

ARMS = {"better": (0.50, 0.30), "worse": (0.20, 0.70), "equal": (0.35, 0.50), "ctl": (0.35, 0.50)}
ENDPOINTS = [("gauge_st", "a"), ("press_mt", "b")]


def tidy_rows(seeds=5):
    rng = np.random.default_rng(11)
    return [
        (f"{arm}__s{s}", recipe, e, float(r2 + rng.normal(scale=0.005)), float(mae + rng.normal(scale=0.005)))
        for arm, (r2, mae) in ARMS.items() for s in range(seeds) for recipe, e in ENDPOINTS
    ]


SCHEMA = "flavor string, recipe string, endpoint string, r2 double, mae double"


@pytest.fixture(scope="module")
def frame(spark):
    return cards.prepare_rows(collapse_seeds(spark.createDataFrame(tidy_rows(), SCHEMA)), SAMPLE).cache()


def test_row_identity(spark):
    rows = [("f", "press_mt", "x", 0.0, 0.0), ("f", "press1_st", "x", 0.0, 0.0), ("f", "gauge_st", "x", 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    name = lambda d: sorted(r["row"] for r in cards.prepare_rows(d, SAMPLE).collect())
    assert name(df) == ["gauge · x", "press_line · x (press1_st)", "press_line · x (press_mt)"]
    # an exclusion before naming lets the lone sibling shed its suffix
    assert name(keys.exclude_recipes(df, ["press_mt"])) == ["gauge · x", "press_line · x"]
    with pytest.raises(ValueError, match="typo"):
        keys.exclude_recipes(df, ["press_mt", "typo"])


def test_row_order_and_groups(spark):
    made = [("f", r, e, 0.0, 0.0) for r, e in (
        ("zeta_st", "a"), ("plant_mt", "b"), ("plant_mt", "a"), ("plant_potency_mt", "c"), ("gauge_st", "q"), ("alpha_st", "z"))]
    rows = cards.order_rows(cards.prepare_rows(spark.createDataFrame(made, SCHEMA), SAMPLE), SAMPLE)
    ordered = [r["row"] for r in rows.orderBy("row_ord").collect()]
    assert ordered == ["plant_potency · c", "plant · a", "plant · b", "gauge · q", "zeta · a", "alpha · z"]
    runs = lambda d: sorted((r["start"], r["end"], r["source"]) for r in d.collect())
    assert runs(cards.source_groups(rows)) == [(0, 1, "plant_potency"), (1, 3, "plant"), (3, 4, "gauge"), (4, 5, "zeta"), (5, 6, "alpha")]
    assert runs(cards.merge_groups(rows, SAMPLE))[0] == (0, 3, "plant_potency")


def test_seed_cells_and_delta(frame):
    cells = {(r["row"], r["flavor"]): r for r in cards.seed_matrix(frame, "mae").collect()}
    raw = [r for r in tidy_rows() if r[0].startswith("better") and r[2] == "a"]
    maes = np.array([r[4] for r in raw])
    assert cells[("gauge · a", "better")]["value"] == pytest.approx(maes.mean())
    assert cells[("gauge · a", "better")]["std"] == pytest.approx(maes.std(ddof=1))
    base = cards.reference_series(frame, "ctl", "mae")
    delta = {(r["row"], r["flavor"]): r["delta"] for r in cards.delta_matrix(cards.seed_matrix(frame, "mae"), base).collect()}
    assert delta[("gauge · a", "better")] == pytest.approx(-40, abs=2) and delta[("gauge · a", "ctl")] == pytest.approx(0)
    spread = {(r["row"], r["flavor"]): r["delta_std"] for r in cards.delta_std(cards.seed_matrix(frame, "mae"), base).collect()}
    b = {r["row"]: r for r in base.collect()}["gauge · a"]
    f, s = cells[("gauge · a", "better")]["value"], cells[("gauge · a", "better")]["std"]
    want = 100 * np.sqrt((s / b["base"]) ** 2 + (f * b["base_std"] / b["base"] ** 2) ** 2)
    assert spread[("gauge · a", "better")] == pytest.approx(want)


def test_missing_and_zero_baselines(spark):
    cells = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 1.0), ("c", "f", 1.0)], "row string, flavor string, value double")
    base = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "row string, base double")
    got = {r["row"]: r["delta"] for r in cards.delta_matrix(cells, base).collect()}
    assert got == {"a": None, "b": -50.0, "c": None}


def test_single_seed_has_no_spread(spark):
    df = cards.prepare_rows(collapse_seeds(spark.createDataFrame(tidy_rows(1), SCHEMA)), SAMPLE)
    assert all(r["std"] is None for r in cards.seed_matrix(df, "mae").collect())
    assert reports.arm_summary(spark.createDataFrame(tidy_rows(1), SCHEMA)).filter("std <> 0").isEmpty()


def test_significance_on_the_card(frame):
    rows = cards.order_rows(frame, SAMPLE)
    shown = ["better", "worse", "equal"]
    base = cards.reference_series(frame, "ctl", "mae")
    deltas = cards.delta_matrix(cards.seed_matrix(frame, "mae", shown), base)
    cell_p = significance.cell_pvalues(frame, frame, "ctl", shown)
    per_seed = cards.per_seed_average_delta(frame, rows, base)
    average_p = significance.average_pvalues(per_seed, per_seed, "ctl", shown)
    card = cards.mae_delta_card(deltas, cell_p, average_p, rows, shown).collect()
    by = {(r["row"], r["column"]): r for r in card}
    assert len(card) == 9
    for row in ("gauge · a", "press_line · b", "AVERAGE"):
        assert by[(row, "better")]["color_value"] == by[(row, "better")]["value"] < -30
        assert by[(row, "worse")]["color_value"] == by[(row, "worse")]["value"] > 30
        assert by[(row, "equal")]["color_value"] == 0.0 and by[(row, "equal")]["aux"] > 0.05
        assert "p<.001" in by[(row, "better")]["text"]
    assert {r["row_ord"] for r in card if r["row"] == "AVERAGE"} == {2}


def test_family_is_the_displayed_columns(frame):
    alone = {r["flavor"]: r["p"] for r in significance.cell_pvalues(frame, frame, "ctl", ["equal"]).filter("row = 'gauge · a'").collect()}
    many = {r["flavor"]: r["p"] for r in significance.cell_pvalues(frame, frame, "ctl", ["better", "worse", "equal"]).filter("row = 'gauge · a'").collect()}
    assert set(alone) == {"equal"} and many["equal"] != alone["equal"]


def test_r2_card(frame):
    card = cards.r2_card(frame, "ctl", ["better", "worse", "unrun", "equal"])
    rows = sorted(card.collect(), key=lambda r: (r["row_ord"], r["col_ord"]))
    assert [r["column"] for r in rows[:4]] == ["baseline", "better", "worse", "equal"]
    assert all(r["aux"] is None for r in rows if r["row"] == "AVERAGE")
    cells = [r["value"] for r in rows if r["column"] == "better" and r["row"] != "AVERAGE"]
    assert [r["value"] for r in rows if r["row"] == "AVERAGE" and r["column"] == "better"][0] == pytest.approx(np.mean(cells))


def test_unseeded_rows_are_a_replicate(spark):
    rows = [("f__s1", "gauge_st", "a", 0.2, 1.0), ("f", "gauge_st", "a", 0.4, 1.0), ("f", "press_mt", "b", 0.6, 1.0)]
    df = cards.prepare_rows(collapse_seeds(spark.createDataFrame(rows, SCHEMA)))
    got = {r["seed"]: r["value"] for r in cards.per_seed_average(df, df, "r2").collect()}
    assert got == {1: pytest.approx(0.2), -1: pytest.approx(0.5)}
    only = cards.per_seed_average(df, df.filter("row = 'gauge · a'"), "r2")
    assert {r["seed"]: r["value"] for r in only.collect()} == {1: pytest.approx(0.2), -1: pytest.approx(0.4)}


def test_grid_gate_extent(spark):
    cells = spark.createDataFrame([("r1", "f0", 40.0), ("r2", "f1", -3.0)], "row string, flavor string, delta double")
    assert cards.scale_extent(cells).first()[0] == 25.0
    assert cards.scale_extent(cells.filter("row = 'r2'")).first()[0] == 3.0
    assert cards.scale_extent(cells.withColumn("delta", F.col("delta") * 0)).first()[0] == 1e-6
    assert cards.scale_extent(cells.limit(0)).first()[0] == 1.0
    rows = spark.createDataFrame([("r1", 0), ("r2", 1)], "row string, row_ord int")
    full = cards.complete_grid(cells, rows, ["f0", "f1", "f2"]).collect()
    assert len(full) == 6 and sum(r["delta"] is None for r in full) == 4
    g = spark.createDataFrame([(1.0, 0.01), (1.0, 0.5), (1.0, None), (None, 0.01)], "v double, p double")
    assert [r[0] for r in g.select(cards.gate(F.col("v"), F.col("p"))).collect()] == [1.0, 0.0, 0.0, None]


def test_grid_audit(spark):
    eps = spark.createDataFrame([("press_mt", "a"), ("press_mt", "b")], "recipe string, endpoint string")
    grid = cards.experiment_grid(eps, ["f"], [1, 2], foundation_seed=42)
    assert grid.count() == 12 and {r[0] for r in grid.select("foundation").collect()} == {"f__s42"}
    assert {r[0] for r in cards.experiment_grid(eps, ["f"], [1, 2]).select("foundation").collect()} == {"f__s1", "f__s2"}
    have = grid.filter("mode <> 'unlocked'").select(F.col("label").alias("flavor"), "recipe", "endpoint")
    extra = spark.createDataFrame([("g__s1", "press_mt", "a")], have.schema)
    got = cards.grid_audit(grid, have.union(extra)).groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"missing": 4, "surplus": 1}


def test_registry(spark):
    arms = [Arm("wide", width=3000), Arm("bits", kind="binary", width=1024), Arm("made", corpus_from=None, calculator="wide"),
            Arm("wide_small", derived_from="wide"), Arm("own", corpus_from="made", standalone=True)]
    assert arm_names(arms) == ["wide", "bits", "made", "wide_small"]
    assert find_arm(arms, "own").corpus_from == "made"
    with pytest.raises(KeyError):
        find_arm(arms, "nope")
    table = cards.registry(spark, arms)
    assert [r["ord"] for r in table.orderBy("ord").collect()] == [0, 1, 2, 3, 4]
    got = {r["name"]: r["corpus"] for r in cards.resolve_corpus(table).collect()}
    assert got["own"] == got["made"] == "made" and got["bits"] == "shared"
    present = spark.createDataFrame([("bits",), ("wide",), ("x",)], "flavor string")
    assert [r["name"] for r in cards.column_order(table, present).collect()] == ["wide", "bits"]


def test_a_missing_endpoint_keeps_its_row(spark):
    rows = [("f", "gauge_st", None, 0.5, 1.0), ("f", "gauge_st", "a", 0.4, 1.0)]
    named = cards.prepare_rows(spark.createDataFrame(rows, SCHEMA), SAMPLE)
    assert sorted((r["endpoint"] or "", r["row"]) for r in named.collect()) == [("", "gauge · "), ("a", "gauge · a")]
