import pytest
from pyspark.sql import functions as F

from assaybook.functions import labels, text
from assaybook.plans.names import SAMPLE


def apply(spark, values, fn, schema="s string"):
    rows = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in rows.select(fn(F.col("s"))).collect()]


def test_seed_round_trip(spark):
    made = ["a__s42", "a", "a__sx", "a__s1__s2", "lr_reduced__f__s7", "__s5", "a__s"]
    assert apply(spark, made, labels.seed_base) == [
        "a", "a", "a__sx", "a__s1", "lr_reduced__f", "", "a__s"]
    assert apply(spark, made, labels.seed_number) == [42, None, None, 2, 7, 5, None]
    assert apply(spark, ["base"], lambda c: labels.seed_label(c, F.lit(3))) == ["base__s3"]


def test_mode_suffix(spark):
    made = ["x__s1", "x__s1__reduced", "x__unlocked", "x__frozen"]
    assert apply(spark, made, labels.mode_suffix_base) == ["x__s1", "x__s1", "x", "x__frozen"]
    assert apply(spark, made, labels.mode_suffix) == ["frozen", "reduced", "unlocked", "frozen"]
    assert apply(spark, ["frozen", "reduced"], lambda c: labels.mode_label(F.lit("b"), c)) == ["b", "b__reduced"]
    with pytest.raises(Exception, match="unknown mode"):
        apply(spark, ["molten"], lambda c: labels.mode_label(F.lit("b"), c))


def test_mode_prefix(spark):
    made = ["f__s1", "lr_reduced__f__s1", "lr_unlocked__a_b", "lr__x", "lr_alone"]
    assert apply(spark, made, labels.mode_prefix) == ["frozen", "reduced", "unlocked", "", "alone"]
    assert apply(spark, made, labels.mode_prefix_flavor) == ["f", "f", "a_b", "x", ""]


def test_namespaces(spark):
    assert apply(spark, ["ablation_full__s1", "full", "ablation_x"], labels.ablation_name) == ["full", "full", "x"]
    assert apply(spark, ["ext__a", "a"], lambda c: labels.strip_prefix(c, "ext__")) == ["a", "a"]
    assert apply(spark, ["bb_press_mt", "press"], lambda c: labels.endpoint_of_template(c, "bb")) == ["press_mt", "press"]
    assert apply(spark, ["frozen", "unlocked"], lambda c: labels.baseline_label("ctl", c)) == ["ctl", "ctl_unlocked"]


def test_dataset_rules(spark):
    made = ["plant_potency_mt", "plant_mt", "plant", "press1_st", "press_mt", "presser_x", "gauge", "new_thing_st"]
    assert apply(spark, made, lambda c: labels.dataset_of(c, SAMPLE)) == [
        "plant_potency", "plant", "plant", "press_line", "press_line", "presser", "gauge", "new"]


def test_an_empty_vocabulary_names_nothing(spark):
    assert apply(spark, ["plant_mt", "gauge"], labels.dataset_of) == ["plant", "gauge"]
    assert apply(spark, ["plant · LOG_rate_A"], text.row_label) == ["LOG rate A"]
    assert apply(spark, ["plant"], text.group_label) == ["plant\n(cluster)"]


def test_texts(spark):
    assert apply(spark, [None, float("nan"), 0.0005, 0.9999, 0.0421, 1.0], text.format_p, "s double") == [
        "", "", "p<.001", "p>.999", "p=0.042", "p>.999"]
    assert apply(spark, [12.4, -3.0, None], lambda c: text.change_text(c, F.lit(0.2)), "s double") == [
        "+12%\np=0.200", "-3%\np=0.200", ""]
    assert apply(spark, [1.5], lambda c: text.change_text(c, F.lit(None).cast("double")), "s double") == ["+2%"]
    assert apply(spark, [0.5], lambda c: text.mean_text(c, F.lit(0.01)), "s double") == ["0.500\n±0.010"]
    rows = ["plant · LOG_rate_A", "lab · LOG_rate_A (lab_mt)", "dock · flow_x", "new · my_end", "AVERAGE"]
    assert apply(spark, rows, lambda c: text.row_label(c, SAMPLE)) == [
        "rate A", "rate A (lab mt)", "dock (cluster) flow x", "my end", "AVERAGE"]
    assert apply(spark, ["plant", "gauge", "other"], lambda c: text.group_label(c, SAMPLE)) == ["Plant\n(predefined)", "", "other\n(cluster)"]
