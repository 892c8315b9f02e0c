import os

import pytest
from pyspark.sql import functions as F

from assaybook.operators import keys
from assaybook.operators.prescale import fit_recipe
from assaybook.operators.steps import RECIPES
from assaybook.operators.splits import chunk_split
from assaybook.sources import readers, writers
from assaybook.sources import records as records_module
from test_prescale import CHUNK, N, frame, raw_matrix


def test_read_keys(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO name one\n\n   \n  c1ccccc1\tx\nN\n")
    (tmp_path / "b.smi").write_text("O\n")
    got = [(r["row_id"], r["key"]) for r in readers.read_keys(spark, str(tmp_path)).orderBy("row_id").collect()]
    assert got == [(0, "CCO"), (1, "c1ccccc1"), (2, "N"), (3, "O")]


def test_standardize(spark):
    rows = ["CCO.Cl", "[Na+].CC(=O)O.CC(=O)O", "CCO", "", "  ", ".", None, "A.B"]
    df, counts = keys.standardize_keys(spark.createDataFrame(list(enumerate(rows)), "i int, k string"), "k")
    got = {r["i"]: (r["canonical"], r["stripped"]) for r in df.collect()}
    assert got == {0: ("CCO", True), 1: ("CC(=O)O", True), 2: ("CCO", False), 7: ("A", True)}
    assert counts.get == {"rows": 8, "failed": 4, "stripped": 3}


def test_plugged_canonicalizer(spark):
    import pandas as pd

    @F.pandas_udf("struct<canonical: string, stripped: boolean>")
    def upper(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"canonical": s.where(s != "bad").str.upper(), "stripped": s.str.contains("x")})

    df, counts = keys.standardize_keys(spark.createDataFrame([("ax",), ("bad",), ("c",)], "k string"), "k", upper)
    assert sorted((r["canonical"], r["stripped"]) for r in df.collect()) == [("AX", True), ("C", False)]
    assert counts.get["failed"] == 1


def test_subset_counts_failures_before_the_last_key(spark):
    from assaybook.operators.ordering import hash_order

    df = spark.createDataFrame([(i, "" if i % 3 == 0 else f"k{i}.x") for i in range(200)], "row_id long, k string")
    order = [r["row_id"] for r in df.orderBy(hash_order(5, "row_id")).collect()]
    kept = failed = 0
    for i in order:
        failed, kept = (failed + 1, kept) if i % 3 == 0 else (failed, kept + 1)
        if kept == 40:
            break
    r = keys.subset_counts(df, 40, 5, None, "row_id", "k").first()
    assert (r["kept"], r["failed"], r["stripped"]) == (40, failed, 40)
    few = keys.seeded_subset(df, 500, 5)
    assert few.count() == 200 and keys.seeded_subset(df, 37, 5).count() == 37


def test_wide_csv(spark, tmp_path, caplog):
    path = tmp_path / "w.csv"
    path.write_text('index,smiles,t 1,Public Source,t.2\n0,CCO.Cl,1.5,a,x\n1,"N",,b,-2\n2,,7,c,8\n3,C,nan,d, 3e2 \n')
    df, targets = readers.read_wide_csv(spark, str(path))
    assert targets == ["t 1", "t.2"] and "expected 25" in caplog.text
    made, counts = readers.wide_csv_to_matrix(df, "smiles", targets)
    assert {r["key"]: r["features"] for r in made.collect()} == {"CCO": [1.5, None], "N": [None, -2.0], "C": [None, 300.0]}
    assert counts.get == {"rows": 4, "failed": 1, "stripped": 1}


def test_result_tree(spark, tmp_path):
    def unit(label, recipe, text):
        d = tmp_path / "results" / label / recipe / "data"
        os.makedirs(d)
        (d / "y_test.csv").write_text(text)

    unit("f__s1", "press_mt", 'a,"b,c"\n1.0,\n2.5,"3"\n\n,4\n')
    unit("f__s2", "gauge_st", "a\n7\n")
    unit("f__s1", "broken_st", "a\n1,2,3\n")
    unit("f__s1", "empty_st", "")
    good, rejects = readers.read_result_tree(spark, str(tmp_path / "results"))
    got = sorted((r["label"], r["recipe"], r["row_id"], r["column"], r["value"]) for r in good.collect() if r["value"] is not None)
    assert got == [("f__s1", "press_mt", 0, "a", 1.0), ("f__s1", "press_mt", 1, "a", 2.5), ("f__s1", "press_mt", 1, "b,c", 3.0),
                   ("f__s1", "press_mt", 2, "b,c", 4.0), ("f__s2", "gauge_st", 0, "a", 7.0)]
    assert sorted((r["recipe"], r["error"]) for r in rejects.collect()) == [
        ("broken_st", "1 rows are wider than the header"), ("empty_st", "empty file")]
    only, _ = readers.read_result_tree(spark, str(tmp_path / "results"), ["f__s2"])
    assert only.count() == 1


CELLS = ["1.5", '"2,5"', '"7\n8"', '"a ""b"" c"', "", " 3 ", '"\n"', "it's 5\" long", '""', '"x\r\ny,""\n"']


@pytest.mark.parametrize("seed", range(2))
def test_records_equal_pandas_wherever_blocks_are_cut(spark, tmp_path, seed):
    """Quoted commas, quotes and line feeds, in blocks of a few bytes, as pandas reads them."""
    import random

    import pandas as pd

    rnd = random.Random(seed)
    rows = [["a", '"b,c"', '"d\ne"']] + [[rnd.choice(CELLS) for _ in range(3)] for _ in range(40)]
    text = "".join(",".join(r) + rnd.choice(["\n", "\r\n", "\n\n"]) for r in rows if any(c.strip() for c in r))
    (tmp_path / "x.csv").write_bytes(text.encode())
    (tmp_path / "open.csv").write_text('a\n1\n"never closed\n2\n')
    want = pd.read_csv(tmp_path / "x.csv", header=None, dtype=str, keep_default_na=False)
    for size in (40, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
            records, broken = records_module.csv_records(lines, F.element_at(F.split("_metadata.file_path", "/"), -1))
            got = [r["cells"] for r in records.filter("path = 'x.csv'").orderBy("block", "seq").collect()]
            assert got == [[c.strip() if "\n" not in c else c for c in r] for r in want.values.tolist()]
            assert [r["path"] for r in broken.collect()] == ["open.csv"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_wide_line_takes_linear_time():
    import time

    def seconds(n):
        line = ",".join(['"1,5"'] * n)
        start = time.perf_counter()
        for _ in range(20):
            assert len(records_module.fields(line)) == n and not records_module.ends_inside(line, False)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(3585 * 8) < 8 * 4 * seconds(3585)


def test_a_file_that_ends_inside_a_quote_is_rejected(spark, tmp_path):
    for label, text in (("good", 'a,"b, c"\n1,"2"\n"3\n",4\n'), ("bad", 'a,b\n1,"2\n3,4\n')):
        d = tmp_path / "tree" / label / "r"
        d.mkdir(parents=True)
        (d / "y_test.csv").write_text(text)
    good, rejects = readers.read_result_tree(spark, str(tmp_path / "tree"))
    assert sorted((r["label"], r["row_id"], r["column"], r["value"]) for r in good.collect()) == [
        ("good", 0, "a", 1.0), ("good", 0, "b, c", 2.0), ("good", 1, "a", 3.0), ("good", 1, "b, c", 4.0)]
    assert [(r["label"], r["error"]) for r in rejects.collect()] == [("bad", "a quote is left open")]


def test_melt(spark):
    truth = spark.createDataFrame([(0, 1.0, None), (1, None, float("nan")), (2, 3.0, 4.0)], "row_id int, b double, a double")
    pred = spark.createDataFrame([(i, [10.0 + i, 20.0 + i]) for i in range(3)], "row_id int, y_pred array<double>")
    got = sorted((r["row_id"], r["endpoint"], r["y_true"], r["y_pred"]) for r in readers.melt_predictions(pred, truth, ["row_id"]).collect())
    assert got == [(0, "b", 1.0, 10.0), (2, "a", 4.0, 22.0), (2, "b", 3.0, 12.0)]
    sidecar = readers.melt_predictions(pred, truth, ["row_id"], ["a", "b"])
    assert sorted((r["row_id"], r["endpoint"], r["y_pred"]) for r in sidecar.collect()) == [(0, "b", 20.0), (2, "a", 12.0), (2, "b", 22.0)]


def test_matrix_round_trip(spark, tmp_path):
    df = frame(spark, raw_matrix())
    path = str(tmp_path / "m")
    writers.write_matrix(df, path, CHUNK)
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_matrix(df, path, CHUNK)
    writers.write_matrix(df, path, CHUNK, force=True)
    back = spark.read.parquet(path)
    assert back.count() == N and back.select("chunk_id").distinct().count() == 60
    split = chunk_split(spark, N, CHUNK)
    writers.write_split(df, split, str(tmp_path / "s"))
    assert sorted(d for d in os.listdir(tmp_path / "s") if d.startswith("side")) == ["side=train", "side=val"]
    model = fit_recipe(df, split, RECIPES["order_fix"])
    writers.save_stats(model.column_stats(spark), str(tmp_path / "stats"))
    assert spark.read.parquet(str(tmp_path / "stats")).count() == 9
    assert readers.row_count(spark, path) == N


def test_shards_and_orphans(spark, tmp_path):
    df = frame(spark, raw_matrix())
    paths = []
    for s in range(2):
        part = df.filter(F.col("row_id").between(s * 750, s * 750 + 749)).withColumn("row_id", F.col("row_id") - s * 750)
        paths.append(str(tmp_path / f"shard{s}"))
        writers.write_matrix(part, paths[-1])
    merged = readers.merge_shards(spark, paths, N, 11)
    assert sorted(r[0] for r in merged.select("row_id").collect()) == list(range(N))
    for bad in ((paths, N + 1, 11), (paths, N, 12)):
        with pytest.raises(ValueError):
            readers.merge_shards(spark, *bad)
    dead = df.withColumn("features", F.transform("features", lambda x: F.lit(float("inf"))))
    assert readers.is_orphan(dead) and not readers.is_orphan(df) and readers.is_orphan(df.limit(0))
    with pytest.raises(ValueError):
        readers.require_some_success(dead)


def test_metrics_table(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = [("f__s1", "gauge", "gauge_st", "a", 0.5, 1.0, 0.5, 1.0, None, 0.2, None, 10, 90)]
    writers.write_table(spark.createDataFrame(rows, readers.METRICS_SCHEMA), path)
    assert [tuple(r) for r in readers.read_metrics(spark, path).collect()] == rows
    with pytest.raises(ValueError):
        writers.write_table(spark.range(1), path, "magic")


def test_label_cleanup(spark):
    from assaybook.functions.cells import is_finite, log_scale, row_failed

    df = spark.createDataFrame([(15.0, "a"), (0.0, "b"), (None, "c")], "HLM double, k string")
    got = {r["k"]: r["LOG_HLM"] for r in log_scale(df, ["HLM"]).collect()}
    assert got["a"] == pytest.approx(1.17609, abs=1e-5) and got["b"] is None and got["c"] is None
    assert keys.apply_dropna(df, ["HLM"], True).count() == 2 and keys.apply_dropna(df, ["HLM"], False).count() == 3
    assert [r["x"] for r in keys.harmonize(df, {"x": "k", "y": "HLM"}, ["y"]).orderBy("x").collect()] == ["a", "b"]
    assert keys.filter_key_length(df.withColumn("k", F.repeat("k", 100)), "k").count() == 0
    train = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    tests = [spark.createDataFrame([("b",)], "k string"), spark.createDataFrame([("z",), ("b",)], "k string")]
    assert sorted(str(r[0]) for r in keys.drop_leakage(train, tests, "k").collect()) == ["None", "a"]
    cells = spark.createDataFrame([([1.0, float("nan")],), ([float("inf"), None],), (None,)], "f array<double>")
    assert [r[0] for r in cells.select(row_failed(F.col("f"))).collect()] == [False, True, True]
    assert [r[0] for r in cells.select(F.transform("f", is_finite)).collect()] == [[True, False], [False, False], None]


def test_evaluate_tree(spark, tmp_path):
    from assaybook.sources.results import evaluate_tree

    def unit(label, recipe, **files):
        d = tmp_path / "r" / label / recipe / "data"
        os.makedirs(d)
        for name, text in files.items():
            (d / f"{name}.csv").write_text(text)

    import numpy as np

    unit("f__s1", "gauge_st", y_test="a,b\n1,\n2,5\n4,6\n", y_pred="b,a\n0,1\n5,3\n7,4\n", y_train="a,b\n0,1\n,3\n2,2\n")
    unit("f__s2", "gauge_st", y_test="a\n1\n", y_train="a\n1\n")                       # no predictions
    unit("f__s3", "gauge_st", y_test="a\n1\n", y_train="a\n1\n")
    arrays = tmp_path / "r"
    np.save(arrays / "f__s1" / "gauge_st" / "data" / "y_pred.npy", np.array([[0.0, 1], [5, 3], [7, 4]]))
    (arrays / "f__s1" / "gauge_st" / "data" / "target_cols.json").write_text('["b", "a"]')
    (arrays / "f__s3" / "gauge_st" / "data" / "y_pred.npy").write_bytes(b"broken")
    for pred in ("y_pred.csv", "y_pred.npy"):
        metrics, rejects = evaluate_tree(spark, str(arrays), pred=pred)
        got = {r["endpoint"]: r for r in metrics.collect()}
        assert set(got) == {"a", "b"}
        a = got["a"]
        assert (a["flavor"], a["dataset"], a["n_test"], a["n_train"]) == ("f__s1", "gauge", 3, 2)
        assert a["mae"] == pytest.approx(1 / 3) and a["rae"] == pytest.approx((1 / 3) / (4 / 3)) and a["spearman"] == pytest.approx(1.0)
        assert got["b"]["n_test"] == 2 and got["b"]["mse"] == pytest.approx(0.5)
    assert {r["label"]: r["error"] for r in rejects.collect()} == {"f__s2": "no y_pred.npy", "f__s3": "ValueError"}
    # without the sidecar the truth file's own column order counts
    (arrays / "f__s1" / "gauge_st" / "data" / "target_cols.json").unlink()
    swapped = {r["endpoint"]: r["mae"] for r in evaluate_tree(spark, str(arrays))[0].collect()}
    assert swapped["a"] == pytest.approx((1 + 3 + 3) / 3)


def test_predictions_of_another_shape_are_rejected(spark, tmp_path):
    """Fewer predictions than truths must not pass as a score over those that match."""
    import numpy as np

    from assaybook.sources.results import evaluate_tree

    for label, shape in (("short", (6, 1)), ("wide", (10, 2)), ("right", (10, 1)), ("untrained", (10, 1))):
        d = tmp_path / "t" / label / "gauge_st"
        os.makedirs(d)
        (d / "y_test.csv").write_text("a\n" + "".join(f"{i}\n" for i in range(10)))
        if label != "untrained":
            (d / "y_train.csv").write_text("a\n1\n2\n")
        np.save(d / "y_pred.npy", np.arange(shape[0] * shape[1], dtype=float).reshape(shape))
    metrics, rejects = evaluate_tree(spark, str(tmp_path / "t"))
    assert [(r["flavor"], r["n_test"], r["r2"]) for r in metrics.collect()] == [("right", 10, 1.0)]
    assert {r["label"]: r["error"] for r in rejects.collect()} == {
        "short": "6 rows of predictions for 10 of truths", "wide": "2 columns of predictions for 1 of truths",
        "untrained": "no y_train.csv"}


def test_unquoted_trees_skip_the_quote_pass(spark, tmp_path, monkeypatch):
    """Without a quote no line is judged in Python; with some, only the lines that hold one are."""
    from assaybook.sources import records as records_module

    for label, text in (("a", "t,late\n1,2\n\n3,\n"), ("b", "t,late\n4,5\n")):
        (tmp_path / "tree" / label / "r1").mkdir(parents=True)
        (tmp_path / "tree" / label / "r1" / "y_test.csv").write_text(text)
    refuse = lambda batches: (_ for _ in ()).throw(AssertionError("a line without a quote was judged"))
    with monkeypatch.context() as m:
        m.setattr(records_module, "_block_ends", refuse)
        good, rejects = readers.read_result_tree(spark, str(tmp_path / "tree"))
        found = {(r["label"], r["row_id"], r["column"]): r["value"] for r in good.collect()}
        assert rejects.count() == 0
    assert found == {("a", 0, "t"): 1.0, ("a", 0, "late"): 2.0, ("a", 1, "t"): 3.0, ("a", 1, "late"): None,
                     ("b", 0, "t"): 4.0, ("b", 0, "late"): 5.0}
    (tmp_path / "tree" / "b" / "r1" / "y_test.csv").write_text('t,late\n"4",5\n6,7\n')
    good, _ = readers.read_result_tree(spark, str(tmp_path / "tree"))
    assert {(r["row_id"], r["value"]) for r in good.filter("label = 'b'").collect()} == {(0, 4.0), (0, 5.0), (1, 6.0), (1, 7.0)}
