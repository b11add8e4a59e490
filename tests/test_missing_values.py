"""Null labels, NaN, constant columns, absent classes, large degrees of
freedom, quoted CSV: each case has a defined result."""

import math

import pytest
from pyspark.sql import functions as F

from raretab.functions.pvalues import chi2_sf, normal_two_sided
from raretab.operators import evaluate as EV
from raretab.operators import profile as PR
from raretab.operators import splits as SP
from raretab.operators import stats as ST
from raretab.operators.density import kde_grid
from raretab.operators.impute import impute_grouped_median
from raretab.sources import io as IO

NAN = float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, float(v), 7.0, lev, y) for i, (v, lev, y) in enumerate([
        (1, "a", 0), (2, "a", 0), (3, "b", 0), (4, "b", 1), (5, "b", 1), (6, "a", 1),
        (100, "c", None), (200, "c", None), (NAN, "a", 0), (NAN, "b", 1)])]
    return spark.createDataFrame(rows, "id long, x double, flat double, level string, y int")


def test_large_dof():
    # Wilson-Hilferty is accurate to a few percent of log p at these sizes
    for x, k in ((1500.0, 1500), (3000.0, 2000), (3001.0, 2001), (2600.0, 2401)):
        p = chi2_sf(x, k)
        z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        near = 0.5 * math.erfc(z / math.sqrt(2))
        assert 0 < p < 1 and abs(math.log(p) - math.log(near)) < 0.03 * abs(math.log(near)) + 0.01
    assert math.isnan(chi2_sf(NAN, 3)) and math.isnan(normal_two_sided(NAN))
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_sf(7.814727903251179, 3) - 0.05) < 1e-12


def test_null_labels_belong_to_no_class(odd):
    mw = {r["feature"]: r for r in ST.mann_whitney(odd, ["x"], "y").collect()}
    assert (mw["x"]["n0"], mw["x"]["n1"], mw["x"]["u_stat"]) == (3, 3, 0.0)
    labelled = odd.where("y is not null")
    a = ST.chi_square(odd, ["level"], "y").first()
    b = ST.chi_square(labelled, ["level"], "y").first()
    assert tuple(a) == tuple(b) and a["dof"] == 1


def test_constant_column(odd):
    got = {r["Feature"]: r for r in ST.test_battery(odd, ["x", "flat"], ["level"], "y").collect()}
    assert got["flat"]["p_value"] == 1.0 and got["x"]["p_value"] < 1.0
    dens = kde_grid(odd, ["x", "flat"], "y")
    assert {r["feature"] for r in dens.select("feature").distinct().collect()} == {"x"}


def test_single_class_model_keeps_the_others(spark):
    rows = [("m", i, int(i > 4), i / 10.0) for i in range(10)] + [("only", i, 0, i / 10.0) for i in range(5)]
    s = spark.createDataFrame(rows, "model string, row_id int, y int, p double")
    got = {r["model"]: r["auc_roc"] for r in EV.roc_auc(s).collect()}
    assert got == {"m": 1.0, "only": None}


def test_nan_is_missing(spark, odd):
    counts = {r["column"]: r["n_null"] for r in PR.null_counts(odd).collect()}
    assert counts == {"x": 2, "y": 2}
    d = spark.createDataFrame([("f", 30.0, 20.0), ("f", 31.0, 22.0), ("f", 32.0, NAN), ("m", 30.0, None)],
                              "gender string, age double, bmi_value double")
    got = sorted(r["bmi_value"] for r in impute_grouped_median(d).collect())
    assert got == [20.0, 21.0, 21.0, 22.0]


def test_whisker_does_not_end_inside_the_box(spark):
    d = spark.createDataFrame([(0.0, 1), (0.0, 1), (0.0, 1), (100.0, 1)], "v double, y int")
    r = PR.box_summary(d, ["v"], "y").first()
    assert (r["q3"], r["whisker_hi"], r["whisker_lo"]) == (25.0, 25.0, 0.0)


def test_fold_sizes_and_classes_within_one(spark):
    d = spark.createDataFrame([(i, int(i < 199)) for i in range(4088)], "id long, y int")
    f = SP.stratified_folds(d, "y", "id", 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [817, 817, 818, 818, 818]
    per_class = [r["count"] for r in f.where("y = 1").groupBy("fold").count().collect()]
    assert max(per_class) - min(per_class) <= 1


def test_splits_keep_rows_without_label(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(60)], "id long, y int")
    h = SP.holdout_flag(d, "y", "id", 0.25)
    assert h.count() == 60 and h.where("holdout").count() == 15
    assert SP.stratified_folds(d, "y", "id", 4).count() == 60


def test_lookups_are_not_shuffled_on_hot_keys(spark):
    from raretab.operators.encode import fit_preprocess
    d = spark.createDataFrame([("f", 30.0 + i % 40, 20.0 + i % 7, "a" if i % 3 else "b") for i in range(500)],
                              "gender string, age double, bmi_value double, kind string")
    pre = fit_preprocess(d, ["gender", "kind"])
    plan = pre.transform(d)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_csv_round_trip_of_awkward_text(spark, tmp_path):
    rows = [(1, 'a "quoted" word', 1.5), (2, "two\nlines", 2.0), (3, "comma, inside", None), (4, "NA", 4.0),
            (5, " NA ", 5.0), (6, None, 6.0), (7, '"', 7.0)]
    d = spark.createDataFrame(rows, "id long, s string, x double")
    IO.write_table(d.coalesce(1), str(tmp_path / "t"), fmt="csv")
    got = IO.read_csv(spark, str(tmp_path / "t"))
    assert dict(got.dtypes) == {"id": "bigint", "s": "string", "x": "double"}
    want = [(i, None if s == "NA" else s, x) for i, s, x in rows]
    assert sorted(map(tuple, got.collect())) == want
    raw = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    assert [tuple(r) for r in IO.failed_casts(raw, {"n": "bigint"}).collect()] == [("n", 1)]


def test_correlation_over_numeric_columns_by_type(odd):
    from raretab.operators.features import numeric_columns
    cols = numeric_columns(odd, exclude=["id"])
    assert cols == ["x", "flat", "y"]
    r = {(a["col_i"], a["col_j"]): a["r"] for a in PR.correlation_matrix(odd.where(~F.isnan("x")), cols).collect()}
    assert len(r) == 9 and r["x", "x"] == 1.0
