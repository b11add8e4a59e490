"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each entry runs over the whole fixture derived from the driver tables; the
matching DuckDB statement lives in ``oracles.py`` under the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators.quantiles import grouped_median
from ..sources import fixtures as FX
from . import clean as C

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _rounded(df: DataFrame, c: str, digits: int) -> DataFrame:
    """Sums of doubles in another order differ in the last bits; rounding is
    for the comparison only and stays out of the operators."""
    return df.withColumn(c, F.round(c, digits))


# --- step 1: cleaning slice -------------------------------------------------

@query("clean_prevalence_by_bin")
def q_clean_prevalence_by_bin(spark, sf):
    return C.prevalence_by_bin(C.clean(FX.patients_raw(spark, sf)))


@query("clean_table")
def q_clean_table(spark, sf):
    return C.clean(FX.patients_raw(spark, sf))


@query("dedup_rows")
def q_dedup_rows(spark, sf):
    return D.dedup(FX.patients_raw(spark, sf), FX.ID_COL)


@query("dedup_summary")
def q_dedup_summary(spark, sf):
    return D.dedup_summary(D.dedup_with_counts(FX.patients_raw(spark, sf), FX.ID_COL))


@query("dedup_removed_by_class")
def q_dedup_removed_by_class(spark, sf):
    return D.removed_by_class(D.dedup_with_counts(FX.patients_raw(spark, sf), FX.ID_COL), FX.TARGET)


@query("dedup_documents")
def q_dedup_documents(spark, sf):
    d = D.dedup_with_counts(FX.doc_fields(spark, sf), "doc_id")
    return D.dedup_summary(d)


@query("grouped_median_bmi")
def q_grouped_median_bmi(spark, sf):
    from ..functions.exprs import age_bin
    p = FX.patients(spark, sf).withColumn("age_bin", age_bin("age"))
    return grouped_median(p, ["gender", "age_bin"], "bmi_value", out="median_bmi")


@query("global_median_bmi")
def q_global_median_bmi(spark, sf):
    return grouped_median(FX.patients(spark, sf), [], "bmi_value", out="median_bmi")


@query("grouped_median_lineitem")
def q_grouped_median_lineitem(spark, sf):
    from .. sources.io import read_table
    li = read_table(spark, sf, "lineitem")
    return grouped_median(li, ["l_returnflag", "l_linestatus"], "l_extendedprice",
                          out="median_price")


# --- step 2: profiling ------------------------------------------------------

from ..operators import profile as PR  # noqa: E402
from ..operators import stats as ST  # noqa: E402

NUM = list(FX.NUMERIC_TESTED)
CAT = list(FX.CATEGORICAL_TESTED)
CORR_COLS = ["age", "has_hypertension", "has_heart_disease", "marital_status", "glucose_level",
             "bmi_value", "stroke_event"]


@query("class_counts")
def q_class_counts(spark, sf):
    return PR.class_counts(FX.patients(spark, sf), FX.TARGET)


@query("prevalence")
def q_prevalence(spark, sf):
    return PR.prevalence(C.clean(FX.patients_raw(spark, sf)), FX.TARGET)


@query("class_ratio")
def q_class_ratio(spark, sf):
    return PR.class_ratio(FX.patients(spark, sf), FX.TARGET)


@query("balanced_weights")
def q_balanced_weights(spark, sf):
    return PR.balanced_weights(FX.patients(spark, sf), FX.TARGET)


@query("class_extremes")
def q_class_extremes(spark, sf):
    return PR.class_extremes(FX.patients(spark, sf), FX.TARGET)


@query("null_counts")
def q_null_counts(spark, sf):
    return PR.null_counts(FX.patients(spark, sf))


@query("contingency_long")
def q_contingency_long(spark, sf):
    return PR.contingency_long(FX.patients(spark, sf), CAT, FX.TARGET)


@query("category_counts")
def q_category_counts(spark, sf):
    return PR.category_counts(FX.patients(spark, sf), list(FX.CATEGORICAL), FX.TARGET)


@query("level_prevalence")
def q_level_prevalence(spark, sf):
    return PR.level_prevalence(FX.patients(spark, sf), CAT, FX.TARGET)


@query("class_means")
def q_class_means(spark, sf):
    m = PR.class_means(FX.patients(spark, sf), NUM, FX.TARGET)
    return m.select("feature", *[F.round(c, 8).alias(c) for c in ("mean_neg", "mean_pos", "mean_diff")])


@query("box_summary")
def q_box_summary(spark, sf):
    return PR.box_summary(FX.patients(spark, sf), NUM, FX.TARGET)


@query("correlation_matrix")
def q_correlation_matrix(spark, sf):
    return _rounded(PR.correlation_matrix(FX.patients(spark, sf), CORR_COLS), "r", 8)


@query("target_correlations")
def q_target_correlations(spark, sf):
    return _rounded(PR.target_correlations(FX.patients(spark, sf), CORR_COLS, FX.TARGET), "r", 8)


@query("snapshot")
def q_snapshot(spark, sf):
    return PR.snapshot(C.clean(FX.patients_raw(spark, sf)), FX.TARGET, "patients_cleaned", event="Stroke")


@query("avg_ranks_age")
def q_avg_ranks_age(spark, sf):
    long = PR.unpivot_numeric(FX.patients(spark, sf), ["age"], FX.TARGET)
    return ST.average_ranks(long, ["feature"], "value").select(
        "feature", "value", "n0", "n1", "t", "avg_rank")


@query("mann_whitney")
def q_mann_whitney(spark, sf):
    m = ST.mann_whitney(FX.patients(spark, sf), NUM, FX.TARGET)
    return m.select("feature", "n0", "n1", "u_stat", F.round("z", 9).alias("z"))


@query("chi_square")
def q_chi_square(spark, sf):
    c = ST.chi_square(FX.patients(spark, sf), CAT, FX.TARGET)
    return c.select("feature", F.round("statistic", 9).alias("statistic"), "dof")


@query("test_battery")
def q_test_battery(spark, sf):
    return _rounded_tests(ST.test_battery(FX.patients(spark, sf), NUM, CAT, FX.TARGET))


def _rounded_tests(t: DataFrame) -> DataFrame:
    for c, digits in (("p_value", 12), ("statistic", 6), ("neg_log10_p", 6)):
        t = _rounded(t, c, digits)
    return t


# --- step 3: splits, folds, permutation --------------------------------------

from ..operators import splits as SP  # noqa: E402


def _patient_split(spark, sf):
    from ..session import cut_lineage
    return cut_lineage(SP.three_way_split(FX.patients(spark, sf), FX.TARGET, FX.ID_COL, 0.2, 0.2, seed=42))


@query("split_sizes")
def q_split_sizes(spark, sf):
    return SP.split_report(_patient_split(spark, sf), "split", FX.TARGET)


@query("split_membership")
def q_split_membership(spark, sf):
    return _patient_split(spark, sf).select(FX.ID_COL, "split")


@query("fold_sizes")
def q_fold_sizes(spark, sf):
    f = SP.stratified_folds(FX.patients(spark, sf), FX.TARGET, FX.ID_COL, k=5, seed=42)
    return f.groupBy("fold", FX.TARGET).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("fold_membership")
def q_fold_membership(spark, sf):
    f = SP.stratified_folds(FX.patients(spark, sf), FX.TARGET, FX.ID_COL, k=5, seed=42)
    return f.select(FX.ID_COL, FX.TARGET, "fold")


@query("early_stop_sizes")
def q_early_stop_sizes(spark, sf):
    train = _patient_split(spark, sf).where(F.col("split") == "train")
    e = SP.early_stop_flag(train, FX.TARGET, FX.ID_COL, 0.12, seed=42)
    return e.groupBy("is_validation", FX.TARGET).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("permuted_labels")
def q_permuted_labels(spark, sf):
    p = FX.patients(spark, sf).select(FX.ID_COL, FX.TARGET)
    return SP.permute_labels(p, FX.TARGET, FX.ID_COL, seed=42, out="y_perm").select(
        FX.ID_COL, FX.TARGET, "y_perm")


# --- step 5: evaluation on formula scores ------------------------------------

from ..operators import evaluate as EV  # noqa: E402

EVAL_MODELS = ["a", "b", "c", "voting"]


def _scored_with_vote(spark, sf):
    s = FX.scored(spark, sf)
    return s.unionByName(EV.soft_vote(s, "voting", models=["a", "b", "c"]))


def _tuned(spark, sf):
    s = _scored_with_vote(spark, sf)
    return s, EV.tune_thresholds(EV.threshold_sweep(s))


@query("soft_vote")
def q_soft_vote(spark, sf):
    return EV.soft_vote(FX.scored(spark, sf), "voting", models=["a", "b", "c"])


@query("wide_scores")
def q_wide_scores(spark, sf):
    return EV.wide_scores(FX.scored(spark, sf), ["a", "b", "c"])


@query("roc_auc")
def q_roc_auc(spark, sf):
    return EV.roc_auc(_scored_with_vote(spark, sf))


@query("average_precision")
def q_average_precision(spark, sf):
    return _rounded(EV.average_precision(_scored_with_vote(spark, sf)), "auc_pr", 10)


@query("roc_curve")
def q_roc_curve(spark, sf):
    return EV.roc_curve(FX.scored(spark, sf))


@query("pr_curve")
def q_pr_curve(spark, sf):
    return EV.pr_curve(FX.scored(spark, sf))


@query("threshold_sweep")
def q_threshold_sweep(spark, sf):
    return EV.threshold_sweep(_scored_with_vote(spark, sf))


@query("tuned_thresholds")
def q_tuned_thresholds(spark, sf):
    return _tuned(spark, sf)[1]


@query("confusion_at_tuned")
def q_confusion_at_tuned(spark, sf):
    s, t = _tuned(spark, sf)
    return EV.confusion(s, t)


@query("results_table")
def q_results_table(spark, sf):
    s, t = _tuned(spark, sf)
    return _rounded(EV.results_table(s, t), "auc_pr", 10)


@query("results_long")
def q_results_long(spark, sf):
    s, t = _tuned(spark, sf)
    return EV.results_long(_rounded(EV.results_table(s, t), "auc_pr", 10))


@query("best_by_metric")
def q_best_by_metric(spark, sf):
    s, t = _tuned(spark, sf)
    return EV.best_by_metric(_rounded(EV.results_table(s, t), "auc_pr", 10))


@query("metric_matrix")
def q_metric_matrix(spark, sf):
    s, t = _tuned(spark, sf)
    return EV.metric_matrix(_rounded(EV.results_table(s, t), "auc_pr", 10), EVAL_MODELS)


# --- step 6: oversampling ------------------------------------------------------

from ..operators import oversample as OV  # noqa: E402


def _embed_plan(spark, sf):
    e = FX.embed_binary(spark, sf)
    return e, OV.plan_oversampling(e, "y", OV.DEFAULT_RATIO, OV.DEFAULT_K)


def _round_vec(c: str, digits: int = 6):
    return F.transform(F.col(c), lambda x: F.round(x, digits)).alias(c)


@query("knn_minority")
def q_knn_minority(spark, sf):
    e, plan = _embed_plan(spark, sf)
    mino = e.where(F.col("y") == plan.min_class)
    k = OV.knn_within(mino, "vec_id", "features", plan.k_eff, plan.n_min)
    return k.select("vec_id", "nbr_id", "rank", F.round("dist2", 9).alias("dist2"))


@query("smote_synthetic")
def q_smote_synthetic(spark, sf):
    e, plan = _embed_plan(spark, sf)
    s = OV.synthetic_rows(spark, e, "vec_id", "features", "y", plan, seed=42)
    return s.select("draw", "src_id", "nbr_id", "gap", _round_vec("features"))


@query("smote_counts")
def q_smote_counts(spark, sf):
    e = FX.embed_binary(spark, sf)
    o = OV.oversample(spark, e, "vec_id", "features", "y")
    return o.groupBy("origin", "y").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


# --- step 8: density ------------------------------------------------------------

from ..operators.density import kde_grid  # noqa: E402


@query("kde_grid")
def q_kde_grid(spark, sf):
    d = kde_grid(FX.patients(spark, sf), NUM, FX.TARGET)
    return d.select("feature", "class", "j", F.round("x", 6).alias("x"),
                    F.round("density", 9).alias("density"))


# --- step 4: sources, projections, preprocessing --------------------------------

from ..operators import features as FE  # noqa: E402
from ..operators.encode import fit_label_codes, fit_preprocess  # noqa: E402
from ..sources import io as IO  # noqa: E402


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """S5 -> S1/S2/S4: write the patients table as header CSV (with an extra
    index column) into the session's checkpoint folder, read it back with
    the missing-token reader and typed safe casts."""
    import uuid
    from pyspark.sql import types as T
    from ..session import ensure_checkpoint_dir
    p = FX.patients(spark, sf)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    out = p.select(F.col("patient_id").alias(IO.INDEX_COLUMN), *p.columns)
    IO.write_table(out, path, fmt="csv")
    schema = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    back = IO.read_csv(spark, path, schema)
    return back.select(*[F.col(c).cast(T._parse_datatype_string(schema[c])).alias(c) for c in p.columns])


@query("csv_quoted_newlines")
def q_csv_quoted_newlines(spark, sf):
    """All documents as CSV, newlines inside quoted fields, read
    back by byte ranges; texts are compared by digest."""
    import uuid
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    docs = IO.read_table(spark, sf, "documents").select("doc_id", "source", "text")
    IO.write_table(docs, path, fmt="csv")
    back = IO.read_csv(spark, path, {"doc_id": "bigint"})
    return back.select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"),
                       F.length("text").cast("long").alias("n_chars"),
                       (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n")))).cast("long").alias("n_newlines"))


@query("model_features")
def q_model_features(spark, sf):
    p = FE.drop_present(FX.patients(spark, sf).withColumn("row_id", F.col(FX.ID_COL)), FX.MODEL_DROP)
    x = FE.model_features(p)
    return x.select("row_id", *[c for c in FE.MODEL_FEATURES if c != "log_glucose"],
                    F.round("log_glucose", 10).alias("log_glucose"))


@query("fill_zero")
def q_fill_zero(spark, sf):
    p = FX.patients(spark, sf).select("patient_id", "bmi_value", "bmi_category")
    return FE.fill_zero(p)


@query("high_risk_profile")
def q_high_risk_profile(spark, sf):
    h = FE.high_risk_profile(FX.patients(spark, sf))
    return h.groupBy("risk_criteria", "high_risk", FX.TARGET).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("extra_features")
def q_extra_features(spark, sf):
    from ..operators.features import extra_features
    from ..operators.quantiles import median_scalar
    p = FX.patients(spark, sf)
    x = extra_features(p, median_scalar(p, "bmi_value")).select(
        "patient_id", "age_over_10", "glucose_per_bmi", "bmi_deviation")
    return _rounded(_rounded(x, "glucose_per_bmi", 10), "bmi_deviation", 10)


@query("correlation_by_type")
def q_correlation_by_type(spark, sf):
    """P11 + A19: every numeric column of the table, chosen by type."""
    from ..operators.features import numeric_columns
    p = FX.patients(spark, sf)
    return _rounded(PR.correlation_matrix(p, numeric_columns(p, exclude=[FX.ID_COL])), "r", 8)


@query("chart_labels")
def q_chart_labels(spark, sf):
    """Chart text: title-cased names and ``count (share%)`` per class."""
    from ..functions.exprs import title_label
    c = PR.class_counts(FX.patients(spark, sf), FX.TARGET)
    total = F.sum("count").over(Window.partitionBy())
    return c.select("class", title_label(F.lit(FX.TARGET)).alias("title"),
                    PR.share_label(F.col("count"), total).alias("label"))


@query("label_codes")
def q_label_codes(spark, sf):
    return fit_label_codes(FX.patients(spark, sf), list(FX.CATEGORICAL))


@query("preprocess_train_apply")
def q_preprocess_train_apply(spark, sf):
    """State fitted on the training split only, applied to the test split."""
    sp = _patient_split(spark, sf)
    train = sp.where(F.col("split") != "test").drop("split")
    test = sp.where(F.col("split") == "test").drop("split")
    pre = fit_preprocess(train, list(FX.CATEGORICAL))
    return pre.transform(test).select(FX.ID_COL, "bmi_value", *FX.CATEGORICAL)


# --- step 7: models (rows-only checks) ------------------------------------------

@query("base_model_results")
def q_base_model_results(spark, sf):
    """Both phases for the base models and their vote, uncut settings: fit on
    the inner training split, tune thresholds on validation, refit on the full
    training split, evaluate on test with those thresholds."""
    from . import ensemble as EN
    return EN.run_ensemble(spark, FX.patients_raw(spark, sf), stacking=False).results


@query("stacking_results")
def q_stacking_results(spark, sf):
    """As ``base_model_results`` with out-of-fold stacking over five folds:
    (mode, model, threshold, metrics on test) of all five models."""
    from . import ensemble as EN
    return EN.run_ensemble(spark, FX.patients_raw(spark, sf)).results


@query("label_shuffle_auc")
def q_label_shuffle_auc(spark, sf):
    from . import ensemble as EN
    from ..operators import models as MD
    return EN.label_shuffle_auc(spark, FX.patients_raw(spark, sf), MD.default_specs())


# --- step 8: sinks, chart tables, report extras -----------------------------------

@query("snapshot_preferred_source")
def q_snapshot_preferred_source(spark, sf):
    """S3 + S5 + A25: write the cleaned table to the shared folder, then
    load 'cleaned if present, else raw' and report the snapshot with the
    source name."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    cleaned_path = f"{base}/patients_cleaned-{uuid.uuid4().hex}.parquet"
    IO.write_table(C.clean(FX.patients_raw(spark, sf)), cleaned_path)
    df, source = IO.load_preferred(spark, cleaned_path, f"{sf.rstrip('/')}/orders.parquet")
    return PR.snapshot(df, FX.TARGET, source.split("-")[0], event="Stroke")


@query("test_summary_sink")
def q_test_summary_sink(spark, sf):
    """The test table written as header CSV and read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tests-{uuid.uuid4().hex}"
    IO.write_table(ST.test_battery(FX.patients(spark, sf), NUM, CAT, FX.TARGET), path, fmt="csv")
    return _rounded_tests(IO.read_csv(spark, path, {"p_value": "double", "statistic": "double",
                                                    "neg_log10_p": "double"}))


@query("contingency_wide_smoking")
def q_contingency_wide_smoking(spark, sf):
    w = PR.contingency_wide(FX.patients(spark, sf), "smoking_habit", FX.TARGET)
    return w.select("level", F.col("0").cast("bigint").alias("n_neg"), F.col("1").cast("bigint").alias("n_pos"))


EXT_NUM = [*NUM, "age_squared", "age_x_hypertension"]
EXT_CAT = [*CAT, "marital_status"]


@query("mann_whitney_extended")
def q_mann_whitney_extended(spark, sf):
    """T-5: the battery's rank test over the longer feature list (cleaned table)."""
    m = ST.mann_whitney(C.clean(FX.patients_raw(spark, sf)), EXT_NUM, FX.TARGET)
    return m.select("feature", "n0", "n1", "u_stat", F.round("z", 9).alias("z"))


@query("chi_square_extended")
def q_chi_square_extended(spark, sf):
    c = ST.chi_square(C.clean(FX.patients_raw(spark, sf)), EXT_CAT, FX.TARGET)
    return c.select("feature", F.round("statistic", 9).alias("statistic"), "dof")


@query("feature_importance")
def q_feature_importance(spark, sf):
    """M9 + K3: boosted-model importances on the full training split."""
    from . import ensemble as EN
    return EN.boosted_importance(spark, FX.patients_raw(spark, sf))


# --- the same operators on real labels and on the largest table -------------------

@query("doc_labels_chi_square")
def q_doc_labels_chi_square(spark, sf):
    c = ST.chi_square(FX.doc_labels(spark, sf), ["lang", "source", "quality"], "toxic")
    return c.select("feature", F.round("statistic", 9).alias("statistic"), "dof")


@query("doc_labels_mann_whitney")
def q_doc_labels_mann_whitney(spark, sf):
    m = ST.mann_whitney(FX.doc_labels(spark, sf), ["n_chars"], "toxic")
    return m.select("feature", "n0", "n1", "u_stat", F.round("z", 9).alias("z"))


@query("customer_rank_tests")
def q_customer_rank_tests(spark, sf):
    """T-1 for every customer: prices of finished orders (class 1) against the
    others.  Most samples are tiny and without ties: exact p-values; a customer
    with one class only has no test."""
    from ..sources.io import read_table
    long = (read_table(spark, sf, "orders")
            .select("o_custkey", F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
            .dropna())
    t = ST.with_rank_p(ST.rank_tests(long, ["o_custkey"]))
    return t.select("o_custkey", "n0", "n1", "u_stat", "tied",
                    F.round("p_value", 10).alias("p_value"))


@query("lineitem_correlation")
def q_lineitem_correlation(spark, sf):
    from ..sources.io import read_table
    li = read_table(spark, sf, "lineitem")
    return _rounded(PR.correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r", 8)
