"""Evaluation on a long scored table (model, row_id, y, p).

W3 ROC curve, W4 ROC-AUC (rank formula), W5 precision-recall curve,
W6 average precision (step sum, not trapezoid), W7 no-skill baseline,
W8 threshold sweep, K1/K2 threshold tuning per operating mode, A21/A22
confusion counts and metrics, A23 soft voting, M10 results table, K7 best
model per metric, U3/U4 long and pivoted result tables, P12 decisions.

Scores are first counted per (model, score) with positive and negative
counts, so ties collapse and the running sums run on distinct scores via the
bucketed prefix sum (never a single-task window over all rows).  The sweep
is one pass: each row is put in the bucket of the largest threshold k/100
not above its score, and 101 bucket counts per model are reverse-summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import safe_div
from .prefix import MAX_BUCKETS, prefix_before

# Operating modes (precision floor and the objective maximised)
# and the threshold grid 0.01 ... 0.98 with a default of 0.5 when no
# threshold meets the floor.
MODES = (
    ("High Sensitivity", 0.08, "recall"),
    ("Balanced", 0.10, "f1"),
)
GRID_FIRST, GRID_LAST, GRID_STEPS = 1, 98, 100
DEFAULT_THRESHOLD = 0.5


def modes_column(modes: Sequence[tuple[str, float, str]] = MODES) -> Column:
    return F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(fl)).alias("min_precision"),
                              F.lit(o).alias("objective")) for m, fl, o in modes])


def score_counts(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
                 label: str = "y") -> DataFrame:
    """(groups..., score, pos, neg): one row per distinct score."""
    return scored.groupBy(*groups, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("neg"))


def _desc_cumulative(sc: DataFrame, groups: Sequence[str], score: str, n_buckets: int) -> DataFrame:
    r = prefix_before(sc, groups, [score], ["pos", "neg"], n_buckets=n_buckets,
                      descending=True, with_totals=True)
    return r.select(*groups, score, "pos", "neg",
                    (F.col("pos_before") + F.col("pos")).alias("tps"),
                    (F.col("neg_before") + F.col("neg")).alias("fps"),
                    F.col("pos_total").alias("n_pos_all"), F.col("neg_total").alias("n_neg_all"))


def roc_auc(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
            label: str = "y", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """AUC = sum_s pos_s * (neg below s + neg_s / 2) / (P * N)."""
    sc = score_counts(scored, groups, score, label)
    r = prefix_before(sc, groups, [score], ["neg", "pos"], n_buckets=n_buckets, with_totals=True)
    g = r.groupBy(*groups).agg(
        F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_s"),
        F.max("pos_total").alias("_P"), F.max("neg_total").alias("_N"))
    # a group of one class has no AUC (null), the others keep theirs
    return g.select(*groups, F.try_divide(F.col("_s"), F.col("_P").cast("double") * F.col("_N")).alias("auc_roc"))


def roc_curve(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
              label: str = "y", n_buckets: int = MAX_BUCKETS, drop_intermediate: bool = True) -> DataFrame:
    """(groups..., threshold, fpr, tpr) per distinct score plus the
    (0, 0) start at threshold +inf.  With ``drop_intermediate`` a point is
    dropped when it is collinear with its neighbours (its successor in
    descending score order adds the same positives and negatives); the
    first and last points are kept.  The successor is found by an equi-join
    on the cumulative row count, which is unique per distinct score."""
    c = _desc_cumulative(score_counts(scored, groups, score, label), groups, score, n_buckets)
    if drop_intermediate:
        seen = F.col("tps") + F.col("fps")
        succ = c.select(*groups, (seen - F.col("pos") - F.col("neg")).alias("_k"),
                        F.col("pos").alias("_sp"), F.col("neg").alias("_sn"))
        j = c.withColumn("_k", seen).join(succ, [*groups, "_k"], "left")
        first = (seen - F.col("pos") - F.col("neg")) == 0
        keep = first | F.col("_sp").isNull() | (F.col("_sp") != F.col("pos")) | (F.col("_sn") != F.col("neg"))
        c = j.where(keep)
    pts = c.select(*groups, F.col(score).alias("threshold"),
                   safe_div(F.col("fps"), F.col("n_neg_all")).alias("fpr"),
                   safe_div(F.col("tps"), F.col("n_pos_all")).alias("tpr"))
    start = scored.select(*groups).distinct().select(
        *groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def pr_curve(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
             label: str = "y", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(groups..., threshold, precision, recall) per distinct score plus
    the end point (precision 1, recall 0, threshold null)."""
    c = _desc_cumulative(score_counts(scored, groups, score, label), groups, score, n_buckets)
    pts = c.select(*groups, F.col(score).alias("threshold"),
                   safe_div(F.col("tps"), F.col("tps") + F.col("fps")).alias("precision"),
                   F.when(F.col("n_pos_all") == 0, F.lit(1.0)).otherwise(
                       F.col("tps").cast("double") / F.col("n_pos_all")).alias("recall"))
    end = scored.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def average_precision(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
                      label: str = "y", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """W6 + W7: AP = sum_s (pos_s / P) * precision_s (step interpolation),
    and the no-skill baseline P / (P + N)."""
    c = _desc_cumulative(score_counts(scored, groups, score, label), groups, score, n_buckets)
    prec = F.col("tps").cast("double") / (F.col("tps") + F.col("fps"))
    g = c.groupBy(*groups).agg(F.sum(F.col("pos") * prec).alias("_s"), F.max("n_pos_all").alias("_P"),
                               F.max("n_neg_all").alias("_N"))
    return g.select(*groups, safe_div(F.col("_s"), F.col("_P")).alias("auc_pr"),
                    (F.col("_P").cast("double") / (F.col("_P") + F.col("_N"))).alias("baseline"))


def _grid_index(p: Column) -> Column:
    """Largest k in [0, 100] with k / 100 <= p, exact in floating point."""
    k0 = F.floor(p * GRID_STEPS).cast("int")
    k1 = (F.when((k0 + 1) / F.lit(float(GRID_STEPS)) <= p, k0 + 1)
          .when(k0 / F.lit(float(GRID_STEPS)) > p, k0 - 1).otherwise(k0))
    return F.least(F.greatest(k1, F.lit(0)), F.lit(GRID_STEPS))


def threshold_sweep(scored: DataFrame, groups: Sequence[str] = ("model",), score: str = "p",
                    label: str = "y") -> DataFrame:
    """(groups..., k, threshold=k/100, tp, fp, fn, tn, precision, recall,
    f1) for k = 1..98, from one pass over the rows."""
    b = scored.groupBy(*groups, _grid_index(F.col(score)).alias("_k")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_pos"),
        F.sum((F.col(label) != 1).cast("long")).alias("_neg"))
    # Complete 0..100 bucket grid per group (101 rows), zero-filled, then a
    # reverse running sum: tp(k) = positives with score >= k / 100.
    grid = (b.select(*groups).distinct()
            .select(*groups, F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS))).alias("_k")))
    full = grid.join(b, [*groups, "_k"], "left").fillna(0, subset=["_pos", "_neg"])
    w_ge = Window.partitionBy(*groups).orderBy(F.col("_k").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy(*groups)
    cum = full.select(*groups, F.col("_k").alias("k"),
                      F.sum("_pos").over(w_ge).alias("tp"), F.sum("_neg").over(w_ge).alias("fp"),
                      F.sum("_pos").over(w_all).alias("_P"), F.sum("_neg").over(w_all).alias("_N"))
    out = cum.where(F.col("k").between(GRID_FIRST, GRID_LAST)).select(
        *groups, "k", (F.col("k") / F.lit(float(GRID_STEPS))).alias("threshold"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        (F.col("_P") - F.col("tp")).cast("long").alias("fn"),
        (F.col("_N") - F.col("fp")).cast("long").alias("tn"))
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 = 2tp / (2tp + fp + fn), accuracy; every
    zero division gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        "accuracy": safe_div(tp + tn, tp + tn + fp + fn),
    })


def tune_thresholds(sweep: DataFrame, groups: Sequence[str] = ("model",),
                    modes: Sequence[tuple[str, float, str]] = MODES) -> DataFrame:
    """K1 + K2: per (mode, group) the threshold maximising the mode's
    objective among those meeting its precision floor; the lowest threshold
    wins ties; 0.5 when none qualifies."""
    m = sweep.select("*", F.explode(modes_column(modes)).alias("_m"))
    obj = F.when(F.col("_m.objective") == "recall", F.col("recall")).otherwise(F.col("f1"))
    ok = m.where(F.col("precision") >= F.col("_m.min_precision"))
    best = ok.groupBy(F.col("_m.mode").alias("mode"), *groups).agg(
        F.min_by(F.col("k"), F.struct(-obj, F.col("k"))).alias("_k"))
    allp = sweep.select(*groups).distinct().select(
        *groups, F.explode(modes_column(modes)).alias("_m")).select(F.col("_m.mode").alias("mode"), *groups)
    return allp.join(best, ["mode", *groups], "left").select(
        "mode", *groups,
        F.coalesce(F.col("_k") / F.lit(float(GRID_STEPS)), F.lit(DEFAULT_THRESHOLD)).alias("threshold"))


def decisions(scored: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",),
              score: str = "p") -> DataFrame:
    """Per (mode, group) row decisions ``p >= threshold``.  The
    threshold table has one row per (mode, group)."""
    # modes x models rows, bounded by code: broadcast, so rows are not shuffled on a few models
    j = scored.join(F.broadcast(thresholds), list(groups))
    return j.withColumn("pred", (F.col(score) >= F.col("threshold")).cast("int"))


def confusion(scored: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",),
              score: str = "p", label: str = "y") -> DataFrame:
    """A21 + A22: tn, fp, fn, tp and rates per (mode, group, threshold)."""
    d = decisions(scored, thresholds, groups, score)
    y, pr = F.col(label), F.col("pred")
    c = d.groupBy("mode", *groups, "threshold").agg(
        F.count_if((y != 1) & (pr == 0)).cast("long").alias("tn"),
        F.count_if((y != 1) & (pr == 1)).cast("long").alias("fp"),
        F.count_if((y == 1) & (pr == 0)).cast("long").alias("fn"),
        F.count_if((y == 1) & (pr == 1)).cast("long").alias("tp"))
    return with_rates(c)


def results_table(scored: DataFrame, thresholds: DataFrame, groups: Sequence[str] = ("model",),
                  score: str = "p", label: str = "y", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """(mode, group, threshold, auc_roc, auc_pr, recall, precision, f1,
    accuracy), all from one descending cumulative pass over the counted
    scores: the areas as in ``roc_auc`` and ``average_precision``, the
    confusion counts as sums of the counts on either side of the threshold."""
    c = _desc_cumulative(score_counts(scored, groups, score, label), groups, score, n_buckets)
    # modes x models rows, bounded by code: broadcast
    j = c.join(F.broadcast(thresholds), list(groups))
    chosen = F.col(score) >= F.col("threshold")
    below = F.col("n_neg_all") - F.col("fps")
    precise = F.col("tps").cast("double") / (F.col("tps") + F.col("fps"))
    g = j.groupBy("mode", *groups, "threshold").agg(
        F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0)).alias("_area"),
        F.sum(F.col("pos") * precise).alias("_steps"),
        F.sum(F.when(chosen, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(chosen, F.col("neg")).otherwise(0)).alias("fp"),
        F.max("n_pos_all").alias("_P"), F.max("n_neg_all").alias("_N"))
    rated = with_rates(g.withColumns({"fn": F.col("_P") - F.col("tp"), "tn": F.col("_N") - F.col("fp")}))
    return rated.select("mode", *groups, "threshold",
                        F.try_divide(F.col("_area"), F.col("_P").cast("double") * F.col("_N")).alias("auc_roc"),
                        safe_div(F.col("_steps"), F.col("_P")).alias("auc_pr"), "recall", "precision", "f1", "accuracy")


METRICS = ("auc_roc", "auc_pr", "recall", "precision", "f1")


def results_long(results: DataFrame, model_col: str = "model",
                 metrics: Sequence[str] = METRICS) -> DataFrame:
    """(mode, model, metric, value)."""
    return results.unpivot(["mode", model_col], list(metrics), "metric", "value")


def best_by_metric(results: DataFrame, model_col: str = "model",
                   metrics: Sequence[str] = METRICS) -> DataFrame:
    """K7: best model per (mode, metric); ties -> the smaller model name."""
    lg = results_long(results, model_col, metrics)
    return lg.groupBy("mode", "metric").agg(
        F.min_by(model_col, F.struct(-F.col("value"), F.col(model_col))).alias("best_model"),
        F.max("value").alias("best_value"))


def metric_matrix(results: DataFrame, models: Sequence[str], model_col: str = "model",
                  metrics: Sequence[str] = METRICS) -> DataFrame:
    """U4: metrics as rows, one column per model, per mode."""
    lg = results_long(results, model_col, metrics)
    return lg.groupBy("mode", "metric").pivot(model_col, list(models)).agg(F.first("value"))


def soft_vote(scored: DataFrame, name: str = "voting", id_col: str = "row_id",
              label: str = "y", score: str = "p", models: Sequence[str] | None = None) -> DataFrame:
    """Unweighted mean of the models' scores per row, as a new
    model in the long table; scores are summed in sorted order, so the result
    does not depend on the order in which rows arrive."""
    src = scored if models is None else scored.where(F.col("model").isin(list(models)))
    v = src.groupBy(id_col, label).agg((F.aggregate(
        F.sort_array(F.collect_list(score)), F.lit(0.0), lambda a, x: a + x) / F.count(score)).alias(score))
    return v.select(F.lit(name).alias("model"), id_col, label, score)


def wide_scores(scored: DataFrame, models: Sequence[str], id_col: str = "row_id",
                label: str = "y", score: str = "p") -> DataFrame:
    """One row per id with one score column per model (pivot)."""
    return scored.groupBy(id_col, label).pivot("model", list(models)).agg(F.first(score))
