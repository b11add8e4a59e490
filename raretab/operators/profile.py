"""Profiling aggregates.

Per-feature loops become one grouped job: features are unpivoted to a long
(feature, value, y) frame first, so each family of statistics is a single
aggregation keyed by ``feature``.  All aggregates are algebraic (partial
aggregation before the shuffle) except the quartiles, which use the exact
bucketed-rank quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import nan_to_null, safe_div
from .prefix import MAX_BUCKETS, range_positions
from .quantiles import grouped_quantiles


# --- long forms --------------------------------------------------------------

def unpivot_numeric(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, value double, y) with missing values (null or NaN) dropped per
    feature and rows without a label left out (P10)."""
    long = df.select(F.col(target).cast("int").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), nan_to_null(F.col(f).cast("double")).alias("value"))
        for f in features])).alias("_kv"))
    return (long.select(F.col("_kv.feature").alias("feature"), F.col("_kv.value").alias("value"), "y")
            .where(F.col("value").isNotNull() & F.col("y").isNotNull()))


def unpivot_levels(df: DataFrame, features: Sequence[str], target: str,
                   keep_null: bool = False) -> DataFrame:
    """(feature, level string, y); null levels dropped unless ``keep_null``;
    rows without a label belong to no class and are left out."""
    long = df.select(F.col(target).cast("int").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level"))
        for f in features])).alias("_kv"))
    out = long.select(F.col("_kv.feature").alias("feature"), F.col("_kv.level").alias("level"), "y")
    out = out.where(F.col("y").isNotNull())
    return out if keep_null else out.where(F.col("level").isNotNull())


# --- class balance -----------------------------------------------------------

def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, count, share); the share window runs over #classes rows."""
    c = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))


def prevalence(df: DataFrame, target: str) -> DataFrame:
    """Rows, positives and prevalence (0 on an empty table)."""
    y = F.col(target).cast("double")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.coalesce(F.sum(target), F.lit(0)).cast("bigint").alias("n_pos"),
                  F.coalesce(F.avg(y), F.lit(0.0)).alias("prevalence"))


def class_ratio(df: DataFrame, target: str) -> DataFrame:
    """A10: negatives / max(positives, 1)."""
    y = F.col(target)
    return df.agg((F.sum((y == 0).cast("double"))
                   / F.greatest(F.sum((y == 1).cast("double")), F.lit(1.0))).alias("class_ratio"))


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, weight = n / (n_classes * n_class))."""
    c = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy()
    return c.select("class", (F.sum("_n").over(w).cast("double")
                              / (F.count(F.lit(1)).over(w) * F.col("_n"))).alias("weight"))


def class_extremes(df: DataFrame, target: str) -> DataFrame:
    """Class counts with the minority and majority class (ties -> the
    smallest class value)."""
    c = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    w = Window.partitionBy()
    return c.select(
        "class", "count",
        F.min_by("class", F.struct(F.col("count"), F.col("class"))).over(w).alias("min_class"),
        F.min_by("class", F.struct(-F.col("count"), F.col("class"))).over(w).alias("max_class"))


# --- missing values ----------------------------------------------------------

def null_counts(df: DataFrame, only_nonzero: bool = True) -> DataFrame:
    """A8 + A9: (column, n_null, null_rate) from a single aggregation; NaN
    counts as missing."""
    cols = df.columns
    floating = {c for c, kind in df.dtypes if kind in ("double", "float")}

    def missing(c: str) -> Column:
        x = F.col(f"`{c}`")
        return x.isNull() | F.isnan(x) if c in floating else x.isNull()

    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(missing(c)).alias(f"_nn{i}") for i, c in enumerate(cols)])
    long = agg.select("_rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_nn{i}").alias("n_null"))
        for i, c in enumerate(cols)])).alias("_kv"))
    out = long.select(F.col("_kv.column").alias("column"),
                      F.col("_kv.n_null").cast("bigint").alias("n_null"),
                      safe_div(F.col("_kv.n_null"), F.col("_rows")).alias("null_rate"))
    return out.where(F.col("n_null") > 0) if only_nonzero else out


# --- categorical profiles ----------------------------------------------------

def contingency_long(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(feature, level, y, count) for all features in one job."""
    return (unpivot_levels(df, features, target)
            .groupBy("feature", "level", "y").agg(F.count(F.lit(1)).cast("bigint").alias("count")))


def contingency_wide(df: DataFrame, feature: str, target: str,
                     classes: Sequence[int] = (0, 1)) -> DataFrame:
    """A13 wide: one row per level, one count column per class."""
    return (df.where(F.col(feature).isNotNull())
            .groupBy(F.col(feature).cast("string").alias("level"))
            .pivot(target, list(classes)).agg(F.count(F.lit(1)))
            .na.fill(0))


def category_counts(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """A14 + K6: counts by class with each level's frequency rank within its
    feature (count desc, then level; null levels kept as their own level)."""
    cnt = (unpivot_levels(df, features, target, keep_null=True)
           .groupBy("feature", "level", "y").agg(F.count(F.lit(1)).cast("bigint").alias("count")))
    tot = cnt.groupBy("feature", "level").agg(F.sum("count").alias("_level_total"))
    order = tot.select(F.col("feature").alias("_f"), (-F.col("_level_total")).alias("_rarity"),
                       F.col("level").isNull().alias("_last"), F.col("level").alias("_l"))
    ranked = range_positions(order, ["_f"], ["_rarity", "_last", "_l"], "_at").select(
        "_f", "_l", (F.col("_at") + 1).cast("int").alias("freq_rank"))
    j = cnt.join(ranked, (F.col("feature") == F.col("_f")) & F.col("level").eqNullSafe(F.col("_l")))
    return j.select("feature", "level", "freq_rank", "y", "count")


def level_prevalence(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Target prevalence per level (leakage audit)."""
    return (unpivot_levels(df, features, target)
            .groupBy("feature", "level")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum("y").cast("bigint").alias("n_pos"),
                 F.avg(F.col("y").cast("double")).alias("prevalence")))


# --- numeric profiles --------------------------------------------------------

def class_means(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Mean per class and the difference (positive minus negative)."""
    long = unpivot_numeric(df, features, target)
    y = F.col("y")
    return long.groupBy("feature").agg(
        F.avg(F.when(y == 0, F.col("value"))).alias("mean_neg"),
        F.avg(F.when(y == 1, F.col("value"))).alias("mean_pos"),
    ).withColumn("mean_diff", F.col("mean_pos") - F.col("mean_neg"))


def box_summary(df: DataFrame, features: Sequence[str], target: str,
                n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme value inside the
    fences) and the number of values outside, per feature and class.
    Everything is computed from one (feature, class, value) count table:
    quartiles by bucketed ranks, whiskers and outliers by a join of that
    table with the fences (one row per feature and class)."""
    from .quantiles import value_counts
    vc = value_counts(unpivot_numeric(df, features, target), ["feature", "y"], "value")
    q = grouped_quantiles(None, ["feature", "y"], "value", [0.25, 0.5, 0.75],
                          ["q1", "median", "q3"], n_buckets=n_buckets, counts=vc)
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("feature", "y", "n", "q1", "median", "q3",
                      (F.col("q1") - 1.5 * iqr).alias("_lo"), (F.col("q3") + 1.5 * iqr).alias("_hi"))
    # one row per feature and class: broadcast, so the counts are not shuffled on those few keys
    j = vc.join(F.broadcast(fences), ["feature", "y"])
    v = F.col("value")
    w = j.groupBy("feature", "y").agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_hi"),
        F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), F.col("_n")).otherwise(F.lit(0)))
        .cast("bigint").alias("n_outliers"))
    # no value between a quartile and its fence: the whisker ends at the quartile
    w = w.join(F.broadcast(fences), ["feature", "y"])
    return w.select("feature", F.col("y").alias("class"), "n", "q1", "median", "q3",
                    F.least("whisker_lo", "q1").alias("whisker_lo"),
                    F.greatest("whisker_hi", "q3").alias("whisker_hi"), "n_outliers")


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles named c0, c1, ..., NaN as null, cast once."""
    return df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])


def _pearson_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """One row with ``r_i_j`` of every pair: Pearson r over the rows where both
    are known; null where one of them does not vary there."""
    x = _numbers(df, columns)

    def r(i: int, j: int) -> Column:
        a, b = F.col(f"c{i}"), F.col(f"c{j}")
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        # the built-in corr divides by zero where a column does not vary
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    return x.agg(*[r(i, j).alias(f"r_{i}_{j}") for i, j in pairs])


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered pair (one agg)."""
    cols = list(columns)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    base = _pearson_pairs(df, cols, pairs) if pairs else df.agg(F.count(F.lit(1)).alias("_n"))

    def item(i: int, j: int, r: Column) -> Column:
        return F.struct(F.lit(cols[i]).alias("col_i"), F.lit(cols[j]).alias("col_j"), r.alias("r"))

    items = [item(*at, F.col(f"r_{i}_{j}")) for i, j in pairs for at in ((i, j), (j, i))]
    items += [item(i, i, F.lit(1.0)) for i in range(len(cols))]
    return base.select(F.explode(F.array(*items)).alias("_kv")).select("_kv.*")


def target_correlations(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, ranked by |r|."""
    feats = [c for c in columns if c != target]
    agg = _pearson_pairs(df, [*feats, target], [(i, len(feats)) for i in range(len(feats))])
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"r_{i}_{len(feats)}").alias("r"))
        for i, c in enumerate(feats)])).alias("_kv")).select("_kv.*")
    return long.withColumn("rank", F.row_number().over(
        Window.orderBy(F.abs("r").desc_nulls_last(), F.col("feature"))))


# --- snapshot ----------------------------------------------------------------

def snapshot(df: DataFrame, target: str, source_name: str, event: str = "Case") -> DataFrame:
    """(Metric, Value) strings: rows, cases, prevalence, source; ``event``
    names what the target counts."""
    a = prevalence(df, target)
    return a.select(F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("Rows").alias("Metric"),
                 F.format_number(F.col("n_rows"), 0).alias("Value")),
        F.struct(F.lit(2).alias("ord"), F.lit(f"{event} cases").alias("Metric"),
                 F.format_number(F.col("n_pos"), 0).alias("Value")),
        F.struct(F.lit(3).alias("ord"), F.lit(f"{event} prevalence").alias("Metric"),
                 F.format_string("%.2f%%", F.col("prevalence") * 100).alias("Value")),
        F.struct(F.lit(4).alias("ord"), F.lit("Source file").alias("Metric"),
                 F.lit(source_name).alias("Value")),
    )).alias("_kv")).select("_kv.*")


def share_label(count: Column, total: Column) -> Column:
    """Chart label ``count\\n(share %.1f%%)``."""
    return F.format_string("%d\n(%.1f%%)", count, count / total * 100)
