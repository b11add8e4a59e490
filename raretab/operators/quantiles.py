"""Exact grouped medians and quantiles.

``percentile``/``median`` aggregates keep every value of a group in one
buffer; a group holding a third of the table would land in one task.  Here
values are first counted per (group, value) (map-side combine), ranked with
the bucketed prefix sum, and only the rows that straddle the wanted ranks
are kept.  Results are exact:

* median: mean of the two middle values, ``(a + b) / 2`` for even counts;
* quantile q: linear interpolation at position ``(n-1)q`` between the
  neighbouring order statistics (the usual "linear" definition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import MAX_BUCKETS, prefix_before


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, _n): non-null values counted per group."""
    return (df.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))


def _ranked(vc: DataFrame, keys: Sequence[str], value: str, n_buckets: int) -> DataFrame:
    """Adds ``_n_before`` (rows with a smaller value) and ``_n_total`` per group."""
    return prefix_before(vc, keys, [value], ["_n"], n_buckets=n_buckets, with_totals=True)


def _hit(rank: Column) -> Column:
    """This distinct value covers the 1-based ``rank``."""
    return (F.col("_n_before") < rank) & (rank <= F.col("_n_before") + F.col("_n"))


def median_from_counts(vc: DataFrame, keys: Sequence[str], value: str,
                       out: str = "median", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Medians from a (keys..., value, _n) value-count table."""
    r = _ranked(vc, keys, value, n_buckets)
    lo = F.floor((F.col("_n_total") + 1) / 2)      # 1-based lower middle
    hi = F.floor(F.col("_n_total") / 2) + 1         # 1-based upper middle
    v = F.col(value).cast("double")
    g = r.where(_hit(lo) | _hit(hi)).groupBy(*keys).agg(
        F.max(F.when(_hit(lo), v)).alias("_a"), F.max(F.when(_hit(hi), v)).alias("_b"))
    return g.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(out))


def grouped_median(df: DataFrame, keys: Sequence[str], value: str,
                   out: str = "median", n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """One row per group with at least one non-null value: ``keys + [out]``."""
    return median_from_counts(value_counts(df, keys, value), keys, value, out, n_buckets)


def grouped_and_global_median(df: DataFrame, keys: Sequence[str], value: str,
                              n_buckets: int = MAX_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Group medians and the global median from one value-count pass.

    The global value counts are re-aggregated from the grouped ones (small),
    then both levels are ranked in the same prefix job, keyed by a level
    marker.  Returns (keys..., _grp_median) and a one-row (_global_median).
    """
    vc = value_counts(df, keys, value)
    glob = vc.groupBy(value).agg(F.sum("_n").alias("_n"))
    both = vc.select(F.lit(0).alias("_lvl"), *keys, value, "_n").unionByName(
        glob.select(F.lit(1).alias("_lvl"), *[F.lit(None).alias(k) for k in keys], value, "_n"))
    med = median_from_counts(both, ["_lvl", *keys], value, "_m", n_buckets)
    grouped = med.where(F.col("_lvl") == 0).select(*keys, F.col("_m").alias("_grp_median"))
    global_ = med.where(F.col("_lvl") == 1).select(F.col("_m").alias("_global_median"))
    return grouped, global_


def median_scalar(df: DataFrame, value: str, n_buckets: int = MAX_BUCKETS) -> Column:
    """A5 as a scalar-subquery column (evaluated once, no join)."""
    return grouped_median(df, [], value, "_m", n_buckets).select("_m").scalar()


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                      qs: Sequence[float], names: Sequence[str] | None = None,
                      n_buckets: int = MAX_BUCKETS, counts: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per q.
    ``counts`` may pass a ready (keys..., value, _n) value-count table."""
    names = list(names or [f"q{int(round(q * 100)):02d}" for q in qs])
    vc = counts if counts is not None else value_counts(df, keys, value)
    r = _ranked(vc, keys, value, n_buckets)
    v = F.col(value).cast("double")
    aggs, finals, hits = [], [], []
    for q, name in zip(qs, names):
        h = (F.col("_n_total") - 1).cast("double") * F.lit(float(q))
        lo_r, hi_r = F.floor(h) + 1, F.ceil(h) + 1
        hits += [_hit(lo_r), _hit(hi_r)]
        aggs += [F.max(F.when(_hit(lo_r), v)).alias(f"_a_{name}"),
                 F.max(F.when(_hit(hi_r), v)).alias(f"_b_{name}"),
                 F.max(h - F.floor(h)).alias(f"_t_{name}")]
        a, b, t = F.col(f"_a_{name}"), F.col(f"_b_{name}"), F.col(f"_t_{name}")
        d = b - a
        finals.append(F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t).alias(name))
    cond = hits[0]
    for hcond in hits[1:]:
        cond = cond | hcond
    g = r.where(cond).groupBy(*keys).agg(*aggs, F.max("_n_total").alias("n"))
    return g.select(*keys, "n", *finals)
