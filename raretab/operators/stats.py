"""Rank and contingency tests (W2, T-1, T-2, T-4, P16, K4).

Mann-Whitney U (two-sided, normal approximation with tie-corrected variance
and continuity correction; the exact distribution for a class of at most eight
rows without ties) and chi-square independence (Yates correction
when dof = 1), for many features at once: features are unpivoted so every
statistic is one grouped job keyed by feature.  Ranks come from the
bucketed prefix sum over distinct (feature, value) rows, so no task ever
holds a whole feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import neg_log10_floor
from ..functions.pvalues import p_from_chi2, p_from_ranks
from .prefix import MAX_BUCKETS, prefix_before
from .profile import unpivot_levels, unpivot_numeric


def average_ranks(long: DataFrame, parts: Sequence[str], value: str, target: str = "y",
                  n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Distinct (parts, value) rows with per-class counts and the
    average (mid) rank of the value within its part."""
    vc = long.groupBy(*parts, value).agg(
        F.sum((F.col(target) == 0).cast("long")).alias("n0"),
        F.sum((F.col(target) == 1).cast("long")).alias("n1"),
        F.count(F.lit(1)).alias("t"))
    r = prefix_before(vc, parts, [value], ["t"], n_buckets=n_buckets)
    return r.withColumn("avg_rank", F.col("t_before").cast("double") + (F.col("t") + 1) / 2.0)


def mann_whitney(df: DataFrame, features: Sequence[str], target: str,
                 n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """T-1: (feature, n0, n1, u_stat, z, tied) — U of class 0 as reported, |z| of
    the tie- and continuity-corrected normal approximation, whether two rows
    share a value."""
    return rank_tests(unpivot_numeric(df, features, target), ["feature"], n_buckets=n_buckets)


def rank_tests(long: DataFrame, parts: Sequence[str], value: str = "value", target: str = "y",
               n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """T-1 for every part of a long table, however many there are: (parts, n0,
    n1, u_stat, z, tied)."""
    ranks = average_ranks(long, parts, value, target, n_buckets)
    # exact sums: twice the mid-rank and t^3 - t are integers, summed as decimals
    twice = (2 * F.col("t_before") + F.col("t") + 1).cast("decimal(19,0)")
    t = F.col("t").cast("decimal(12,0)")
    g = ranks.groupBy(*parts).agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"),
        (F.sum(F.col("n0").cast("decimal(18,0)") * twice).cast("double") / 2).alias("_r0"),
        F.sum((t * t - 1) * t).cast("double").alias("_ties"))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u0 = F.col("_r0") - n0 * (n0 + 1) / 2
    mu = n0 * n1 / 2
    u_big = F.greatest(u0, n0 * n1 - u0)
    sigma = F.sqrt(F.greatest(n0 * n1 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))), F.lit(0.0)))
    # one value throughout: no evidence either way, z = 0 (p = 1); an absent class has no test
    z = F.when((n0 > 0) & (n1 > 0), F.coalesce(F.try_divide(u_big - mu - 0.5, sigma), F.lit(0.0)))
    return g.select(*parts, F.col("n0").cast("bigint").alias("n0"),
                    F.col("n1").cast("bigint").alias("n1"),
                    u0.alias("u_stat"), z.alias("z"), (F.col("_ties") > 0).alias("tied"))


def with_rank_p(tests: DataFrame) -> DataFrame:
    """Adds ``p_value`` to the rows of ``rank_tests`` (null where z is)."""
    return tests.withColumn("p_value", p_from_ranks(*[F.col(c) for c in ("z", "u_stat", "n0", "n1", "tied")]))


def chi_square(df: DataFrame, features: Sequence[str], target: str,
               correction: bool = True) -> DataFrame:
    """T-2: (feature, statistic, dof) over the full level x class table
    (cells never observed count as 0).  Yates correction when dof = 1."""
    obs = (unpivot_levels(df, features, target)
           .groupBy("feature", "level", "y").agg(F.count(F.lit(1)).alias("o")))
    rows = obs.groupBy("feature", "level").agg(F.sum("o").alias("r_tot"))
    cols = obs.groupBy("feature", "y").agg(F.sum("o").alias("c_tot"))
    dims = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"),
                                       F.sum("r_tot").alias("n"))
    dims = dims.join(cols.groupBy("feature").agg(F.count(F.lit(1)).alias("n_classes")), "feature")
    # Full grid: levels x classes per feature (both small, joined on feature).
    grid = rows.join(cols, "feature").join(dims, "feature")
    cells = grid.join(obs, ["feature", "level", "y"], "left").fillna(0, subset=["o"])
    e = F.col("r_tot").cast("double") * F.col("c_tot") / F.col("n")
    d = F.abs(F.col("o") - e)
    dof = (F.col("n_levels") - 1) * (F.col("n_classes") - 1)
    adj = F.when((dof == 1) & F.lit(correction), F.least(F.lit(0.5), d)).otherwise(F.lit(0.0))
    return cells.groupBy("feature").agg(
        F.sum((d - adj) * (d - adj) / e).alias("statistic"),
        F.first(dof).cast("int").alias("dof"))


def test_battery(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                 target: str, n_buckets: int = MAX_BUCKETS) -> DataFrame:
    """T-4 + T-3 + P16 + K4: (Feature, Test, p_value, statistic, neg_log10_p),
    ordered by significance within each test."""
    mw = with_rank_p(mann_whitney(df, numeric, target, n_buckets)).select(
        F.col("feature").alias("Feature"), F.lit("Mann-Whitney U").alias("Test"),
        "p_value", F.col("u_stat").alias("statistic"))
    cs = chi_square(df, categorical, target).select(
        F.col("feature").alias("Feature"), F.lit("Chi-square").alias("Test"),
        p_from_chi2(F.col("statistic"), F.col("dof")).alias("p_value"), "statistic")
    out = mw.unionByName(cs).withColumn("neg_log10_p", neg_log10_floor("p_value"))
    # one row per tested feature: the sort is over a handful of rows
    return out.orderBy(F.col("Test").desc(), F.col("neg_log10_p").asc())
