"""Bucketed prefix sums: running totals without a single-task window.

An ordered window over a whole table (or over one huge group) runs in one
task.  Here rows are first assigned to a bucket that is monotone in the sort
key, bucket totals (a small table: parts x buckets) are prefixed, and the
final running sum is a window partitioned by (parts, bucket), so every task
holds about 1/B of a part.

Two bucketings are offered:

* quantile buckets: cut points from ``percentile_approx`` of the sort key
  (one broadcast row of doubles), mapped to a bucket by a binary search, and
  each bucket cut into equal value ranges where the input is large.
* a caller-supplied bucket column, e.g. the top bits of a uniform hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKET = "_bkt"


# Quantile buckets of the first level (a power of two): one broadcast row of this many doubles.
MAX_BUCKETS = 1 << 10


def _searched_bucket(x: Column, bounds: Column, n: int) -> Column:
    """Number of the inner ``bounds`` (n - 1 sorted cuts between the first and
    the last entry) that are <= x, n a power of two: a binary search."""
    steps = F.array(*[F.lit(n >> i) for i in range(1, n.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        x >= F.get(bounds, at + step), at + step).otherwise(at))


def _fractions(n: int) -> Column:
    """1/n .. (n-1)/n as one constant (an array of n literals would make a large plan)."""
    return F.split(F.lit(",".join(repr(i / n) for i in range(1, n))), ",").cast("array<double>")


# Target rows per bucket window; fewer rows use fewer buckets (down to one).
ROWS_PER_BUCKET = 100_000


def _coarsen(bkt: Column, nb: int, rows: Column, rows_per_bucket: int | None) -> Column:
    """Map a bucket in [0, nb) onto ``eff = clamp(ceil(rows / R), 1, nb)``
    buckets, keeping it monotone; ``rows`` comes from the same one-row
    aggregate, so the bucket count adapts to the data without a driver step."""
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    eff = F.least(F.lit(nb), F.greatest(F.lit(1), F.ceil(rows / F.lit(float(rows_per_bucket)))))
    return F.floor(bkt * eff / F.lit(nb)).cast("int")


def with_quantile_buckets(df: DataFrame, order_col: str, n_buckets: int = MAX_BUCKETS,
                          descending: bool = False, rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``_bkt``, monotone in ``order_col``, with about ``rows_per_bucket``
    rows in each at every size.

    First level: ``n_buckets`` (rounded down to a power of two) quantile
    buckets, joined to fewer where the input is small.  Second level: where it
    is larger than the first level holds, every quantile bucket is cut into
    equal ranges of values, as many as its rows need; values crowded in one spot
    of a quantile bucket share a range, which is at most 1 / n_buckets of all.

    The cut points and the row count are a one-row aggregate (n_buckets + 1
    doubles whatever the data size) broadcast to every task, so the input is not
    shuffled and nothing reaches the driver.
    """
    nb = 1 << (max(1, n_buckets).bit_length() - 1)
    if nb == 1:
        return df.withColumn(BUCKET, F.lit(0))
    x = F.col(order_col).cast("double")
    cuts = df.agg(F.percentile_approx(x, _fractions(nb), F.lit(16 * nb)).alias("_cuts"),
                  F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    cuts = cuts.select(F.concat(F.array("_lo"), "_cuts", F.array("_hi")).alias("_bounds"), "_rows")
    # Exactly one row: a size-proven broadcast.
    j = df.join(F.broadcast(cuts), how="inner", on=F.lit(True)).withColumn("_level", _searched_bucket(x, F.col("_bounds"), nb))
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(float(nb * (rows_per_bucket or ROWS_PER_BUCKET)))))
    lo, hi = F.get("_bounds", F.col("_level")), F.get("_bounds", F.col("_level") + 1)
    at = F.coalesce(F.floor(F.try_divide(x - lo, hi - lo) * parts), F.lit(0))
    at = F.least(F.greatest(at, F.lit(0)), parts - 1)
    bkt = _coarsen(F.col("_level"), nb, F.col("_rows"), rows_per_bucket) * parts + F.when(parts > 1, at).otherwise(0)
    return j.withColumn(BUCKET, -bkt if descending else bkt).drop("_bounds", "_rows", "_level")


def with_hash_buckets(df: DataFrame, hash_col: str, bits: int,
                      rows_per_bucket: int | None = None) -> DataFrame:
    """Adds ``_bkt`` from the top bits of a uniform 32-bit hash, coarsened to
    about ``rows_per_bucket`` rows per bucket by a one-row count."""
    cnt = df.agg(F.count(F.lit(1)).alias("_rows"))
    j = df.join(F.broadcast(cnt), how="inner", on=F.lit(True))
    bkt = _coarsen(hash_bucket(hash_col, bits), 1 << bits, F.col("_rows"), rows_per_bucket)
    return j.withColumn(BUCKET, bkt).drop("_rows")


def prefix_before(df: DataFrame, parts: Sequence[str], order_cols: Sequence[str],
                  weights: Sequence[str], n_buckets: int = MAX_BUCKETS,
                  bucket_col: Column | None = None, descending: bool = False,
                  with_totals: bool = False, hash_bits: int | None = None) -> DataFrame:
    """Adds ``<w>_before`` for each weight: the sum of ``w`` over rows of the
    same part that sort strictly before this row; with ``with_totals`` also
    ``<w>_total``, the sum over the whole part.

    Rows must be distinct on ``parts + order_cols`` (pre-aggregate ties into
    one row with counts).  ``bucket_col`` must be monotone in the first order
    column (non-increasing when ``descending``); with ``hash_bits`` the first
    order column is a uniform 32-bit hash bucketed by its top bits; by
    default quantile buckets of the first order column are used.
    """
    parts = list(parts)
    if hash_bits is not None:
        # first order column is a uniform 32-bit hash: its top bits are buckets
        b = with_hash_buckets(df, order_cols[0], hash_bits)
    elif bucket_col is None:
        b = with_quantile_buckets(df, order_cols[0], n_buckets, descending)
    else:
        b = df.withColumn(BUCKET, bucket_col)

    # Small table: one row per (part, bucket).
    totals = b.groupBy(*parts, BUCKET).agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    wb = Window.partitionBy(*parts).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    wp = Window.partitionBy(*parts)
    extra = [F.sum(f"_t_{w}").over(wp).alias(f"{w}_total") for w in weights] if with_totals else []
    offsets = totals.select(*parts, BUCKET, *[
        F.coalesce(F.sum(f"_t_{w}").over(wb), F.lit(0)).alias(f"_o_{w}") for w in weights], *extra)

    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    wi = Window.partitionBy(*parts, BUCKET).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_null_safe(b, offsets, [*parts, BUCKET])
    return joined.select(
        *[b[c] for c in df.columns],
        *[(F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(wi), F.lit(0))).alias(f"{w}_before")
          for w in weights],
        *[F.col(f"{w}_total") for w in weights if with_totals])


def range_positions(df: DataFrame, parts: Sequence[str], order_cols: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: the 0-based position of each row in its part, rows being
    distinct on ``parts + order_cols`` (any sortable types).

    The rows are range-partitioned in that order and their partition number is
    the bucket, so a part of any size is spread over as many windows as it has
    partitions.  The numbers are fixed by a reliable checkpoint before the
    bucket totals and the windows read them.
    """
    ranged = df.repartitionByRange(*parts, *order_cols).select(
        *df.columns, F.spark_partition_id().alias(BUCKET), F.lit(1).alias("_one"))
    ranked = prefix_before(cut_lineage(ranged), parts, order_cols, ["_one"], bucket_col=F.col(BUCKET))
    return ranked.withColumn(out, F.col("_one_before")).drop(BUCKET, "_one", "_one_before")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi-join where NULL keys match NULL keys (grouping semantics); the
    right side's key columns are dropped.  Spark plans ``<=>`` keys as an
    ordinary hash/sort-merge join."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def hash_bucket(h: str | Column, bits: int) -> Column:
    """Top ``bits`` bits of an unsigned 32-bit hash: monotone in the hash."""
    x = F.col(h) if isinstance(h, str) else h
    return F.shiftright(x, 32 - bits)
