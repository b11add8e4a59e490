"""Column expressions shared by the operators.

All randomness is a hash of ``(seed, salt, key)`` so results do not depend
on partitioning or recomputation.  The hash is the first 32 bits of an MD5
digest, which DuckDB computes identically (used by the SQL oracles).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_u32(key: str | Column, salt: str | int) -> Column:
    """Unsigned 32-bit hash of ``'<salt>|<key>'`` as BIGINT."""
    s = F.concat(F.lit(f"{salt}|"), col(key).cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_uniform(key: str | Column, salt: str | int) -> Column:
    """Deterministic uniform in [0, 1) from ``hash_u32``."""
    return hash_u32(key, salt).cast("double") / F.lit(TWO_POW_32)


def right_closed_bin(c: str | Column, edges: Sequence[float],
                     labels: Sequence[str]) -> Column:
    """``(e0, e1], (e1, e2], ...`` with labels; outside or null -> null.

    Spark's ``Bucketizer`` is left-closed, so it is not used here.
    """
    assert len(edges) == len(labels) + 1
    x = col(c)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# The age bins used for grouped imputation.
AGE_EDGES = (0.0, 40.0, 60.0, 200.0)
AGE_LABELS = ("young", "middle", "senior")


def age_bin(c: str | Column = "age") -> Column:
    return right_closed_bin(c, AGE_EDGES, AGE_LABELS)


def safe_div(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, 0 when the denominator is 0 or null."""
    return F.coalesce(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), F.lit(0.0))


def neg_log10_floor(p: str | Column, floor: float = 1e-300) -> Column:
    """``-log10(max(p, floor))``."""
    return -F.log10(F.greatest(col(p), F.lit(floor)))


def title_label(name: str | Column) -> Column:
    """``bmi_value`` -> ``Bmi Value`` (chart labels)."""
    return F.initcap(F.replace(col(name), F.lit("_"), F.lit(" ")))


def nan_to_null(c: str | Column) -> Column:
    """Missing floats are NULL in this library, never NaN."""
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
