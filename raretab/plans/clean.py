"""Cleaning job: drop index -> dedup -> grouped-median impute -> interactions.

The cleaned frame feeds several profiles; callers persist it (or write it to
the shared table folder) once instead of recomputing the dedup per profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import age_bin
from ..operators.dedup import dedup
from ..operators.features import cleaning_interactions
from ..operators.impute import impute_grouped_median
from ..sources.fixtures import ID_COL, TARGET
from ..session import cut_lineage
from ..sources.io import drop_index_column
from ..operators.prefix import MAX_BUCKETS


def clean(raw: DataFrame, id_col: str = ID_COL, n_buckets: int = MAX_BUCKETS) -> DataFrame:
    df = drop_index_column(raw)
    # The deduplicated table is read twice (median fit, then fill): write it
    # once to the checkpoint folder rather than shuffling the raw rows twice.
    df = cut_lineage(dedup(df, id_col))
    df = impute_grouped_median(df, "bmi_value", ("gender",), n_buckets=n_buckets)
    return cleaning_interactions(df)


def prevalence_by_bin(cleaned: DataFrame, target: str = TARGET) -> DataFrame:
    """Flagship summary: rows, positives and prevalence per age bin."""
    return (cleaned.withColumn("age_bin", age_bin("age"))
            .groupBy("age_bin")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.sum(target).cast("bigint").alias("n_pos"),
                 F.round(F.avg(F.col(target).cast("double")), 10).alias("prevalence"),
                 F.round(F.avg("bmi_value"), 8).alias("mean_bmi")))
