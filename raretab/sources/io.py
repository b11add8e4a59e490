"""Readers and sinks.

CSV files are read as strings first so that a whole list of missing-value
markers maps to NULL (Spark's reader accepts one ``nullValue``), then cast
with ``try_cast`` so malformed numbers become NULL instead of failing.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import read_csv_text

# The missing-value markers a CSV reader treats as NA by default
# (pandas' documented default list).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# An accidental index column written by a previous CSV export.
INDEX_COLUMN = "Unnamed: 0"


def normalise_missing(c: str, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """A string column with any missing token (compared as written) -> NULL."""
    x = F.col(f"`{c}`")
    return F.when(x.isin(list(tokens)), F.lit(None)).otherwise(x)


# Doubled quotes, quoted separators and quoted newlines, for reading and writing alike.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True,
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def infer_types(raw: DataFrame) -> dict[str, str]:
    """Column -> ``bigint`` / ``double`` when every non-missing text casts,
    from one aggregation over all rows; other columns stay strings."""
    cols = raw.columns
    if not cols:
        return {}
    got = raw.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(F.col(f"`{c}`")).alias(f"_n{i}"),
        F.count(F.col(f"`{c}`").try_cast("bigint")).alias(f"_l{i}"),
        F.count(F.col(f"`{c}`").try_cast("double")).alias(f"_d{i}"))]).first()
    out = {}
    for i, c in enumerate(cols):
        n, whole, real = got[f"_n{i}"], got[f"_l{i}"], got[f"_d{i}"]
        if n and whole == n:
            out[c] = "bigint"
        elif n and real == n:
            out[c] = "double"
    return out


def failed_casts(raw: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """(column, n_failed): non-missing texts that a safe cast turns into NULL."""
    named = [c for c in raw.columns if targets.get(c, "string") != "string"]
    agg = raw.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(targets[c]).isNull())
                    .alias(f"_f{i}") for i, c in enumerate(named)] or [F.lit(0).alias("_none")])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_f{i}").alias("n_failed"))
                                          for i, c in enumerate(named)])).alias("_kv")).select("_kv.*")


def read_csv(spark: SparkSession, path: str,
             schema: T.StructType | Mapping[str, str] | None = None,
             tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """S1 + S2 + S4: header CSV, missing tokens -> NULL, safe casts, and the
    accidental index column dropped when present.  Large files are read in
    many tasks (see ``records``).

    ``schema`` gives target types per column, columns not named staying
    strings; without one, numeric columns are found by ``infer_types``.
    """
    raw = read_csv_text(spark, path, CSV_OPTIONS)
    raw = raw.select(*[normalise_missing(c, tokens).alias(c) for c in raw.columns])
    targets: dict[str, str] = {}
    if schema is None:
        targets = infer_types(raw)
    elif isinstance(schema, T.StructType):
        targets = {f.name: f.dataType.simpleString() for f in schema.fields}
    elif schema:
        targets = dict(schema)
    cols = []
    for c in raw.columns:
        v = F.col(f"`{c}`")
        if c in targets and targets[c] != "string":
            v = v.try_cast(targets[c])
        cols.append(v.alias(c))
    return drop_index_column(raw.select(*cols))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver parquet tables: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def drop_index_column(df: DataFrame) -> DataFrame:
    """``drop`` is already a no-op on absent names."""
    return df.drop(INDEX_COLUMN)


def load_preferred(spark: SparkSession, cleaned_path: str, raw_path: str,
                   reader=None) -> tuple[DataFrame, str]:
    """S3: read the cleaned table when it exists, else the raw one; return
    the frame and the source name (also usable as a literal column)."""
    reader = reader or (lambda p: spark.read.parquet(p))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cleaned_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm_path):
        return drop_index_column(reader(cleaned_path)), os.path.basename(cleaned_path.rstrip("/"))
    return drop_index_column(reader(raw_path)), os.path.basename(raw_path.rstrip("/"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Overwrite sink without an index column.  CSV gets a header."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.format(fmt).save(path)

