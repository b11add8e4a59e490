"""Projections and derived features.

All are narrow ``select``/``withColumns`` projections inside whole-stage
codegen; no UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drop_present(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist (``drop`` ignores absent names)."""
    return df.drop(*names)


def split_target(df: DataFrame, target: str) -> tuple[list[str], DataFrame]:
    """Feature names and the frame with the target cast to int (one frame)."""
    feats = [c for c in df.columns if c != target]
    return feats, df.withColumn(target, F.col(target).cast("int"))


def cleaning_interactions(df: DataFrame) -> DataFrame:
    """Interaction columns of the cleaned table."""
    a, h, hd, g = (F.col("age"), F.col("has_hypertension"), F.col("has_heart_disease"),
                   F.col("glucose_level"))
    return df.withColumns({
        "age_squared": a * a,
        "age_x_hypertension": a * h,
        "age_x_heart": a * hd,
        "glucose_x_hypertension": g * h,
        "age_risk_score": a * (h + hd),
    })


# The senior flag cut and the extra model-feature names.
SENIOR_AGE = 55
MODEL_FEATURES = ("age_x_hypertension", "age_x_heart_disease", "glucose_x_bmi",
                  "age_squared", "cvd_count", "is_senior", "log_glucose")


def model_features(df: DataFrame) -> DataFrame:
    """P5: derived model features.  ``glucose_x_bmi`` is 0 when bmi is null."""
    a, h, hd, g, b = (F.col("age"), F.col("has_hypertension"), F.col("has_heart_disease"),
                      F.col("glucose_level"), F.col("bmi_value"))
    return df.withColumns({
        "age_x_hypertension": a * h,
        "age_x_heart_disease": a * hd,
        "glucose_x_bmi": F.coalesce(g * b, F.lit(0.0)),
        "age_squared": a * a,
        "cvd_count": h + hd,
        "is_senior": (a >= SENIOR_AGE).cast("int"),
        "log_glucose": F.ln(g + F.lit(1.0)),
    })


def extra_features(df: DataFrame, bmi_median: Column) -> DataFrame:
    """Features named only in the documentation; our definitions."""
    a, g, b = F.col("age"), F.col("glucose_level"), F.col("bmi_value")
    return df.withColumns({
        "age_over_10": a / 10,
        "glucose_per_bmi": g / F.nullif(b, F.lit(0.0)),
        "bmi_deviation": b - bmi_median,
    })


def fill_zero(df: DataFrame) -> DataFrame:
    """Every null to 0, strings to the text '0' (as a CSV round trip would)."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    txt = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    out = df
    if num:
        out = out.na.fill(0, subset=num)
    if txt:
        out = out.na.fill("0", subset=txt)
    return out


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns of numeric type, in table order."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


# The documented high-risk profile (age, hypertension,
# glucose, heart disease; flagged when at least 3 of 4 hold).
PROFILE_AGE = 60
PROFILE_GLUCOSE = 140
PROFILE_MIN_CRITERIA = 3


def high_risk_profile(df: DataFrame) -> DataFrame:
    """Criteria count and flag."""
    n = ((F.col("age") > PROFILE_AGE).cast("int") + (F.col("has_hypertension") == 1).cast("int")
         + (F.col("glucose_level") > PROFILE_GLUCOSE).cast("int")
         + (F.col("has_heart_disease") == 1).cast("int"))
    return df.withColumns({"risk_criteria": n,
                           "high_risk": (n >= PROFILE_MIN_CRITERIA).cast("int")})
