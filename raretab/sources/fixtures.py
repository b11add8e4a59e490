"""Fixture views derived from the driver tables.

Every fixture is a deterministic function of the driver's parquet tables, so
its size grows with the scale factor.  The same definitions exist as DuckDB
SQL in ``fixture_sql`` for the oracles; the two must stay in step.

patients       orders joined with customer, mapped to the 17-variable schema
patients_raw   patients plus 18 exact copies of every positive row (the
               duplicate fault sits only in the positive class)
scored         three formula scores per patient with ties (no model needed)
embed_binary   embeddings with a binary label: label 0 is the minority
doc_fields     documents without their id (near-copies for dedup)
doc_labels     labels joined with documents
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hash_uniform
from .io import read_table

# Column roles of the patient schema.
ID_COL = "patient_id"
TARGET = "stroke_event"
CATEGORICAL = ("gender", "employment_type", "residence", "smoking_habit")
NUMERIC_TESTED = ("age", "glucose_level", "bmi_value")
CATEGORICAL_TESTED = ("gender", "smoking_habit", "employment_type", "residence",
                      "has_hypertension", "has_heart_disease")
# Columns excluded before modelling (identifier, redundant or leaking).
MODEL_DROP = ("patient_id", "age_group", "bmi_category", "high_glucose",
              "risk_score", "lifestyle_risk")

# Copies per positive row in patients_raw and the id stride between copies.
RAW_COPIES = 18
COPY_ID_STRIDE = 1_000_000_000_000

PATIENT_COLUMNS = (
    "patient_id", "gender", "age", "age_group", "has_hypertension",
    "has_heart_disease", "marital_status", "employment_type", "residence",
    "glucose_level", "high_glucose", "bmi_value", "bmi_category",
    "smoking_habit", "risk_score", "stroke_event",
)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # No hint: customer grows with the data; Spark/AQE broadcast it only
    # when its measured size is under the threshold, else sort-merge.
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")

    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    age = (F.lit(1) + (key * 37 + cust * 11) % 82).cast("double")
    htn = F.col("o_orderpriority").like("1%").cast("int")
    heart = ((F.col("o_orderstatus") == "F") & (cust % 5 == 0)).cast("int")
    seg = F.col("c_mktsegment")
    employment = (F.when(seg.isin("BUILDING", "MACHINERY"), "working")
                  .when(seg == "HOUSEHOLD", "government").otherwise("other"))
    glucose = F.lit(55.0) + F.col("o_totalprice") % 217
    bmi = F.when(key % 25 == 7, F.lit(None).cast("double")).otherwise(
        F.lit(15.0) + (F.col("o_totalprice") % 3000) / 100)
    smoke_k = (key * 7 + cust) % 4
    smoking = (F.when(smoke_k == 0, "never").when(smoke_k == 1, "formerly")
               .when(smoke_k == 2, "smokes").otherwise("unknown"))
    u = hash_uniform(key, 42)

    base = j.select(
        key.alias("patient_id"),
        F.when(cust % 2 == 0, "M").otherwise("F").alias("gender"),
        age.alias("age"),
        htn.alias("has_hypertension"),
        heart.alias("has_heart_disease"),
        F.when(cust % 3 == 0, 0).otherwise(1).alias("marital_status"),
        employment.alias("employment_type"),
        F.when(F.col("c_nationkey") % 2 == 0, "Urban").otherwise("Rural").alias("residence"),
        glucose.alias("glucose_level"),
        bmi.alias("bmi_value"),
        smoking.alias("smoking_habit"),
        u.alias("_u"),
    )
    a = F.col("age")
    risk = (F.lit(0.09) * (a / 82) * (a / 82)
            * (F.lit(1) + F.col("has_hypertension") + F.col("has_heart_disease")))
    b = F.col("bmi_value")
    out = base.select(
        "*",
        F.when(a < 40, "young").when(a < 60, "middle").otherwise("senior").alias("age_group"),
        (F.col("glucose_level") >= 140).cast("int").alias("high_glucose"),
        F.when(b < 18.5, "under").when(b < 25, "normal").when(b < 30, "over")
         .when(b.isNotNull(), "obese").alias("bmi_category"),
        (F.col("has_hypertension") + F.col("has_heart_disease")).alias("risk_score"),
        (F.col("_u") < risk).cast("int").alias("stroke_event"),
    )
    return out.select(*PATIENT_COLUMNS)


def patients_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    copies = (p.where(F.col(TARGET) == 1)
              .withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(RAW_COPIES))))
              .withColumn(ID_COL, F.col(ID_COL) + F.col("_r") * F.lit(COPY_ID_STRIDE))
              .drop("_r"))
    return p.unionByName(copies)


# Formula-score models and their hash salts.
SCORE_MODELS = (("a", 43), ("b", 44), ("c", 45))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (model, row_id, y, p): three formula scores with ties."""
    p = patients(spark, sf_dir).select(
        F.col("patient_id").alias("row_id"), F.col("stroke_event").alias("y"),
        "age", "has_hypertension", "has_heart_disease")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("salt"))
                       for m, s in SCORE_MODELS])
    x = p.select("*", F.explode(models).alias("_m"))
    u2 = F.conv(F.substring(F.md5(F.concat(F.col("_m.salt").cast("string"), F.lit("|"),
                                           F.col("row_id").cast("string"))), 1, 8),
                16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)
    raw = (F.lit(0.5) * (F.col("age") / 82) + F.lit(0.3) * u2
           + F.lit(0.1) * F.col("has_hypertension") + F.lit(0.1) * F.col("has_heart_disease"))
    score = F.floor(F.lit(1000) * raw).cast("double") / 1000
    return x.select(F.col("_m.model").alias("model"), "row_id", "y", score.alias("p"))


def embed_binary(spark: SparkSession, sf_dir: str, minority_label: int = 0) -> DataFrame:
    """(vec_id, features array<double>, y): y=1 for ``minority_label``."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == minority_label).cast("int").alias("y"),
    )


def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels ⋈ documents (inner), with the document length and language."""
    lab = read_table(spark, sf_dir, "labels")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return lab.join(docs, "doc_id", "inner")
