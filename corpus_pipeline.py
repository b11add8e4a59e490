"""Corpus pipeline: language ID, near duplicates, personal data, source mix,
packing, each by its operator in ``raretab.llm``.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame that is written as Parquet and read again for the next; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretab.llm import jaccard, langid, mix, pack, pii
from raretab.llm._common import read_table, stage
from raretab.llm.queries import tokenizer_files

MIN_SCORE = 0.5             # posterior of the predicted language


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those of no clear language."""
    model = langid.fit(docs)
    return (langid.predict(docs, model, label_out="_pred", score_out="_score")
            .where((F.col("_pred") != langid.UNKNOWN) & (F.col("_score") >= MIN_SCORE))
            .select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard 0.8."""
    return jaccard.keep_one(docs, n=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pattern spans and revealing terms become their kind's name."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, repeated as often as it takes them, in the order
    of its schedule."""
    return mix.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack.pack(docs, *tokenizer_files())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
