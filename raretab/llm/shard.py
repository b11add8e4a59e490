"""Sharding by a two-pass external shuffle.

Pass one writes the records with a seeded hash of key, text and row number and
scatters them uniformly into memory-sized buckets by it (one exchange of the
records).  Pass two shuffles each bucket in
memory (Spark's ``shuffle`` of an array is a seeded Fisher-Yates) and lays the
buckets end to end; the global position decides shard and slot, so shard sizes
differ by at most one row and a shard's file is written from a few buckets
without another exchange.

The bucket count follows the corpus bytes, so a bucket stays within
``bucket_bytes`` (a longer single record makes its bucket larger).

Edge cases: null text counts 16 bytes; rows that agree in key and text, null
keys among them, spread over all buckets by their number; an empty table gives
no rows; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raretab.llm._common import stage

RECORD_OVERHEAD = 16        # fixed value: bytes a record takes besides its text


def record_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_OVERHEAD).cast("long")


def text_checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 23, key: str = "doc_id", text: str = "text",
          bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (gapless from 0)."""
    # the row's number tells equal rows apart; written once with the record, it cannot change between the passes
    scatter = F.xxhash64(F.lit(seed), F.col(key), text_checksum(F.col(text)), F.monotonically_increasing_id())
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")])
    sizes = stage(docs.select(scatter.alias("_h"), record_size(F.col(text)).alias("_bytes"), record.alias("_record")),
                  "shard-rows")
    rows, size = sizes.agg(F.count("*"), F.coalesce(F.sum("_bytes"), F.lit(0))).first()
    n_buckets = max(1, -(-size // bucket_bytes))
    bucket = F.pmod(F.col("_h"), F.lit(n_buckets))
    counts = sizes.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_bucket", (F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_bucket")) - F.col("_n")).alias("_offset"))

    scattered = (sizes.select("_h", bucket.alias("_bucket"), "_record")
                 .repartition(n_buckets, "_bucket").sortWithinPartitions("_bucket", "_h"))
    shuffled = (scattered.groupBy("_bucket").agg(F.collect_list("_record").alias("_records"))
                .join(offsets, "_bucket")
                .select("_offset", F.posexplode(F.shuffle("_records", seed)).alias("_pos", "_record")))
    place = F.col("_offset") + F.col("_pos")
    n = max(rows, 1)
    return (shuffled.withColumn("_place", place)
            .withColumn("_shard", F.expr(f"_place * {n_shards} div {n}"))
            .select("_record.*", F.col("_shard").cast("int").alias("shard"),
                    (F.col("_place") - F.expr(f"(_shard * {n} + {n_shards - 1}) div {n_shards}")).alias("slot")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows with their slot."""
    sharded.write.partitionBy("shard").parquet(path)
