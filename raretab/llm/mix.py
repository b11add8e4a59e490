"""Mixing sources to target weights by a low-discrepancy schedule.

Sources (code point order, null last) get weights by repeating a weight list;
targets share the whole corpus size in proportion to the weights, stop at
``max_repeat`` times a source's own size, and the excess goes to the others by
weight (exact water filling over the small table of sources).

Each source's documents are put in a seeded hash order and read as an endless
stream of words, cut into blocks of equal size.  Slot ``i`` of the schedule has
the golden-ratio point ``frac(i * phi)``; cumulative target weights map it to a
source, slots are ranked per source, and slot rank r takes block r of its
source.  Blocks that the schedule does not reach follow at its end, so every
source yields its rounded target exactly.

Everything is DataFrame functions.  Running sums go over (source, hash bucket)
and (source, slot chunk) so that a hot source is spread over many tasks; only
per-source and per-bucket totals are windowed by source.

Edge cases: null or blank text has size 0 and is never taken; a null source is
a source of its own; repeated rows are separate rows; an empty table gives no
rows; extra input columns are not touched (only the named ones are read).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raretab.llm._common import SPACE, SPACE_CHARS, stage

# Source weights of the contract; 2**32 / golden ratio.
WEIGHTS = (5, 2, 1)
GOLDEN = 2654435769
TWO32 = 1 << 32

BLOCK_WORDS = 32            # words of a slot: small corpora have thousands of slots too
ROWS_PER_BUCKET = 20_000
SLOTS_PER_CHUNK = 8_192
CELLS = 4_096


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


@dataclass
class Mix:
    """``documents``: one row per input row with its place in its source's
    stream; ``sources``: targets; ``pieces``: what each slot takes (``at``: the
    piece's first word in its source's stream)."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """(source, source_size) -> rank, weight, target; one row per source."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    t = (totals.withColumn("_k", rank).withColumn("weight", w)
         .withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
         .withColumn("_total", F.sum("source_size").over(everything).cast("double")))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("weight"), "_k")
    capped = F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cap")
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    t = t.withColumn("_level", (F.col("_total") - capped) / left)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_cap") / F.col("weight"))
    level = F.min_by("_level", fits).over(everything)
    t = t.withColumn("target", F.least(F.col("_cap"), level * F.col("weight")))
    by_rank = everything.orderBy("_k")
    upto = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_hi", F.sum("target").over(upto) / F.sum("target").over(everything))
    return t.select("source", "source_size", "_k", "weight", "target",
                    F.coalesce(F.lag("_hi").over(by_rank), F.lit(0.0)).alias("_lo"), "_hi",
                    F.least(F.round("target").cast("long"), F.col("source_size") * max_repeat).alias("_want"))


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots 0..n_slots-1 -> source rank ``_k`` and rank of the slot in it."""
    spark = sources.sparkSession
    live = sources.where(F.col("target") > 0)
    last = F.floor(F.least(F.col("_hi"), F.lit(1.0)) * CELLS).cast("int")
    cells = live.select("_k", "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS).cast("int"), last)).alias("_cell"))
    slots = (spark.range(n_slots).withColumnRenamed("id", "slot")
             .withColumn("_point", F.pmod(F.pmod(F.col("slot"), F.lit(1 << 31)) * GOLDEN, F.lit(TWO32)) / float(TWO32))
             .withColumn("_cell", F.floor(F.col("_point") * CELLS).cast("int")))
    placed = (slots.join(cells, "_cell").where((F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi")))
              .select("slot", "_k", F.expr(f"slot div {SLOTS_PER_CHUNK}").alias("_chunk")))
    before = Window.partitionBy("_k").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = (placed.groupBy("_k", "_chunk").agg(F.count("*").alias("_n"))
            .select("_k", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    rank = F.row_number().over(Window.partitionBy("_k", "_chunk").orderBy("slot")) - 1
    return placed.join(base, ["_k", "_chunk"]).select("slot", "_k", (F.col("_base") + rank).alias("block"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_repeat: int = 3, block_words: int = BLOCK_WORDS,
        seed: int = 17) -> Mix:
    """Blocks have ``block_words`` words at every size of the corpus."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("_row"))
    words = stage(words.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size")), "mix-sizes")
    per_source = words.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    rows, total = per_source.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    buckets = max(128, -(-rows // ROWS_PER_BUCKET))
    sources = stage(source_targets(per_source.drop("_rows"), weights, max_repeat), "mix-sources")

    placed = (words.join(sources.select("source", "source_size", "_k", "target", "_want"),
                         words["source"].eqNullSafe(sources["source"])).drop(sources["source"])
              .withColumn("_bucket", F.pmod(F.xxhash64("_h"), F.lit(buckets))))
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (placed.groupBy("_k", "_bucket").agg(F.sum("size").alias("_n"))
            .select("_k", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = (Window.partitionBy("_k", "_bucket").orderBy("_h", "doc_id", "_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (placed.join(base, ["_k", "_bucket"])
              .withColumn("_start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .drop("_base", "_bucket"))
    placed = stage(placed, "mix-places")

    n_slots = -(-total // block_words)
    runs = (placed.where(F.col("size") > 0)
            .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
            .withColumn("_a", F.col("epoch") * F.col("source_size") + F.col("_start"))
            .withColumn("_b", F.least(F.col("_a") + F.col("size"), F.col("_want")))
            .where(F.col("_b") > F.col("_a"))
            .withColumn("block", F.explode(F.sequence(F.expr(f"_a div {block_words}"), F.expr(f"(_b - 1) div {block_words}")))))
    lo = F.greatest(F.col("_a"), F.col("block") * block_words)
    runs = runs.select("_row", "doc_id", "_k", "epoch", "block", lo.alias("at"), (lo - F.col("_a")).alias("start"),
                       (F.least(F.col("_b"), (F.col("block") + 1) * block_words) - lo).alias("length"))
    pieces = (runs.join(schedule(sources, n_slots), ["_k", "block"], "left")
              .withColumn("position", F.coalesce("slot", F.lit(n_slots) + F.col("block"))))
    return Mix(placed, sources, pieces)


def taken_words(m: Mix) -> DataFrame:
    """One row per input row: size, its source's size and target, words taken
    (repeats counted), and its first position in the mix (null: not taken)."""
    took = m.pieces.groupBy("_row").agg(F.sum("length").alias("taken"), F.min("position").alias("first_position"))
    return (m.documents.join(took, "_row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
                    "first_position"))


def mixed_documents(docs: DataFrame, max_repeat: int = 3, seed: int = 17, **columns: str) -> DataFrame:
    """Whole documents in the order of the mix: a copy is taken when its first
    word is (so a source is off by less than one document) and stands where the
    slot that takes this word stands; rows without words are kept once, after
    all others.  Returns the columns of ``docs``, globally sorted; rows are
    matched by doc_id, source and size, and those that agree in all three (their
    hash is the same) by their order of text hashes."""
    key, text, source = (columns.get(c, c) for c in ("doc_id", "text", "source"))
    m = mix(docs, max_repeat=max_repeat, seed=seed, **columns)
    places = (m.pieces.where(F.col("start") == 0).groupBy("_row")
              .agg(F.collect_list(F.struct("position", "_k", "at")).alias("_places")))
    same_row = ["_key", "_null", "_source", "_no_source", "_size"]

    def keyed(df: DataFrame, size: Column, key: str, source: str) -> DataFrame:
        return df.select("*", *[x for c, name, null in ((key, "_key", "_null"), (source, "_source", "_no_source"))
                                for x in (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name),
                                          F.col(c).isNull().alias(null))], size.alias("_size"))

    # texts are exchanged once to meet their places, and once for the order of the mix: rows and
    # streams go by the same keys, are numbered there and paired by number
    streams = keyed(m.documents.where(F.col("size") > 0), F.col("size"), "doc_id", "source").join(places, "_row", "left")
    blank = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CHARS)) == ""
    rows = keyed(docs.where(~blank), word_count(F.col(text)), key, source)
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    both = rows.select(*same_row, F.xxhash64(text).alias("_order"), whole.alias("_whole"), F.lit(None).cast(
        places.schema["_places"].dataType).alias("_places")).unionByName(
        streams.select(*same_row, F.col("_row").alias("_order"), F.lit(None).cast(
            rows.select(whole.alias("_whole")).schema["_whole"].dataType).alias("_whole"), "_places"))
    both = both.withColumn("_text", F.col("_whole").isNotNull()).repartition(*same_row)
    nth = F.row_number().over(Window.partitionBy(*same_row, "_text").orderBy("_order"))
    pair = Window.partitionBy(*same_row, "_nth").orderBy("_text")
    dealt = (both.withColumn("_nth", nth).withColumn("_dealt", F.lag("_places").over(pair))
             .where("_text").withColumn("_place", F.explode("_dealt"))
             .orderBy("_place.position", "_place._k", "_place.at").select("_whole.*"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return dealt.union(docs.where(blank).select(*names))
