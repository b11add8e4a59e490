"""CSV records from splittable text, quoted newlines included.

A whole-file reader gives one task a whole file, because only the text from the
start tells whether a newline lies inside quotes.  Here the files are read as
lines of byte ranges.  A line starts either outside or inside a quoted field, so
a range is a function on these two states; one pass evaluates it for both starts,
and a prefix composition over the ranges of a file (a row per range) tells the
state in which each range starts: the last range with a fixed outcome decides,
turned round by every swapping range since.  Then each task joins lines to
records on its own; a record that crosses ranges leaves pieces, at most two a
range, which are put together by a window over pieces.

Separators of records are ``\\n`` and ``\\r\\n``; a quote inside an unquoted field
is text; a doubled quote inside a quoted field is one quote, and all other text
in quotes stays as written, line ends included.  The first record of
every file is its header; empty records are skipped; a quoted field that never
ends takes the rest of its file.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE, OPENS, GOES_ON, CLOSES, HEADER = range(5)     # records, pieces, the first piece of a header
BATCH = 5000


def inside_after(line: str, inside: bool) -> bool:
    """Whether the text behind ``line`` lies inside a quoted field, given
    whether the line starts there."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            if quote < 0:
                return True
            if line.startswith('"', quote + 1):
                at = quote + 2
                continue
            inside, at = False, quote + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str], list[bool]]]:
    """Consecutive lines of one range: (file, start), lines, line has a quote."""
    file, start = batch.column(0), batch.column(1)
    same = pc.and_(pc.equal(file[1:], file[:-1]), pc.equal(start[1:], start[:-1])).to_pylist()
    cuts = [0, *(i + 1 for i, s in enumerate(same) if not s), batch.num_rows]
    quoted = pc.match_substring(batch.column(2), '"').to_pylist()
    lines = batch.column(2).to_pylist()
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield (file[lo].as_py(), start[lo].as_py()), lines[lo:hi], quoted[lo:hi]


def range_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside): state in which every byte range starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list[bool]] = {}
        for b in batches:
            for key, values, quoted in _ranges(b):
                state = ends.setdefault(key, [False, True])
                for line, q in zip(values, quoted, strict=True):
                    if q:
                        state[0], state[1] = inside_after(line, state[0]), inside_after(line, state[1])
        yield pa.record_batch([pa.array([k[0] for k in ends], pa.string()), pa.array([k[1] for k in ends], pa.int64()),
                               pa.array([s[0] for s in ends.values()], pa.bool_()),
                               pa.array([s[1] for s in ends.values()], pa.bool_())],
                              names=["file", "start", "from_out", "from_in"])

    ends = lines.mapInArrow(run, "file string, start long, from_out boolean, from_in boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turns"))
    counted = ends.withColumn("turns", F.sum((F.col("from_out") & ~F.col("from_in")).cast("int")).over(
        Window.partitionBy("file").orderBy("start")))
    last = F.last(fixed, ignorenulls=True).over(before)
    turns = F.coalesce(F.max("turns").over(before), F.lit(0))
    state = counted.select("file", "start", F.coalesce(last["from_out"], F.lit(False)).alias("_from"),
                           (turns - F.coalesce(last["turns"], F.lit(0))).alias("_turns"), "from_out", "from_in")
    inside = F.col("_from") != (F.col("_turns") % 2 == 1)
    return state.select("file", "start", inside.alias("inside"),
                        F.when(inside, F.col("from_in")).otherwise(F.col("from_out")).alias("inside_after"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of every record behind the header of its file."""
    lines = _lines(spark, path)
    # ranges that start or end inside quotes: at most one row per byte range of the input
    crossed = range_states(lines).where("inside or inside_after").select("file", "start", "inside").collect()
    inside = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in crossed if r["inside"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, int, str]] = []
        now, open_, held, kind, fresh = None, False, [], WHOLE, False

        def left_over() -> None:
            """What a range leaves open at its end."""
            if now is not None and open_:
                out.append((*now, GOES_ON if kind == CLOSES else HEADER if fresh else OPENS, "\n".join(held)))

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int32(), pa.large_string()))], names=["file", "start", "kind", "record"])
            out.clear()
            return batch

        for b in batches:
            for key, values, quoted in _ranges(b):
                if key != now:
                    left_over()
                    now, held, open_ = key, [], key in inside.value
                    kind, fresh = (CLOSES if open_ else WHOLE), key[1] == 0
                for line, q in zip(values, quoted, strict=True):
                    held.append(line)
                    open_ = inside_after(line, open_) if q else open_
                    if not open_:
                        text = "\n".join(held)
                        if fresh:
                            fresh = False               # the header
                        else:
                            out.append((*key, kind, text))
                        held, kind = [], WHOLE
                    if len(out) >= BATCH:
                        yield flush()
        left_over()
        yield flush()

    parts = lines.mapInArrow(run, "file string, start long, kind int, record string")
    whole = parts.where(F.col("kind") == WHOLE).select("record")
    if crossed:
        # pieces in text order; a closing piece comes before what opens in its range
        pieces = parts.where(F.col("kind") != WHOLE).withColumn("late", F.col("kind").isin(OPENS, HEADER).cast("int"))
        pieces = pieces.withColumn("_record", F.sum("late").over(Window.partitionBy("file").orderBy("start", "late")))
        joined = pieces.groupBy("file", "_record").agg(F.sort_array(F.collect_list(
            F.struct("start", "late", "kind", "record"))).alias("_p")).where(F.col("_p")[0]["kind"] != HEADER)
        whole = whole.unionByName(joined.select(F.array_join(F.col("_p.record"), "\n").alias("record")))
    return whole.select(F.regexp_replace("record", "\r$", "").alias("record")).where(F.col("record") != "")


def read_csv_text(spark: SparkSession, path: str, options: Mapping[str, object]) -> DataFrame:
    """All columns as strings, from as many tasks as the files have splits."""
    names = spark.read.options(**options, inferSchema=False).csv(path).columns      # the header alone is read
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k != "header"}
    return records(spark, path).select(F.from_csv("record", schema, given).alias("_r")).select("_r.*")
