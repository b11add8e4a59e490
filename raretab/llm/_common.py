"""Helpers shared by the training-data operators.

* ``stage``: write a frame as Parquet below ``spark.checkpoint.dir`` (shared by
  driver and executors) and read it back; survives lost executors and keeps
  column pruning, unlike an RDD checkpoint.
* ``text_blocks`` / ``word_hashes``: vectorised (numpy) views of Arrow string
  columns for the operators that scan words or bytes inside tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from raretab.session import ensure_checkpoint_dir

# The ASCII white space that separates words, as a regex class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

BLOCK_BYTES = 500_000       # text bytes handled at once inside a task


def stage(df: DataFrame, tag: str, rows_per_file: int = 0) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; the files go when
    the application ends.  ``rows_per_file`` bounds a file's rows (0: no bound)."""
    return df.sparkSession.read.schema(df.schema).parquet(stage_path(df, tag, rows_per_file))


def stage_path(df: DataFrame, tag: str, rows_per_file: int = 0) -> str:
    """Folder of the files of ``stage``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    _delete_on_exit(spark, path)
    return path


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def set_aside(docs: DataFrame, scratch: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that clash with an operator's scratch names
    under free names, and free name -> own name."""
    taken = {c.lower() for c in [*docs.columns, *scratch]}
    moved = {}
    for c in docs.columns:
        if c.lower() in {x.lower() for x in scratch}:
            free = c
            while free.lower() in taken:
                free += "_"
            taken.add(free.lower())
            moved[free] = c
    return docs.withColumnsRenamed({c: free for free, c in moved.items()}), moved


def free_name(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- numpy side

def raw_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and row offsets (rows + 1), null
    rows being empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if bufs[2] is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def text_blocks(arr: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of at most ``max_bytes`` text bytes (a longer
    single row makes a block of its own): first row, end row, bytes, offsets."""
    data, off = raw_text(arr)
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), rows)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << max(10, int(n - 1).bit_length())
            self.up, self.down = (self._table(b, m) for b in (self.base, self.inv))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        t = np.full(n, base, np.uint64)
        t[0] = 1
        return np.multiply.accumulate(t)


def range_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of every slice ``values[start:end]``, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    pre = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=pre[1:])
    return mix64((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in SPACE_CHARS]] = True
    return t


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for each row the index of its
    first word (rows + 1 entries); words never cross rows."""
    solid = ~_space_table()[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        head = off[:-1][off[:-1] < off[1:]]
        tail = off[1:][off[:-1] < off[1:]] - 1
        first[head] = solid[head]
        last[tail] = solid[tail]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, powers: Powers,
                lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of every word, and row -> first word."""
    start, end, first = word_spans(data, off)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return range_hashes(data, start, end, powers), start, end, first


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (len - w + 1 of them)."""
    m, span = x, 1
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[:-rest], m[rest:]) if rest else m
