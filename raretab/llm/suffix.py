"""Suffix-array dedup: byte strings that an earlier document already has.

The sorted order of suffixes and their common prefixes is built column by
column: every segment adds one symbol per round, to the left of what it has;
the new order is the old one, stably sorted by the new symbol, and the common
prefix of neighbours grows from the least value between their old places (the
multi-document Burrows-Wheeler construction).  Neighbours with a common prefix
of ``length`` bytes start equal strings; the smallest document of such a run
keeps its copy, the others lose it.

Inserting the texts themselves would take as many rounds over the collection as
the longest text has bytes.  Only strings of ``length`` bytes matter, so the
construction runs on short segments instead:

1. Every window of ``length`` bytes picks the least hash of the ``gram``-byte
   strings in it.  Windows that pick the same place form a run; a run's bytes
   are its block.  Equal windows pick equal seeds, so all that follows happens
   within a seed.  Runs travel as packed column files, bucketed by seed.
2. In a bucket, sorted by seed and block, a run whose whole block an earlier
   document has is covered.  Seeds with differing blocks of different documents
   stay open; their blocks are the segments, aligned at the seed.
3. The column-wise construction over the segments of a bucket, read from staged
   tables, covers the open windows.

Equal blocks met in one batch leave the task once, so a seed's rows are bounded
by batches, not by documents; texts move once, keyed by row.  ``doc_id`` must be
an integer; null counts as larger than any other.  Rows are told apart by a
64-bit hash of id and text.

Edge cases: null text is empty; texts shorter than ``length`` stay whole; rows
with equal doc_id never cover each other; an empty table gives no rows; only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import Powers, mix64, range_hashes, stage, text_blocks
from raretab.llm.substring import seed_runs

GRAM = 16
BYTES = 0xD6E8FEB86659FD93
BUCKET_BYTES = 12 << 20     # text bytes whose seeds share a bucket
NO_DOC = (1 << 63) - 1


def _pack(seed: np.ndarray, block: np.ndarray, begin: np.ndarray, n: np.ndarray, row: np.ndarray,
          doc: np.ndarray, key: np.ndarray) -> bytes:
    """Column file of runs: 6 bytes of seed, all 8 of block (its equality decides
    removals), byte planes of the numbers, and the table of rows."""
    rows, at = np.unique(row, return_inverse=True)
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in (begin, at)]
    return b"".join([
        np.array([len(seed), len(rows)], "<u4").tobytes(),
        np.ascontiguousarray(seed.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes(),
        block.astype("<u8").tobytes(),
        *[np.ascontiguousarray(p).tobytes() for p in planes], n.astype(np.uint8).tobytes(),
        doc[rows].astype("<i8").tobytes(), key[rows].astype("<i8").tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    n, rows = np.frombuffer(blob, "<u4", 2)
    at, out = 8, []
    x = np.zeros((n, 8), np.uint8)
    x[:, 2:] = np.frombuffer(blob, np.uint8, n * 6, at).reshape(n, 6)
    at += int(n) * 6
    out += [x.view("<u8").ravel(), np.frombuffer(blob[at:at + int(n) * 8], "<u8")]
    at += int(n) * 8
    for _ in range(2):
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * 4, at).reshape(4, n).T).view("<u4").ravel())
        at += int(n) * 4
    size = np.frombuffer(blob, np.uint8, n, at)
    at += int(n)
    doc = np.frombuffer(blob, "<i8", rows, at)
    key = np.frombuffer(blob, "<i8", rows, at + int(rows) * 8)
    seed, block, begin, row = out
    return seed, block, begin.astype(np.int32), size, doc[row], key[row]


def _emit(length: int, gram: int, buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BYTES)
        for batch in batches:
            docs, keys = batch.column("doc").to_numpy(), batch.column("row_key").to_numpy()
            for lo, _, data, off in text_blocks(batch.column("text")):
                seed, block, row, begin, n = seed_runs(data.astype(np.uint64) + np.uint64(1), off, length, gram, powers)
                if not len(seed):
                    continue
                doc, key = docs[lo + row], keys[lo + row]
                # of equal blocks only the smallest document's go on
                order = np.lexsort((doc, block))
                b, d = block[order], doc[order]
                head = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                least = np.repeat(d[head], np.diff(np.append(head, len(b))))
                gone = np.zeros(len(doc), bool)
                gone[order] = d > least
                stay = np.flatnonzero(~gone)
                spread = mix64(seed[stay])
                bucket = (spread >> np.uint64(20)) % np.uint64(buckets)
                turn = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.concatenate([[True], bucket[turn][1:] != bucket[turn][:-1]]))
                names, blobs = bucket[turn][cut].astype(np.int32), []
                for part in np.split(turn, cut[1:]):
                    i = stay[part]
                    blobs.append(_pack(spread[part], block[i], begin[i], n[i], lo + row[i], docs, keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(blobs, pa.binary()), pa.nulls(len(names), pa.int64()),
                     pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.int32())],
                    ["bucket", "runs", "row_key", "begin", "n"])
                i = np.flatnonzero(gone)
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((key[i] % buckets).astype(np.int32)), pa.nulls(len(i), pa.binary()), pa.array(key[i]),
                         pa.array(begin[i].astype(np.int32)), pa.array(n[i].astype(np.int32))],
                        ["bucket", "runs", "row_key", "begin", "n"])
    return emit


_SETTLED = "seed long, row_key long, doc long, begin int, n int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: covered runs (seed null) and open runs."""

    def rows(seed, key, doc, begin, n) -> pa.RecordBatch:
        k = len(key)
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()) if seed is None else pa.array(seed.view(np.int64)), pa.array(key),
             pa.nulls(k, pa.int64()) if doc is None else pa.array(doc), pa.array(begin), pa.array(n.astype(np.int32))],
            ["seed", "row_key", "doc", "begin", "n"])

    def close(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        seed, block, begin, n, doc, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, block, seed))
        seed, block, begin, n, doc, key = (x[order] for x in (seed, block, begin, n, doc, key))
        new_seed = np.concatenate([[True], seed[1:] != seed[:-1]])
        head = np.flatnonzero(new_seed | np.concatenate([[True], block[1:] != block[:-1]]))
        least = np.repeat(doc[head], np.diff(np.append(head, len(seed))))
        gone = doc > least
        yield rows(None, key[gone], None, begin[gone], n[gone])
        group = np.cumsum(new_seed)[~gone]
        seed, begin, n, doc, key = (x[~gone] for x in (seed, begin, n, doc, key))
        if len(group):
            head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            size = np.diff(np.append(head, len(group)))
            open_ = np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), size)
            yield rows(seed[open_], key[open_], doc[open_], begin[open_], n[open_])

    now, parts = None, []
    for batch in batches:
        names = batch.column("bucket").to_numpy()
        blobs = batch.column("runs")
        told = np.asarray(blobs.is_null())
        if told.any():
            mask = pa.array(told)
            yield rows(None, *(batch.column(c).filter(mask).to_numpy() if c else None
                               for c in ("row_key", None, "begin", "n")))
        for i in np.flatnonzero(~told):
            if names[i] != now and parts:
                yield from close(parts)
                parts = []
            now = names[i]
            parts.append(_unpack(blobs[int(i)].as_py()))
    if parts:
        yield from close(parts)


def _segments(length: int, gram: int):
    """Blocks of open runs with the place of the seed in them."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(BYTES)
        for batch in batches:
            keys, docs, lists = batch.column("row_key").to_numpy(), batch.column("doc").to_numpy(), batch.column("runs")
            for lo, hi, data, off in text_blocks(batch.column("text")):
                mine = lists[lo:hi]
                run = mine.flatten()
                row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy(zero_copy_only=False))
                begin, n, seed = (run.field(k).to_numpy() for k in ("begin", "n", "seed"))
                at = off[row] + begin
                place = np.arange(len(data) - gram + 1)
                grams = range_hashes(data.astype(np.uint64) + np.uint64(1), place, place + gram, powers)
                where = grams[at[:, None] + np.arange(length - gram + 1)].argmin(axis=1) if len(at) else at
                raw = data.tobytes()
                blocks = [raw[a:b] for a, b in zip(at.tolist(), (at + n + length - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed), pa.array(keys[lo + row]), pa.array(docs[lo + row]), pa.array(begin),
                     pa.array(where.astype(np.int32)), pa.array(blocks, pa.binary())],
                    ["seed", "row_key", "doc", "begin", "place", "block"])
    return segments


def equal_windows(group: np.ndarray, doc: np.ndarray, place: np.ndarray, blocks: list[bytes], length: int,
                  gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Column-wise construction over segments aligned at their seeds.  Yields
    for each column (segments, offset of the string in its block) of strings
    that a smaller document of the group has too."""
    reach = length - gram                       # columns left of the seed
    width = reach + length
    m = np.zeros((len(blocks), width), np.uint16)
    size = np.fromiter(map(len, blocks), np.int64, len(blocks))
    which = np.repeat(np.arange(len(blocks)), size)
    column = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(reach - place, size)
    m[which, column] = np.frombuffer(b"".join(blocks), np.uint8).astype(np.uint16) + 1
    order = np.argsort(group, kind="stable")
    common = np.zeros(len(blocks), np.int64)    # with the neighbour before
    for c in range(width - 1, -1, -1):
        symbol = m[order, c]
        turn = np.lexsort((symbol, group[order]))               # stable: keeps the old order
        before, symbol = turn[:-1], symbol[turn]
        order = order[turn]
        g = group[order]
        same = np.flatnonzero((g[1:] == g[:-1]) & (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0))
        grown = np.zeros(len(order), np.int64)
        if len(same):
            # least common prefix between the old places of the two
            span = np.empty(2 * len(same), np.int64)
            span[::2], span[1::2] = before[same] + 1, turn[same + 1] + 1
            grown[same + 1] = 1 + np.minimum.reduceat(np.append(common, 0), span)[::2]
        common = np.minimum(grown, length)
        if c <= reach:
            head = np.flatnonzero(common < length)
            if len(head) < len(order):
                d = doc[order]
                least = np.repeat(np.minimum.reduceat(d, head), np.diff(np.append(head, len(order))))
                hit = order[d > least]
                if len(hit):
                    yield hit, c - reach + place[hit]


def _compare(length: int, gram: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: pa.Table) -> Iterator[pa.RecordBatch]:
            seed, key, doc, begin, place = (held.column(k).to_numpy() for k in ("seed", "row_key", "doc", "begin", "place"))
            group = np.unique(seed, return_inverse=True)[1]
            for hit, at in equal_windows(group, doc, place, held.column("block").to_pylist(), length, gram):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[hit]), pa.array((begin[hit] + at).astype(np.int32)),
                     pa.array(np.ones(len(hit), np.int32))], ["row_key", "begin", "n"])

        held, rows = [], 0
        for batch in batches:                                   # sorted by seed
            seeds = batch.column("seed").to_numpy()
            cut = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
            if rows + batch.num_rows >= 40_000 and len(cut):
                held.append(batch.slice(0, cut[-1]))
                yield from close(pa.Table.from_batches(held).combine_chunks())
                held, rows = [batch.slice(cut[-1])], batch.num_rows - int(cut[-1])
            else:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield from close(pa.Table.from_batches(held).combine_chunks())
    return compare


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, size, removed, count, kept = batch.column("spans"), [], [], [], []
            for lo, hi, data, off in text_blocks(batch.column("text")):
                mine = spans[lo:hi].fill_null([])
                run = mine.flatten()
                row = np.repeat(np.arange(hi - lo), mine.value_lengths().to_numpy(zero_copy_only=False))
                change = np.zeros(len(data) + 1, np.int64)
                at = off[row] + run.field("begin").to_numpy()
                np.add.at(change, at, 1)
                np.add.at(change, at + run.field("n").to_numpy() + length - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                first[off[:-1][off[:-1] < off[1:]]] |= gone[off[:-1][off[:-1] < off[1:]]]
                total, starts = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, first))
                raw, rest = data.tobytes(), data[~gone].tobytes()
                left = off - total[off]
                size += np.diff(off).tolist()
                removed += np.diff(total[off]).tolist()
                count += np.diff(starts[off]).tolist()
                for a, b, x, y in zip(off[:-1], off[1:], left[:-1], left[1:], strict=True):
                    kept.append(raw[a:b] if b - a == y - x else rest[x:y])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(count, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    return remove


def remove_seen(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = 50,
                gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the
    remaining bytes)."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))).withColumn(
        "row_key", F.xxhash64("doc_id", "text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_bytes))
    packed = texts.select("row_key", "doc", "text").mapInArrow(
        _emit(length, gram, buckets), "bucket int, runs binary, row_key long, begin int, n int")
    settled = stage(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
                    .mapInArrow(_settle, _SETTLED), "suffix-runs")

    open_runs = (settled.where(F.col("seed").isNotNull()).groupBy("row_key")
                 .agg(F.collect_set(F.struct("begin", "n", "seed")).alias("runs")))
    segments = (texts.join(open_runs, "row_key").dropDuplicates(["row_key"]).select("row_key", "doc", "text", "runs")
                .mapInArrow(_segments(length, gram), "seed long, row_key long, doc long, begin int, place int, block binary"))
    windows = stage(stage(segments, "suffix-segments").repartition("seed").sortWithinPartitions("seed")
                    .mapInArrow(_compare(length, gram), "row_key long, begin int, n int"), "suffix-windows")

    covered = settled.where(F.col("seed").isNull()).select("row_key", "begin", "n").union(windows)
    spans = covered.groupBy("row_key").agg(F.collect_set(F.struct("begin", "n")).alias("spans"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return (texts.join(spans, "row_key", "left").select("doc_id", "text", "spans")
            .mapInArrow(_remove(length), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary"))
