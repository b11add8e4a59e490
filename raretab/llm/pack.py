"""Packing by order-preserving dynamic programming.

Documents keep their stored order: every input partition is a stream of tokens,
each document followed by its end token.  Cuts may fall at document ends (free),
sentence ends, and, inside long sentences, at every 16th token; a cut inside a
document costs a truncation penalty.  The cheapest way to cut the stream into
windows of at most ``length`` tokens minimises padding plus penalties:

    f(j) = min over i in reach of f(i) + (length - (p(j) - p(i))) + penalty(j)

``f(i) + p(i)`` is kept in a monotone queue over the sliding reach, so each cut
is pushed and popped once.  Streams are cut in stretches of bounded size; the
last open window of a stretch is carried into the next, so only a partition's
last window is left short.  No shuffle; memory is one stretch.

Windows of a power-of-two length need no padding; the programme counts the
padding of all short windows alike, so it leaves only what both readings allow.

Edge cases: null text is empty and gives its end token alone; an empty table
gives no rows; texts longer than a window are cut as often as needed; repeated
rows are packed as often as they occur; only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
END = 1                     # id after each document
SENTENCE_COST, INSIDE_COST = 4, 12
GRID = 16                   # tokens between cuts inside a long sentence
STRETCH = 400_000           # tokens cut at once

# The pattern that splits text before the merges of this vocabulary (fixed
# value, part of the vocabulary's format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(tokenizer_path: str, ranks_path: str | None) -> tuple[Callable[[str], np.ndarray], np.ndarray]:
    """text -> ids, and for each id whether it ends a sentence.

    With the rank file of the same vocabulary, texts of code points below
    U+0250 are encoded from the ranks (several times faster, same ids); other
    texts, whose letter classes depend on the Unicode version, always go
    through the tokenizer file."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    slow.encode_special_tokens = True       # their strings in a text are ordinary text
    ends = np.zeros(slow.get_vocab_size() + 1, bool)
    for token, i in slow.get_vocab().items():
        ends[i] = bool(re.search("[.!?Ċ]$", token))     # U+010A stands for the newline byte
    ends[END] = False

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks_path is None:
        return by_file, ends
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    other = re.compile("[^\0-ɏ]")

    def encode(text: str) -> np.ndarray:
        if other.search(text):
            return by_file(text)
        return np.asarray(fast.encode_to_numpy(text), np.uint32)

    return encode, ends


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut (after that many tokens) and the
    cost of each; gaps are at most ``GRID``."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    at = np.flatnonzero(ends[ids]) + 1
    cost[at] = SENTENCE_COST
    cost[doc_ends] = 0
    known = np.flatnonzero(cost >= 0)
    before = np.concatenate([[0], known])
    gap = np.diff(np.append(before, len(ids)))
    extra = (gap - 1) // GRID
    base = np.repeat(before, np.maximum(extra, 0))
    if len(base):
        step = np.arange(len(base)) - np.repeat(np.cumsum(np.maximum(extra, 0)) - np.maximum(extra, 0), np.maximum(extra, 0)) + 1
        cost[base + step * GRID] = INSIDE_COST
    if cost[-1] < 0:
        cost[-1] = 0
    pos = np.flatnonzero(cost >= 0)
    pos = pos[pos > 0]
    return pos, cost[pos]


def best_cuts(pos: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Chosen cut positions, increasing, the last being ``pos[-1]``."""
    p, c = [0, *pos.tolist()], [0, *cost.tolist()]
    came = [0] * len(p)
    queue: deque[tuple[int, int]] = deque([(0, 0)])     # (f(i) + p(i), i), values increasing
    for j in range(1, len(p)):
        low = p[j] - length
        while p[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        came[j] = i
        # f(j) + p(j) = value + length - p(j) + c(j) + p(j)
        mine = value + length + c[j]
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, j))
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = came[j]
    return cuts[::-1]


class _Stream:
    """Tokens and documents of a partition that are not packed yet."""

    def __init__(self, ends: np.ndarray, length: int, first_sequence: int) -> None:
        self.ends, self.length, self.sequence = ends, length, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[object, int, int]] = []       # doc_id, tokens already packed, all tokens
        self.size = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids)))
        self.size += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Rows of all windows but the open one (of all, when ``last``)."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        doc_ends = np.cumsum([n - done for _, done, n in self.docs])
        cuts = best_cuts(*cut_points(ids, doc_ends, self.ends), self.length)
        if not last:
            cuts = cuts[:-1]
        rows, begin, d = [], 0, 0
        start_of = doc_ends - np.array([n - done for _, done, n in self.docs])
        for end in cuts:
            at = begin
            while at < end:
                doc_id, done, total = self.docs[d]
                stop = min(end, int(doc_ends[d]))
                start = done + at - int(start_of[d])
                rows.append((doc_id, start, stop - at, total, self.sequence, at - begin,
                             ids[at:stop].astype("<u4").tobytes()))
                at = stop
                if at == doc_ends[d]:
                    d += 1
            self.sequence += 1
            begin = end
        left = [(doc_id, done + max(0, begin - int(start_of[k + d])), n)
                for k, (doc_id, done, n) in enumerate(self.docs[d:])]
        self.docs, self.ids, self.size = left, [ids[begin:]], len(ids) - begin
        return rows


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, text: str = "text",
         doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, doc_tokens,
    sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_field = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, ends = encoder(tokenizer_path, ranks_path)
        stream = _Stream(ends, length, TaskContext.get().partitionId() << 36)
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(t.as_py() or "")
                stream.add(key, np.append(ids, np.uint32(END)))
                if stream.size >= STRETCH:
                    yield _batch(stream.cut(last=False), kind)
        if kind is not None:
            yield _batch(stream.cut(last=True), kind)

    return source.mapInArrow(run, f"doc_id {id_field.simpleString()}, start long, length long, doc_tokens long, "
                             "sequence_id long, offset long, ids binary")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

