"""N-gram Jaccard join: size-aware, light sets by subsets, heavy sets by
inverted lists.

A document's set holds the hashes of its distinct word n-grams.  Documents with
equal sets form a class (by a 64-bit hash of the sorted set); classes are
joined.

* Light sets (size at most the boundary) list their subsets of every size that
  a linked partner must share: two light sets link exactly when they meet at a
  subset at least as large as their required overlap, and linking each member
  with the smallest of its subset group keeps every connection, so nothing is
  verified and no group is expanded.
* Heavy sets enter inverted lists.  The elements are split by hash into parts;
  a linked pair differs in at most H elements, so of H + c non-empty parts c
  are equal on both sides.  The list key is the hash of such a part (a few
  elements together), which keeps lists short where single elements are common;
  of these keys a set leaves out its c - 1 most frequent (shared passages), and
  a linked pair still meets in one.
  Lists are scanned against one hub set each, in rounds: linked sets are
  contracted to their component, and only lists that still hold two components
  enter the next round, where a set of the largest component is the hub and its
  own component no longer asks.  So a round has at most ``HUBS`` pairs a set,
  however large a group of near copies is.
  Sets that share a list with another component after that enter
  lists of single elements, rarest first, with prefix and position filters, and
  are compared across components only.  Tasks compare the sets of a list by
  parity sketches (a lower bound of their difference) and return the pairs that
  may link, so no pair of a list is a row of a join; a long list is cut into
  blocks and compared block by block.  Those left are verified on the sets.
* The boundary minimises the keys and verified elements of both ways, taken
  over a sample of set sizes.  It changes the work, never the links.

Sets close to the boundary enter both ways, so mixed pairs are found in the
lists.  A set with too few non-empty parts is also listed under each element
for others of its kind, which keeps the result exact.

Edge cases: null or blank text has an empty set, no link and is its own
component; a shorter text than n words has its whole word sequence as one
n-gram; equal texts always link; repeated rows are rows of one class; null
doc_ids take part, and a component's id is its smallest non-null doc_id; an
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raretab.llm._common import Powers, mix64, range_hashes, stage, text_blocks, word_hashes
from raretab.llm._components import components, merged
from raretab.llm.mix import word_count

HUBS, ROUNDS = 8, 2         # hubs of a set in a round, and rounds before the open pairs
LIST_BLOCK = 1 << 11        # sets of a list that a task compares with as many others
CELLS = 1 << 18             # pairs of sets compared at once inside a task
SPARE = 64                  # a level of sets below 2**l shares 1 + 2**l / SPARE equal parts
LEVEL_BITS = np.uint64(63)
LARGEST_BOUNDARY = 24       # sizes up to which the subset way is costed
SIZE_SAMPLE = 20_000        # bound of the sample of set sizes


@dataclass(frozen=True)
class Threshold:
    """Link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def overlap(self, m: int, n: int) -> int:
        """Least intersection of linked sets of these sizes."""
        return -(-self.num * (m + n) // (self.num + self.den))

    def partners(self, m: int) -> range:
        """Sizes a set of size m can link with."""
        return range(-(-self.num * m // self.den), self.den * m // self.num + 1)

    def difference(self, m: int) -> int:
        """Most elements in which a set of size m differs from a linked one of
        its size or larger."""
        return max((m + n - 2 * self.overlap(m, n) for n in self.partners(m) if n >= m), default=0)

    def subset_sizes(self, m: int) -> list[int]:
        return sorted({self.overlap(m, n) for n in self.partners(m) if self.overlap(m, n) <= min(m, n)})


class Levels:
    """Sizes in octaves; a level splits elements into parts, enough for the
    largest set that enters it."""

    def __init__(self, t: Threshold) -> None:
        self.t, self.differ, self.top = t, np.zeros(1, np.int64), -1

    def upto(self, m: int) -> None:
        if m > self.top:
            self.top = max(1024, 2 * m)
            d = np.array([self.bound(k) for k in range(self.top + 1)], np.int64)
            self.differ = np.maximum.accumulate(d)

    def bound(self, m: int) -> int:
        """At least ``difference`` for every size: exact for small sets, the
        linear bound for others."""
        if m < 64:
            return self.t.difference(m)
        n = self.t.den * m // self.t.num
        return (m + n) * (self.t.den - self.t.num) // (self.t.num + self.t.den) + 1

    @staticmethod
    def spare(level: int) -> int:
        """Equal parts that linked sets of a level share at least."""
        return 1 + (1 << level) // SPARE

    def of(self, m: int) -> list[tuple[int, int]]:
        """(level, parts) that a set of size m enters: its own, and the next
        when a set there can link with it."""
        own = m.bit_length()
        levels = [own] if self.t.den * m // self.t.num < (1 << own) else [own, own + 1]
        out = []
        for level in levels:
            self.upto(1 << level)
            most = int(self.differ[(1 << level) - 1]) + self.spare(level)
            out.append((level, most + 2 + most // 4))
        return out


def part_keys(u: np.ndarray, levels: Levels) -> np.ndarray:
    """List keys of one sorted set: hashes of its first H + c non-empty parts,
    and of each element when it has fewer.  The low bits hold the level."""
    m = len(u)
    keys = []
    for level, parts in levels.of(m):
        need = int(levels.differ[m]) + levels.spare(level)
        salt = np.uint64((level * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
        spread = mix64(u ^ salt)
        part = (spread >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        whole = np.add.reduceat(spread[order], cut)
        size = np.diff(np.append(cut, m)).astype(np.uint64)
        got = mix64(whole + part[cut] * np.uint64(0xD6E8FEB86659FD93) + size * salt)[:need]
        keys.append(got & ~LEVEL_BITS | np.uint64(level))
        if len(cut) < need:
            keys.append(mix64(spread + np.uint64(0x5DEECE66D)) & ~LEVEL_BITS)   # level 0 keeps all
    return np.concatenate(keys)


def subset_keys(u: np.ndarray, t: Threshold) -> tuple[list[int], np.ndarray]:
    """(subset size, hash) of every subset a linked partner of a light set must
    share; the hash is a sum, so leaving elements out subtracts."""
    spread = mix64(u ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total, sizes, keys, m = np.add.reduce(spread), [], [], len(u)
    for size in t.subset_sizes(m):
        left_out = m - size
        if left_out == 0:
            got = np.array([total], np.uint64)
        else:
            pick = np.array(list(combinations(range(m), left_out)))
            got = total - np.add.reduce(spread[pick], axis=1)
        sizes += [size] * len(got)
        keys.append(mix64(got + np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))))
    return sizes, np.concatenate(keys)


def sets_of(arr: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    letters, words = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
    for _, _, data, off in text_blocks(arr):
        h, _, _, first = word_hashes(data, off, letters, lower=True)
        at = np.arange(max(len(h) - n + 1, 0))
        grams = range_hashes(h, at, at + n, words) if len(at) else np.zeros(0, np.uint64)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a:b - n + 1])
            elif b > a:
                yield range_hashes(h, np.array([a]), np.array([b]), words)
            else:
                yield np.zeros(0, np.uint64)


def set_hash(u: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        s = np.add.reduce(mix64(u + np.uint64(0x1F123BB5))) + np.uint64(len(u))
        x = np.bitwise_xor.reduce(mix64(u ^ np.uint64(0x2545F4914F6CDD1D))) if len(u) else np.uint64(0)
        return int(mix64(np.array([s * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64)).astype(np.int64)[0])


def sketch(u: np.ndarray) -> bytes:
    """Parity bits: bit i tells whether an odd number of elements hash to i.
    Two sketches differ in at most as many bits as the sets differ in elements.
    There are at least as many bits as elements."""
    bits = max(256, 1 << (len(u) - 1).bit_length()) if len(u) else 256
    place = (mix64(u ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Differing bits; the longer sketch is folded onto the shorter."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def boundary(docs: DataFrame, text: str, n: int, t: Threshold) -> int:
    """Light up to this size: least keys and verified elements on the sample."""
    rows = docs.count()
    sample = docs.sample(min(1.0, SIZE_SAMPLE / max(rows, 1)), seed=3)
    size = F.greatest(word_count(F.col(text)) - (n - 1), F.lit(1))
    counts = dict(sample.groupBy(F.least(size, F.lit(2 * LARGEST_BOUNDARY)).cast("int")).count().collect())
    levels = Levels(t)
    levels.upto(1 << 8)
    light = {m: sum(comb(m, k) for k in t.subset_sizes(m)) for m in range(1, LARGEST_BOUNDARY + 1)}
    heavy = {m: (int(levels.differ[m]) + 1) * len(levels.of(m)) + m for m in range(1, 2 * LARGEST_BOUNDARY + 1)}
    both = {m: t.den * m // t.num for m in light}

    def cost(x: int) -> int:
        return sum(c * (light[m] if m <= x else heavy[m]) + c * (heavy[m] if m <= x < both.get(m, m) else 0)
                   for m, c in counts.items())

    return min(range(LARGEST_BOUNDARY + 1), key=lambda x: (cost(x), x))


def grouped_classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4,
                   t: Threshold = Threshold(85, 100)) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_key, n_shingles, set_id), (components of the linked
    set_ids: node, root)."""
    light_to = boundary(docs, text, n, t)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sid, light, bits = [], [], [], []
            for u in sets_of(batch.column("text"), n):
                size.append(len(u))
                sid.append(set_hash(u))
                bits.append(sketch(u))
                if 0 < len(u) <= light_to:
                    s, k = subset_keys(u, t)
                    light.append([{"size": a, "key": int(b)} for a, b in zip(s, k.astype(np.int64), strict=True)])
                else:
                    light.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_text_key"), pa.array(size, pa.int64()), pa.array(sid, pa.int64()),
                 pa.array(bits, pa.binary()), pa.array(light, pa.list_(pa.struct([("size", pa.int32()), ("key", pa.int64())])))],
                ["doc_id", "text_key", "n_shingles", "set_id", "bits", "light"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(t)
        for batch in batches:
            keys, sid, seen = [], [], set()
            for u in sets_of(batch.column("text"), n):
                # light sets enter too when a heavier set can link with them
                if len(u) and t.den * len(u) // t.num > light_to and (name := set_hash(u)) not in seen:
                    seen.add(name)
                    keys.append(part_keys(u, levels))
                    sid.append(np.full(len(keys[-1]), name, np.int64))
                if len(keys) >= 256:
                    yield _key_batch(keys, sid)
                    keys, sid = [], []
            if keys:
                yield _key_batch(keys, sid)

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_key"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = stage(texts.mapInArrow(describe, f"doc_id {id_type}, text_key long, n_shingles long, set_id long, "
                                  "bits binary, light array<struct<size: int, key: long>>"), "jaccard-sets")
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("n_shingles").alias("n"), F.min("text_key").alias("text_key"), F.min("bits").alias("bits"))

    # light: the smallest member of a subset group links all that it can
    subsets = (rows.where(F.col("light").isNotNull())
               .select("set_id", "n_shingles", F.explode("light").alias("s"))
               .select("set_id", F.col("n_shingles").alias("n"), F.col("s.size").alias("o"), F.col("s.key").alias("key")).distinct())
    hubs = subsets.groupBy("o", "key").agg(F.min(F.struct("n", "set_id")).alias("h"))
    met = subsets.join(hubs, ["o", "key"]).where(F.col("set_id") != F.col("h.set_id"))
    least = F.expr(f"({t.num} * (n + h.n) + {t.num + t.den - 1}) div {t.num + t.den}")
    light_links = met.where(F.col("o") >= least).select(F.col("h.set_id").alias("a"), F.col("set_id").alias("b")).distinct()

    # heavy: lists with two or more classes
    listed = texts.select("text").mapInArrow(lists, "key long, set_id long")
    often = listed.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    # linked sets of a level share c lists, so each may leave out its c - 1 most frequent
    level = F.col("key").bitwiseAND(F.lit(int(LEVEL_BITS))).cast("int")
    by_length = Window.partitionBy("set_id", level).orderBy(F.desc("f"), "key")
    spare = F.expr(f"1 + (1L << (key & {int(LEVEL_BITS)})) div {SPARE}")
    members = stage(listed.join(often, "key").distinct().withColumn("_n", F.row_number().over(by_length))
                    .where(F.col("_n") >= spare).select("key", "set_id"), "jaccard-lists")
    wanted = stage(members.select("set_id").distinct().join(classes, "set_id"), "jaccard-wanted")
    # one plan at every size: texts are exchanged by their key, never against a broadcast
    keys = wanted.select("set_id", "n", F.col("text_key").alias("_text_key")).hint("merge")
    found = (texts.join(keys, "_text_key")
             .select("set_id", "n", "text").dropDuplicates(["set_id"]))
    found = stage(found, "jaccard-texts")

    root, tried, mixed = components(stage(light_links, "jaccard-links")), None, members
    for turn in range(ROUNDS):
        mixed = stage(_mixed(mixed.select("key", "set_id"), root), "jaccard-mixed")
        pairs = _hub_pairs(mixed, turn)
        pairs = stage(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-hubs")
        tried = pairs if tried is None else tried.union(pairs)
        root = merged(root, stage(_verified(_close(pairs, wanted, t), found, n, t), "jaccard-links"))

    # what the hubs left open: sets that share a list with another component
    unsettled = _mixed(mixed.select("key", "set_id"), root).groupBy("set_id").agg(F.min("root").alias("root"))
    rest = _open_pairs(found.join(unsettled, "set_id"), n, t).join(tried, ["a", "b"], "left_anti")
    root = merged(root, stage(_verified(_close(rest, wanted, t), found, n, t), "jaccard-links"))
    return rows.select("doc_id", "text_key", "n_shingles", "set_id"), root


def _mixed(members: DataFrame, root: DataFrame) -> DataFrame:
    """(key, set_id, root) of the lists that hold more than one component."""
    named = members.join(root, members["set_id"] == root["node"], "left").select(
        "key", "set_id", F.coalesce("root", "set_id").alias("root"))
    several = named.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("key")
    return named.join(several, "key")


def _hub_pairs(mixed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a < b) of one round: in each list a set of its most frequent
    component is the hub of all others; a set takes the ``HUBS`` hubs that most
    of its lists name.  Every list and every round has its own order, so lists of
    the same sets name different hubs."""
    own = F.xxhash64(F.lit(turn), "key").alias("_s")
    parts = (mixed.groupBy("key", own, "root")
             .agg(F.count("*").alias("c"), F.min(F.struct(F.col("set_id").bitwiseXOR(own).alias("_o"), "set_id")).alias("_m")))
    major = parts.groupBy("key").agg(F.max(F.struct("c", F.col("_m._o").alias("_o"), "root", F.col("_m.set_id").alias("hub"))).alias("m"))
    met = (mixed.join(major, "key").where("root <> m.root")
           .groupBy(F.col("m.hub").alias("hub"), "set_id").agg(F.count("*").alias("c")))
    by_lists = Window.partitionBy("set_id").orderBy(F.desc("c"), "hub")
    return (met.withColumn("_n", F.row_number().over(by_lists)).where(F.col("_n") <= HUBS)
            .select(F.least("hub", "set_id").alias("a"), F.greatest("hub", "set_id").alias("b")).distinct())


def _open_pairs(texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Pairs (a < b) of different components that can link, from inverted lists
    of single elements in order of frequency among these sets.

    Only the first ``m - overlap + 1`` elements of a set are listed, rarest
    first; linked sets share one of them.  Tasks compare the sets of a list (of
    a pair of blocks, where a list has more than ``LIST_BLOCK``) and return the
    pairs whose places, sizes and sketches allow a link."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, roots = batch.column("set_id").to_numpy(), batch.column("root").to_numpy()
            for i, u in enumerate(sets_of(batch.column("text"), n)):
                size = len(u)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u.view(np.int64)), pa.array(np.full(size, ids[i])), pa.array(np.full(size, roots[i])),
                     pa.array(np.full(size, size, np.int32))], ["element", "set_id", "root", "m"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([sketch(u) for u in sets_of(batch.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), bits], ["set_id", "bits"])

    listed = stage(texts.select("set_id", "root", "text")
                   .mapInArrow(elements, "element long, set_id long, root long, m int"), "jaccard-elements")
    common = listed.groupBy("element").agg(F.count("*").alias("f")).where("f > 1")
    shared = listed.join(common, "element")
    per_set = Window.partitionBy("set_id")
    place = F.row_number().over(per_set.orderBy("f", "element")) + F.col("m") - F.count("*").over(per_set) - 1
    prefix = (shared.withColumn("at", place)
              .where(F.expr(f"at <= m - ({t.num} * m + {t.den - 1}) div {t.den}"))
              .select("element", "set_id", "root", "m", "at"))
    prefix = stage(prefix, "jaccard-prefix")
    several = (prefix.groupBy("element").agg(F.count("*").alias("c"), F.min("root").alias("_a"), F.max("root").alias("_b"))
               .where("_a < _b").select("element", F.expr(f"(c + {LIST_BLOCK - 1}) div {LIST_BLOCK}").alias("_blocks")))
    bits = texts.select("set_id", "text").mapInArrow(describe, "set_id long, bits binary")
    block = F.pmod(F.xxhash64("set_id"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    members = (prefix.join(several, "element").withColumn("block", block).withColumn("_other", other)
               .withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other"))
               .drop("_blocks", "_other").join(bits, "set_id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for table in _whole_lists(batches, ["element", "lo", "hi"]):
            pairs = {(min(p), max(p)) for p in _list_pairs(table, t)} - seen
            if len(seen) < CELLS:
                seen |= pairs
            a, b = zip(*sorted(pairs), strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (members.repartition("element", "lo", "hi").sortWithinPartitions("element", "lo", "hi")
            .mapInArrow(compare, "a long, b long").distinct())


def _whole_lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Sorted rows again, no list of equal ``names`` being cut between tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            cut = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            first = [held[-1].column(c)[-1].as_py() for c in names] if held else None
            if cut or (first is not None and first != keys[:, 0].tolist()):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _list_pairs(table: pa.Table, t: Threshold) -> Iterator[tuple[int, int]]:
    """Pairs of each list: different roots, blocks ``lo`` and ``hi``, and a
    link allowed by sizes, places and sketches."""
    col = {c: table.column(c).to_numpy() for c in ("element", "lo", "hi", "block", "root", "set_id")}
    m, at = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "at"))
    sketches = table.column("bits").to_pylist()
    rows = len(m)
    new = np.ones(rows, bool)
    new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("element", "lo", "hi")], axis=0)
    end = np.append(np.flatnonzero(new)[1:], rows)[np.cumsum(new) - 1]
    partners = end - np.arange(rows) - 1
    total = np.concatenate([[0], np.cumsum(partners)])
    lo = 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CELLS, side="right")) - 1)
        n = partners[lo:hi]
        x = np.repeat(np.arange(lo, hi), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        need = -(-t.num * (m[x] + m[y]) // (t.num + t.den))
        ok = (col["root"][x] != col["root"][y]) & (np.minimum(m[x], m[y]) >= need)
        ok &= (m[x] - at[x] >= need) & (m[y] - at[y] >= need)
        ok &= (col["lo"][x] == col["hi"][x]) | (col["block"][x] != col["block"][y])
        x, y, need = x[ok], y[ok], need[ok]
        ok = _sketch_distances(sketches, x, y) <= m[x] + m[y] - 2 * need
        yield from zip(col["set_id"][x[ok]].tolist(), col["set_id"][y[ok]].tolist(), strict=True)
        lo = hi


def _sketch_distances(sketches: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``sketch_distance`` of many pairs: each at the width of its shorter sketch."""
    size = np.array([len(s) for s in sketches], np.int64)
    width, out = np.minimum(size[x], size[y]), np.zeros(len(x), np.int64)
    for w in np.unique(width):
        these = np.flatnonzero(width == w)
        used, code = np.unique(np.concatenate([x[these], y[these]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[i], np.uint64).reshape(-1, w // 8), axis=0) for i in used])
        half, step = len(these), max(1, CELLS * 8 // int(w))
        for k in range(0, half, step):
            part = slice(k, min(k + step, half))
            differ = folded[code[:half][part]] ^ folded[code[half:][part]]
            out[these[part]] = np.bitwise_count(differ).sum(axis=1)
    return out


def _key_batch(keys: list[np.ndarray], sid: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(sid))],
                                      ["key", "set_id"])


def _verified(pairs: DataFrame, texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, known, hub = [], None, None
            for a, u, v in zip(batch.column("a").to_pylist(), _lazy(batch.column("ta"), n),
                               sets_of(batch.column("tb"), n), strict=True):
                if a != known:
                    known, hub = a, u()
                both = len(np.intersect1d(hub, v, assume_unique=True))
                ok.append(t.den * both >= t.num * (len(hub) + len(v) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("tb"))
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
            .mapInArrow(check, "a long, b long"))


def _close(pairs: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """Pairs that sizes and sketches allow to link (never drops a link)."""

    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([sketch_distance(a, b) <= k for a, b, k in
                         zip(x.to_pylist(), y.to_pylist(), most.to_pylist(), strict=True)], pa.bool_())

    left = sets.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y"))
    both = F.col("na") + F.col("nb")
    most = both - 2 * F.expr(f"({t.num} * (na + nb) + {t.num + t.den - 1}) div {t.num + t.den}")
    sized = (pairs.join(left, "a").join(right, "b")
             .where((F.col("na") * t.num <= F.col("nb") * t.den) & (F.col("nb") * t.num <= F.col("na") * t.den)))
    return stage(sized.where(near("x", "y", most)).select("a", "b"), "jaccard-pairs")


def _lazy(arr: pa.Array, n: int) -> Iterator:
    """Set of each text, computed only when asked for."""
    for i in range(len(arr)):
        yield lambda i=i: next(sets_of(arr.slice(i, 1), n))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 4,
                    num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, set_id, group (null
    for an empty set) and component_id."""
    rows, root = grouped_classes(docs, text, doc_id, n, Threshold(num, den))
    placed = rows.join(root, rows["set_id"] == root["node"], "left").withColumn(
        "group", F.when(F.col("n_shingles") > 0, F.coalesce("root", "set_id")))
    least = placed.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("_least"))
    return placed.join(least, "group", "left").select(
        "doc_id", "text_key", "n_shingles", "set_id", "group", F.coalesce("_least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5,
             num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group: the smallest doc_id (null last), then the
    smallest text hash.  Documents with empty sets stay; rows that agree in id
    and text stay once."""
    found = near_duplicates(docs, text, doc_id, n, num, den)
    best = (found.where(F.col("group").isNotNull()).groupBy("group")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")).alias("b"))
            .select("b.doc_id", "b.text_key"))
    alone = found.where(F.col("group").isNull()).select("doc_id", "text_key").distinct()
    keys = best.union(alone).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"),
                                    F.col("doc_id").isNull().alias("_no_id"), F.col("text_key").alias("_text_key"))
    names = ["_id", "_no_id", "_text_key"]
    # the row travels as one column, so no name of its own can clash
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
                        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_id"), F.col(doc_id).isNull().alias("_no_id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_key"))
    return keyed.join(keys, names, "left_semi").dropDuplicates(names).select("_row.*")
