"""URL filter: glob rules as one bit-parallel automaton.

All patterns are packed into one multiword Shift-And mask: a pattern of L
tokens owns L + 1 consecutive bits, bit j meaning "the first j tokens have
matched".  One character moves every pattern at once,

    D = ((D & accept[c]) << 1, with the carry between words) | (D & stay[c])

where ``accept[c]`` marks states whose next token takes c and ``stay[c]``
states that sit on a star which may swallow c.  numpy simulates the masks of a
whole Arrow batch together, character by character; a task needs no shuffle and
no state beyond its batch.

Glob language over the canonical URL (host + path + ``?`` query, fragment and
scheme dropped, A-Z of the host lower-cased): ``?`` is one code point, ``*`` a
run of code points without ``/`` and ``?``, ``**`` any run, a backslash takes
the next character literally.  A pattern must match the whole canonical URL.

A host rule (host, path) fits the host and all its subdomains when the path
starts with the rule's; it becomes two patterns.  The longest host rule (code
points of host + path) wins; of equally long ones a block, then the first given.
Where no host rule fits, the first fitting glob decides, and ``default`` where
none does.

Edge cases: a null url and one without ``://`` have an empty host and path, fit
no host rule and get the verdict of the globs or the default; an empty table
gives no rows; repeated rows stay; very long urls are read whole; only the
named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
BATCH_CELLS = 1 << 20       # URLs x mask words simulated at once

# Fixed value: globs for URLs that carry no running text, used where no host rule fits.
PLAIN_GLOBS = (
    (BLOCK, "**.exe"), (BLOCK, "**.zip"), (BLOCK, "**/login**"), (BLOCK, "**/cart/**"),
    (BLOCK, "ads.**"), (BLOCK, r"**\?**sessionid=**"),
)


@dataclass(frozen=True)
class HostRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        text = _literal(self.name)
        return f"{text}**", f"*.{text}**"


def _literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def tokens(glob: str) -> list[str | None]:
    """Literal characters, ``?``, ``*`` and ``**``; literals as one-character
    strings behind a backslash, so that a literal star is not a wildcard."""
    out, i = [], 0
    while i < len(glob):
        if glob[i] == "\\" and i + 1 < len(glob):
            out.append("\\" + glob[i + 1])
            i += 2
        elif glob.startswith("**", i):
            out.append("**")
            i += 2
        else:
            out.append(glob[i] if glob[i] in "*?" else "\\" + glob[i])
            i += 1
    return out


class Automaton:
    """The masks of all patterns; ``match`` runs them over many strings."""

    def __init__(self, globs: Sequence[str]) -> None:
        letters = sorted({t[1] for g in globs for t in tokens(g) if t[0] == "\\"} | {"/", "?"})
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        classes = [*letters, None]                      # None: any other code point
        accept = [[] for _ in classes]
        stay = [[] for _ in classes]
        bit, self.first, self.last = 0, [], []
        for g in globs:
            self.first.append(bit)
            for t in tokens(g):
                if t in ("*", "**"):
                    for k, c in enumerate(classes):
                        if t == "**" or c not in ("/", "?"):
                            stay[k].append(bit)
                else:
                    for k, c in enumerate(classes):
                        if t == "?" or c == t[1]:
                            accept[k].append(bit)
                    bit += 1
            self.last.append(bit)
            bit += 1
        self.words = -(-max(bit, 1) // 64)
        self.accept = np.stack([self._mask(x) for x in accept])
        self.stay = np.stack([self._mask(x) for x in stay])
        self.start = self._mask(self.first)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix (texts x patterns)."""
        found = np.zeros((len(texts), len(self.first)), bool)
        step = max(1, BATCH_CELLS // self.words)
        for lo in range(0, len(texts), step):
            found[lo:lo + step] = self._run(texts[lo:lo + step])
        return found

    def _run(self, texts: Sequence[str]) -> np.ndarray:
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")        # texts still running come first
        size = size[order]
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(at, len(self.letters) - 1)] == points
        kind = np.where(known, at, len(self.letters))
        begin = np.cumsum(size) - size
        state = np.tile(self.start, (len(texts), 1))
        running = len(texts)
        for t in range(int(size.max(initial=0))):
            while size[running - 1] <= t:
                running -= 1
            c = kind[begin[:running] + t]
            now = state[:running]
            moved = now & self.accept[c]
            carry = moved[:, :-1] >> np.uint64(63)
            moved <<= np.uint64(1)
            moved[:, 1:] |= carry
            state[:running] = moved | (now & self.stay[c])
        last = np.array(self.last, np.int64)
        hit = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its question mark, empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: Sequence[HostRule], globs: Sequence[tuple[str, str]] = PLAIN_GLOBS,
          default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, glob_rule, verdict) of every row of ``pages``."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.action != BLOCK))      # stable: first given wins
    patterns = [g for r in ranked for g in r.globs()] + [g for _, g in globs]
    owner = np.array([i for i in range(len(ranked)) for _ in (0, 1)]
                     + [len(ranked) + i for i in range(len(globs))], np.int64)
    machine = Automaton(patterns)
    names = [r.name for r in ranked] + [None] * len(globs) + [None]
    shown = [None] * len(ranked) + [g for _, g in globs] + [None]
    actions = [r.action for r in ranked] + [a for a, _ in globs] + [default]
    none = len(actions) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column("_canonical").to_pylist()
            hit = machine.match(urls)
            best = np.where(hit, owner, none).min(axis=1, initial=none).tolist()
            yield pa.record_batch([
                b.column(id_col), b.column("host"), b.column("path"),
                pa.array([names[i] for i in best], pa.string()), pa.array([shown[i] for i in best], pa.string()),
                pa.array([actions[i] for i in best], pa.string())],
                names=[id_col, "host", "path", "rule", "glob_rule", "verdict"])

    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias(id_col), host_of(url).alias("host"), path_of(url).alias("path"),
                         query_of(url).alias("_query"))
    kind = pages.schema[id_col].dataType.simpleString()
    return parts.select(id_col, "host", "path", F.concat("host", "path", "_query").alias("_canonical")).mapInArrow(
        run, f"`{id_col}` {kind}, host string, path string, rule string, glob_rule string, verdict string")
