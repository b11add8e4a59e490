"""Quality rules as a short-circuit cascade.

``text_statistics`` adds the counts the base verdict needs.  ``Rule`` pairs a
name with a predicate that is true for a text to reject.  ``order_rules`` runs
every rule on a bounded hashed sample.  A rule's cost is the time of a pass over
the sample, repeated so that the work outweighs the job, less the time of a pass
without a rule; its selectivity is the share of texts that it rejects and that
no rule placed before it does.  The rule with most such rejections per cost
comes next.  ``cascade`` evaluates the rules in that order with CASE WHEN, so a
later rule is not computed for a text that an earlier one has rejected.  The
order changes the work only, never the verdict: a text is kept when no rule
rejects it.  ``failed_rule`` names the first rule in that order, which depends
on measured times.

Everything is built-in column functions over whole texts, without a shuffle.

Edge cases: null text has no words and fails the base; ties in rejections per
cost keep the given order; an empty sample keeps the given order; repeated rows
get equal verdicts; extra columns pass through (``quality`` keeps those named
like its scratch columns too), columns named as an output are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import SPACE, SPACE_CHARS, set_aside

# Fixed values of the base verdict.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20          # percent of the words

SAMPLE_ROWS = 2_000         # bound of the sample that orders the rules
REPEATS = 4                 # times a timed pass goes over the sample
SCRATCH = ("_words", "_hashes", "_grams", "_sorted", "_placed", "_lines", "_n_lines", "_failed")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]     # of the text column; other columns by name


def _count(text: Column, pattern: str) -> Column:
    """Characters left when all others are taken away."""
    return F.length(F.regexp_replace(text, pattern, ""))


DEFAULT_RULES = (
    Rule("symbols", lambda t: 100 * F.col("n_symbols") > 4 * F.col("word_chars")),
    Rule("exclamations", lambda t: 100 * (F.length(t) - F.length(F.translate(t, "!", ""))) > 5 * F.col("word_chars")),
    Rule("word_length", lambda t: (F.col("word_chars") < 2 * F.col("n_words"))
         | (F.col("word_chars") > 15 * F.col("n_words"))),
    Rule("duplicate_lines", lambda t: 2 * F.col("n_dup_lines") > F.col("_n_lines")),
    Rule("shouting", lambda t: 2 * _count(t, r"\P{Lu}+") > _count(t, r"\P{L}+")),
    Rule("few_letters", lambda t: 10 * _count(t, r"\P{L}+") < 4 * F.col("word_chars")),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def _with_repeated_words(df: DataFrame) -> DataFrame:
    """``_grams`` (hash of every window) -> n_repeat_words.  Sorting the hashes
    tells cheaply whether any repeats; only then the windows are sorted with
    their places and the union of the repeated ones is measured.  Arrays that a
    lambda indexes are columns of their own, so they are made once per row."""
    df = df.withColumn("_sorted", F.sort_array("_grams"))
    repeats = (F.size("_sorted") > 1) & F.exists(
        F.transform("_sorted", lambda g, i: g == F.get("_sorted", i - 1)), lambda x: F.coalesce(x, F.lit(False)))
    placed = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(repeats, placed))
    twin = F.filter("_placed", lambda x, k: (x["g"] == F.get("_placed", k - 1)["g"])
                    | (x["g"] == F.get("_placed", k + 1)["g"]))
    covered = F.aggregate(
        F.sort_array(F.transform(twin, lambda x: x["i"])),
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")))
    return df.withColumn("n_repeat_words", F.coalesce(covered["n"], F.lit(0)).cast("long"))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)
    and ``_n_lines`` (lines with a word)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", _words(t))
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    out = out.withColumn("_hashes", hashes)
    h = F.col("_hashes")
    grams = F.when(F.size(h) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = _with_repeated_words(out.withColumn("_grams", grams))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns
          if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines")],
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Not deterministic to the optimizer: a later filter is then not pushed below, where it
        # would inline the arrays above into their lambdas and build them once per element.
        F.when(F.monotonically_increasing_id() >= 0, F.col("n_repeat_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("_n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _seconds(sample: DataFrame, rejects: Column) -> float:
    """Time of one pass that counts ``rejects`` over the repeated sample."""
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    began = time.perf_counter()
    again.agg(F.count_if(rejects & (F.col("_again") > 0))).first()
    return time.perf_counter() - began


def order_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text",
                sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share it rejects beyond the rules before it, seconds) in the order
    of rejections per cost, measured on about ``sample_rows`` rows that pass the
    base."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = text_statistics(docs.sample(share, seed=5), text).where(~base_failed()).cache()
    flags = [F.coalesce(rule.rejects(F.col(text)), F.lit(False)) for rule in rules]
    # verdicts of all rules: at most one row a sampled text
    patterns = [(list(r[:-1]), r[-1]) for r in sample.groupBy(
        *[f.alias(f"_{i}") for i, f in enumerate(flags)]).count().collect()]
    kept = sum(n for _, n in patterns)
    idle = _seconds(sample, F.col("n_words") < 0)
    cost = [max(_seconds(sample, f) - idle, 1e-6) / REPEATS for f in flags]
    sample.unpersist()
    ordered, waiting = [], list(range(len(rules)))
    while waiting:
        new = {i: sum(n for bad, n in patterns if bad[i]) / max(kept, 1) for i in waiting}
        best = max(waiting, key=lambda i: (new[i] / cost[i], -i))
        ordered.append((rules[best], new[best], cost[best]))
        patterns = [(bad, n) for bad, n in patterns if not bad[best]]
        waiting.remove(best)
    return ordered


def cascade(stats: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """Adds ``base_failed``, ``failed_rule`` (first one in the order, null when
    none) and ``kept``."""
    t = F.coalesce(F.col(text), F.lit(""))
    verdict = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        verdict = verdict.when(rule.rejects(t), F.lit(rule.name))
    keep = [c for c in stats.columns if c not in ("base_failed", "failed_rule", "kept", "_n_lines")]
    return (stats.withColumn("_failed", verdict)
            .select(*[F.col(f"`{c}`") for c in keep], base_failed().alias("base_failed"),
                    F.col("_failed").alias("failed_rule"), F.col("_failed").isNull().alias("kept")))


def quality(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, text: str = "text") -> DataFrame:
    """Measure, order, apply."""
    apart, moved = set_aside(docs, SCRATCH)
    text = {own: free for free, own in moved.items()}.get(text, text)
    ordered = [rule for rule, _, _ in order_rules(apart, rules, text)]
    return cascade(text_statistics(apart, text), ordered, text).withColumnsRenamed(moved)


__all__ = ["DEFAULT_RULES", "Rule", "base_failed", "cascade", "order_rules", "quality", "text_statistics"]
