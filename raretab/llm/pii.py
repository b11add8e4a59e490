"""Personal data: pattern spans plus information-theoretic sanitisation.

Patterns find the protected entities (emails, addresses, cards, phones).  A
term (a run of letters and digits of any length) anywhere in the documents of an
entity reveals it when seeing the term tells most of what there is to know about
the entity.  With document counts over the whole corpus and whole texts,

    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t)))  >=  alpha * IC(e),
    IC(e) = log2(N / n(e)).

One document proves nothing: every rare word of it has the highest PMI.  So the
term must also be tied, by a lower confidence bound, to the entity or to a group
of related entities (domain of an email, network of an address, leading digits
of a card or phone, the kind):

    log2(N * low(g, t) / n(g))  >=  alpha * IC(g),

where ``low`` is the lower end of the Wilson interval of the share of t's
documents that hold g.  Its hits are the different texts with both, less the one
the term would be masked in; its misses are the documents with t and without g.
A term of one text is thus never masked, a name of two texts is where both hold
the entity or its rare relatives, and a common word is not.  There is no floor on
the number of texts of an entity, and the rule is the same at every size.  Near
copies of a text are different texts.

Every occurrence of a revealing term becomes a span of kind ``term`` in the
documents that hold the entity, and ``sanitise`` generalises every span to its
kind's name.

Everything is built-in column functions and joins: one pass finds spans, one
counts terms (pre-aggregated per task), the terms of documents with an entity
that are rare enough to reveal it are counted with it, those left with its
groups, and one pass over the documents that hold a revealing term finds its
places.  Entities and groups of equal document sets count as one, so a page with
thousands of addresses does not pair each of them with each of its words.
Patterns are written so that matching is linear: possessive where nothing can
follow, and started only where a run starts.

Edge cases: null text is empty; text without spans has empty results; spans of
different kinds may overlap, a term never overlaps a pattern span; repeated
rows count as documents but as one text; an empty table gives no rows; columns
other than the named ones are not read (``sanitise`` passes them through).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raretab.llm._common import free_name, stage

# Kinds in their order and what they match.
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTER = r"[\p{L}\p{N}]"
TERM = rf"{LETTER}++"


@dataclass(frozen=True)
class Disclosure:
    alpha: float = 0.85         # share of an entity's information that a term may not give
    z: float = 1.28             # one-sided normal quantile of the lower bound (0.90)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3)
                        & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]+", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(hits: str, gaps: str) -> Column:
    """Matches and the text between them -> array of (start, end, value)."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    pairs = F.arrays_zip(F.col(hits).alias("m"), F.slice(F.col(gaps), F.lit(1), F.size(hits)).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["m"])
        one = F.struct(a.alias("start"), b.alias("end"), x["m"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def _find(df: DataFrame, name: str, pattern: str | Column, gate: Column | None = None) -> DataFrame:
    """Adds array column ``name`` of (start, end, value) of all matches in
    column ``_t``."""
    none = F.array().cast("array<string>")
    hits = F.regexp_extract_all(F.col("_t"), F.lit(pattern), F.lit(0))
    df = df.withColumn("_hits", hits if gate is None else F.when(gate, hits).otherwise(none))
    df = df.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split(F.col("_t"), pattern, -1)).otherwise(none))
    return df.withColumn(name, F.when(F.size("_hits") > 0, _located("_hits", "_gaps")).otherwise(
        F.array().cast("array<struct<start:int,end:int,value:string>>"))).drop("_hits", "_gaps")


def base_spans(texts: DataFrame) -> DataFrame:
    """Adds ``spans``: array of (start, k, end, value) sorted by start and kind,
    over column ``_t``."""
    gates = {"email": F.col("_t").contains("@"), "phone": F.col("_t").contains("+")}
    out = texts
    for kind, pattern in PATTERNS.items():
        out = _find(out, f"_{kind}", pattern, gates.get(kind))
    parts = []
    for k, kind in enumerate(PATTERNS):
        good = F.filter(f"_{kind}", lambda x: _valid(kind, x["value"]))  # noqa: B023  (called at once)
        parts.append(F.transform(good, lambda x: F.struct(
            x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), x["value"].alias("value"))))  # noqa: B023
    # The id keeps later filters from being pushed below, where they would repeat the matching.
    spans = F.when(F.monotonically_increasing_id() >= 0, F.sort_array(F.concat(*parts)))
    return out.withColumn("spans", spans).drop(*[f"_{kind}" for kind in PATTERNS])


def _entity(k: Column, value: Column) -> Column:
    """(entity, related, kind): an entity and the groups it belongs to."""
    plain = F.when(k <= 1, F.lower(value)).otherwise(F.regexp_replace(value, "[^0-9]+", ""))
    related = (F.when(k == 0, F.substring_index(plain, "@", -1)).when(k == 1, F.substring_index(plain, ".", 3))
               .otherwise(F.substring(plain, 1, 6)))
    kind = k.cast("string")
    return F.struct(F.concat_ws(":", kind, plain).alias("entity"), F.concat_ws("@", kind, related).alias("related"),
                    kind.alias("kind"))


def _words(text: Column) -> Column:
    """Distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def term_counts(texts: DataFrame) -> DataFrame:
    """(term, n_term, repeated): documents that hold each term, over all
    documents, and whether these have more than one text."""
    return (texts.select("text_key", F.explode(_words(F.col("_t"))).alias("term")).groupBy("term")
            .agg(F.count("*").alias("n_term"), (F.min("text_key") < F.max("text_key")).alias("repeated")))


def _classes(held: DataFrame) -> DataFrame:
    """(group, class, n_class): entities, related groups and kinds; groups held
    by the same rows share a class.  n_class counts their documents."""
    rows = held.select("row_key", "copies", F.explode(F.array("entity", "related", "kind")).alias("group")).distinct()
    marks = [F.bit_xor(F.xxhash64("row_key", F.lit(i))).cast("string") for i in range(2)]
    return rows.groupBy("group").agg(
        F.concat_ws(":", F.count("*").cast("string"), *marks).alias("class"), F.sum("copies").alias("n_class"))


def _seen(pairs: DataFrame) -> DataFrame:
    """(class, n_class, term, n_term, n_pair, texts): documents and different
    texts that hold both."""
    keys = ["class", "n_class", "term", "n_term"]
    return (pairs.groupBy(*keys, "text_key").agg(F.sum("copies").alias("copies"))
            .groupBy(*keys).agg(F.sum("copies").alias("n_pair"), F.count("*").alias("texts")))


def _lower_bound(hits: Column, misses: Column, z: float) -> Column:
    """Lower end of the Wilson interval of hits / (hits + misses)."""
    n = (hits + misses).cast("double")
    share = hits / n
    spread = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(hits > 0, (share + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(0.0)


def revealing_terms(texts: DataFrame, holders: DataFrame, rows: float, rule: Disclosure) -> DataFrame:
    """(row_key, revealing): terms to mask in each row.  ``holders`` has a row
    per different row with a span (row_key, text_key, _t, spans, copies),
    ``texts`` all documents, ``rows`` of them."""
    held = stage(holders.select("row_key", "copies", F.explode(F.array_distinct(F.transform(
        "spans", lambda s: _entity(s["k"], s["value"])))).alias("e")).select("row_key", "copies", "e.*"), "pii-entities")
    classes = stage(_classes(held), "pii-classes")

    def placed(level: str) -> DataFrame:
        return held.select("row_key", F.col(level).alias("group")).join(classes, "group").select("row_key", "class", "n_class")

    own = placed("entity").distinct()
    levels = held.select("entity", "related", "kind").distinct()
    for level in ("entity", "related", "kind"):
        levels = levels.join(classes.select(F.col("group").alias(level), F.col("class").alias(f"{level}_class")), level)

    def share(n_class: Column) -> Column:       # the least share of t's documents: PMI >= alpha * IC
        return F.pow(n_class / rows, F.lit(1 - rule.alpha))

    # terms of one text cannot pass
    words = (holders.select("row_key", "text_key", "copies", F.explode(_words(F.col("_t"))).alias("term"))
             .join(term_counts(texts).where("repeated").drop("repeated"), "term"))
    words = stage(words, "pii-words")
    # nor can those too common for every entity of their row
    most = own.groupBy("row_key").agg(F.max("n_class").alias("most"))
    rare = words.join(most, "row_key").where(F.col("most") >= share(F.col("most")) * F.col("n_term"))
    near = _seen(rare.join(own, "row_key")).where(F.col("n_pair") >= share(F.col("n_class")) * F.col("n_term"))
    near = stage(near.select(F.col("class").alias("entity_class"), "term"), "pii-near")

    # the groups count the terms left in all rows, also where no entity is near
    asked = words.join(near.select("term").distinct(), "term", "left_semi")
    every = placed("entity").unionByName(placed("related")).unionByName(placed("kind")).distinct()
    low = _lower_bound(F.col("texts") - 1, F.col("n_term") - F.col("n_pair"), rule.z)
    tied = _seen(asked.join(every, "row_key")).where(low >= share(F.col("n_class"))).select("class", "term")
    groups = levels.select("entity_class", F.explode(F.array_distinct(F.array(
        "entity_class", "related_class", "kind_class"))).alias("class")).distinct()
    told = near.join(groups, "entity_class").join(tied, ["class", "term"], "left_semi")
    return (own.select("row_key", F.col("class").alias("entity_class"))
            .join(told.select("entity_class", "term").distinct(), "entity_class")
            .groupBy("row_key").agg(F.collect_set("term").alias("revealing")))


def _mentions(texts: DataFrame) -> DataFrame:
    """(row_key, _t, spans, revealing) -> adds ``terms``: every occurrence of a
    revealing term, whole words only, none overlapping a span."""
    # the spellings that occur, so that matching needs no case folding
    spelled = F.array_distinct(F.regexp_extract_all(F.col("_t"), F.lit(TERM), F.lit(0)))
    spelled = F.array_join(F.filter(spelled, lambda x: F.array_contains("revealing", F.lower(x))), "|")
    pattern = F.concat(F.lit(rf"(?<!{LETTER})(?:"), F.col("_spelled"), F.lit(rf")(?!{LETTER})"))
    found = _find(texts.withColumn("_spelled", spelled).where(F.col("_spelled") != ""), "_mentioned", pattern)
    apart = F.filter("_mentioned", lambda x: ~F.exists(
        "spans", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    return found.withColumn("terms", F.transform(apart, lambda x: F.struct(
        x["start"].alias("start"), F.lit(len(KINDS) - 1).alias("k"), x["end"].alias("end"),
        F.lower(x["value"]).alias("value"))))


def row_key(doc_id: str, text: str) -> Column:
    """128 bits of a row's id and text (null text as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(F.col(doc_id), t).alias("a"), F.xxhash64(t, F.col(doc_id), F.lit(1)).alias("b"))


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: doc_id, row_key, base (pattern spans) and spans
    (with revealing terms): arrays of (start, k, end, value), sorted."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    texts = texts.withColumn("row_key", row_key("doc_id", "_t")).withColumn("text_key", F.xxhash64("_t"))
    found = base_spans(texts)
    # text of documents without a span is not needed any more
    found = stage(found.withColumn("_t", F.when(F.size("spans") > 0, F.col("_t"))), "pii-spans")

    # one row for repeated rows, with their number
    holders = found.where(F.size("spans") > 0).groupBy("row_key").agg(
        *[F.first(c).alias(c) for c in ("text_key", "_t", "spans")], F.count("*").alias("copies"))
    told = revealing_terms(texts, holders, float(max(docs.count(), 1)), rule)
    terms = _mentions(holders.join(told, "row_key")).select("row_key", "terms")
    return (found.join(terms, "row_key", "left")
            .select("doc_id", "row_key", F.col("spans").alias("base"), F.when(
                F.col("terms").isNull(), F.col("spans")).otherwise(F.sort_array(F.concat("spans", "terms"))).alias("spans")))


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("long")


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with every span generalised to its kind's name in brackets;
    overlapping spans become the name of the first.  Null texts stay null."""
    key, marked = free_name("_row_key", docs.columns), free_name("_spans", docs.columns)
    spans = find(docs, text, doc_id, rule).where(F.size("spans") > 0).select(
        F.col("row_key").alias(key), F.col("spans").alias(marked)).dropDuplicates([key])
    keyed = docs.withColumn(key, row_key(doc_id, text))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    t = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]),
                                             F.element_at(names, s["k"] + 1)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(marked, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    return (keyed.join(spans, key, "left")
            .withColumn(text, F.when(F.col(marked).isNull(), t).otherwise(done))
            .select(*docs.columns))
