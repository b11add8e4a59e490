"""Running sums over two levels of buckets against a plain cumulative sum, and
values that grouping must treat alike."""

import random

import pytest
from pyspark.sql import functions as F

from raretab.operators import dedup as D
from raretab.operators import density
from raretab.operators.encode import fit_label_codes
from raretab.operators import prefix
from raretab.operators import profile as PR


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("shape", ["even", "one spot", "infinite", "equal"])
def test_two_levels_equal_a_plain_sum(spark, monkeypatch, shape, descending):
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 5)
    rng = random.Random(3)
    value = {"even": lambda i: float(i), "one spot": lambda i: 1.0 + 1e-9 * i if i % 10 else 1e6 * i,
             "infinite": lambda i: float("inf") if i == 7 else float("-inf") if i == 8 else rng.gauss(0, 1),
             "equal": lambda i: 4.0}[shape]
    rows = sorted({(p, value(i)) for p in "ab" for i in range(300)})
    df = spark.createDataFrame([(p, v, rng.randint(0, 9)) for p, v in rows], "p string, v double, w long").repartition(4)
    bucketed = prefix.with_quantile_buckets(df, "v", 4, descending)
    order = F.col("v").desc() if descending else F.col("v")
    got = prefix.prefix_before(df, ["p"], ["v"], ["w"], n_buckets=4, descending=descending, with_totals=True)
    seen = {}
    for r in sorted(got.collect(), key=lambda r: (r["p"], -r["v"] if descending else r["v"])):
        assert r["w_before"] == seen.get(r["p"], 0)
        seen[r["p"]] = r["w_before"] + r["w"]
    assert all(r["w_total"] == seen[r["p"]] for r in got.collect())
    steps = bucketed.orderBy(order).select(prefix.BUCKET).collect()
    assert steps == sorted(steps)
    if shape == "even":                                 # 600 rows in buckets of about 5, not in 4
        assert bucketed.groupBy(prefix.BUCKET).count().agg(F.max("count")).first()[0] <= 12


def test_nan_and_null_are_one_row(spark):
    rows = [(1, None, "x"), (2, float("nan"), "x"), (3, 1.0, "x"), (4, float("nan"), None), (5, None, None), (6, 1.0, "x")]
    df = spark.createDataFrame(rows, "id long, v double, s string")
    got = D.dedup_with_counts(df, "id").orderBy("id").collect()
    assert [(r["id"], r["v"], r["s"], r["_copies"]) for r in got] == [(1, None, "x", 2), (3, 1.0, "x", 2), (4, None, None, 2)]


def test_correlation_of_missing_and_constant_columns(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, float("nan"), 5.0), (4.0, 1.0, 5.0), (5.0, 7.0, 5.0)]
    got = {(r["col_i"], r["col_j"]): r["r"] for r in PR.correlation_matrix(
        spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(69 / (78 * 186) ** 0.5, abs=1e-12)   # rows 1, 4, 5
    assert got["a", "c"] is None and got["c", "c"] == 1.0


@pytest.fixture
def many_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_label_codes_of_large_vocabularies(spark, many_partitions):
    """Codes follow the byte order over several range partitions; long shared
    prefixes, accents, empty and missing values."""
    rows = [(f"a long shared prefix {i * 7919 % 3000}", None if i % 50 == 0 else chr(0x61 + i % 700) + str(i % 3))
            for i in range(3000)] + [("", "")]
    df = spark.createDataFrame(rows, "u string, v string")
    got = {(r["column"], r["value"]): r["code"] for r in fit_label_codes(df, ["u", "v"]).collect()}
    for k, c in enumerate("uv"):
        values = sorted({"nan" if r[k] is None else r[k] for r in rows}, key=str.encode)
        assert [got.pop((c, value)) for value in values] == list(range(len(values)))
    assert not got


def test_frequency_ranks_over_partitions(spark, many_partitions):
    rows = [(f"level {i % 401}" if i % 13 else None, i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "c string, y int")
    got = {r["level"]: r["freq_rank"] for r in PR.category_counts(df, ["c"], "y").collect()}
    count = {}
    for level, _ in rows:
        count[level] = count.get(level, 0) + 1
    want = sorted(count, key=lambda x: (-count[x], x is None, x or ""))
    assert got == {level: i + 1 for i, level in enumerate(want)}


def test_density_with_values_far_apart(spark):
    """Grid points out of every kernel's reach have density zero; the others
    equal the plain sum."""
    import math
    values = [i / 1000 for i in range(4000)] * 5 + [4000.0, -2500.0]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, y int")
    got = density.kde_grid(df, ["v"], "y").collect()
    n, mean = len(values), math.fsum(values) / len(values)
    h = math.sqrt(math.fsum((v - mean) ** 2 for v in values) / (n - 1)) * n ** -0.2
    assert len(got) == 200 and sum(r["density"] == 0 for r in got) > 100
    for r in got:
        plain = math.fsum(math.exp(-((r["x"] - v) / h) ** 2 / 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert abs(r["density"] - plain) < 1e-12
