"""Inline edge tables: bins, nulls, ties, zero division, allocation."""

import pytest
from pyspark.sql import functions as F

from raretab.functions.exprs import age_bin
from raretab.operators import evaluate as EV
from raretab.operators.dedup import dedup, dedup_summary, dedup_with_counts
from raretab.operators.encode import apply_label_codes, fit_label_codes
from raretab.operators.impute import fit_median_imputer
from raretab.operators.oversample import knn_within, oversample, plan_oversampling
from raretab.operators.quantiles import grouped_median, grouped_quantiles
from raretab.operators.splits import holdout_flag, stratified_folds, three_way_split
from raretab.operators.stats import chi_square, mann_whitney, rank_tests, with_rank_p


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (40.0,), (40.1,), (60.0,), (200.0,), (201.0,), (None,)],
                               "age double")
    got = [r[0] for r in df.select(age_bin("age")).collect()]
    assert got == [None, "young", "young", "middle", "middle", "senior", None, None]


def test_even_count_median_and_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    assert grouped_median(df, [], "v").first()["median"] == 2.5
    q = grouped_quantiles(df, [], "v", [0.25, 0.5, 0.75], ["a", "b", "c"]).first()
    assert (q["a"], q["b"], q["c"]) == (1.75, 2.5, 3.25)


def test_median_many_buckets_hot_group(spark):
    # one group holds most rows and many tied values
    rows = [("hot", float(i % 7)) for i in range(3000)] + [("cold", 1.0), ("cold", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    m = {r["g"]: r["median"] for r in grouped_median(df, ["g"], "v", n_buckets=16).collect()}
    vals = sorted(float(i % 7) for i in range(3000))
    assert m["hot"] == (vals[1499] + vals[1500]) / 2
    assert m["cold"] == 5.0


def test_imputer_fallbacks(spark):
    train = spark.createDataFrame(
        [(1, "M", 30.0, 20.0), (2, "M", 30.0, 22.0), (3, "F", 70.0, None), (4, "F", 50.0, 40.0),
         (5, None, 30.0, 50.0)], "id int, gender string, age double, bmi_value double")
    apply = spark.createDataFrame(
        [(10, "M", 35.0, None), (11, None, 35.0, None), (12, "F", 70.0, None), (13, "X", 10.0, None)],
        "id int, gender string, age double, bmi_value double")
    m = fit_median_imputer(train)
    got = {r["id"]: r["bmi_value"] for r in m.transform(apply).collect()}
    # global median of 20, 22, 40, 50 = 31
    assert got == {10: 21.0, 11: 31.0, 12: 31.0, 13: 31.0}
    strict = fit_median_imputer(train, strict_group=True)
    got2 = {r["id"]: r["bmi_value"] for r in strict.transform(apply).collect()}
    assert got2[12] is None and got2[10] == 21.0


def test_dedup_nulls_equal_keep_smallest_id(spark):
    df = spark.createDataFrame([(5, "a", None), (3, "a", None), (4, "b", 1.0)],
                               "id int, k string, v double")
    got = sorted(tuple(r) for r in dedup(df, "id").collect())
    assert got == [(3, "a", None), (4, "b", 1.0)]
    s = dedup_summary(dedup_with_counts(df, "id")).first()
    assert (s["rows_before"], s["rows_after"], s["rows_removed"]) == (3, 2, 1)


def test_unseen_category_minus_one(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    codes = fit_label_codes(train, ["c"])
    got = {r["value"]: r["code"] for r in codes.collect()}
    assert got == {"a": 0, "b": 1, "nan": 2}
    test = spark.createDataFrame([("c",), ("b",)], "c string")
    assert [r[0] for r in apply_label_codes(test, codes, ["c"]).collect()] == [-1, 1]


def _scored(spark, rows):
    return spark.createDataFrame([("m", i, y, p) for i, (y, p) in enumerate(rows)],
                                 "model string, row_id long, y int, p double")


def test_zero_division_and_default_threshold(spark):
    s = _scored(spark, [(0, 0.001), (1, 0.002), (0, 0.003)])
    sw = EV.threshold_sweep(s).where(F.col("k") == 50).first()
    assert (sw["tp"], sw["fp"], sw["precision"], sw["f1"]) == (0, 0, 0.0, 0.0)
    t = {r["mode"]: r["threshold"] for r in EV.tune_thresholds(EV.threshold_sweep(s)).collect()}
    assert t == {"High Sensitivity": 0.5, "Balanced": 0.5}


def test_threshold_at_score_is_flagged_and_ties_pick_lowest(spark):
    s = _scored(spark, [(1, 0.29), (0, 0.1)])
    sw = {r["k"]: r for r in EV.threshold_sweep(s).collect()}
    assert sw[29]["tp"] == 1 and sw[30]["tp"] == 0
    t = {r["mode"]: r["threshold"] for r in EV.tune_thresholds(EV.threshold_sweep(s)).collect()}
    # recall 1 with precision >= floor from 0.01 up to 0.29: the lowest wins
    assert t["High Sensitivity"] == 0.01
    assert t["Balanced"] == 0.11  # f1 = 1 first reached when the negative drops out


def test_auc_and_ap_small(spark):
    s = _scored(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)])
    auc = EV.roc_auc(s).first()["auc_roc"]
    # pairs: (0.9 > all 3) + (0.7 > 0.1, = 0.7 half, < 0.8) = 3 + 1.5 -> 4.5 / 6
    assert auc == pytest.approx(0.75)
    ap = EV.average_precision(s).first()["auc_pr"]
    # thresholds 0.9: P=1, R=.5 ; 0.8: no recall gain ; 0.7: P=2/4, R=1
    assert ap == pytest.approx(0.5 * 1 + 0.5 * 0.5)


def test_split_allocation_published_sizes(spark):
    # 4861 negatives, 249 positives -> test 972/50, validation 778/40, train 3111/159
    df = spark.range(5110).select(F.col("id"), (F.col("id") < 249).cast("int").alias("y"))
    sp = three_way_split(df, "y", "id", 0.2, 0.2, seed=7)
    got = {(r["split"], r["y"]): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    assert got == {("test", 0): 972, ("test", 1): 50, ("validation", 0): 778,
                   ("validation", 1): 40, ("train", 0): 3111, ("train", 1): 159}


def test_split_partition_invariant_and_folds_balanced(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 9 == 0).cast("int").alias("y"))
    a = {r["id"] for r in holdout_flag(df, "y", "id", 0.3, bits=4).where("holdout").collect()}
    b = {r["id"] for r in holdout_flag(df.repartition(13), "y", "id", 0.3, bits=10)
         .where("holdout").collect()}
    assert a == b
    f = stratified_folds(df, "y", "id", k=5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        c = [r["count"] for r in f if r["y"] == y]
        assert max(c) - min(c) <= 1


def test_chi_square_yates_only_2x2(spark):
    rows = [("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 20 + [("b", 0)] * 10
    df = spark.createDataFrame(rows, "f string, y int")
    r = chi_square(df, ["f"], "y").first()
    # expected 15 each, |O - E| = 5 -> (4.5^2 / 15) * 4 = 5.4 with Yates
    assert r["dof"] == 1 and r["statistic"] == pytest.approx(5.4)
    rows3 = rows + [("c", 1)] * 5 + [("c", 0)] * 5
    r3 = chi_square(spark.createDataFrame(rows3, "f string, y int"), ["f"], "y").first()
    assert r3["dof"] == 2


def test_mann_whitney_u_of_class0(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "x double, y int")
    r = mann_whitney(df, ["x"], "y").first()
    assert r["u_stat"] == 0.0 and r["n0"] == 2 and r["n1"] == 2


def test_oversample_stops_and_duplicates(spark):
    one = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 1.0], 0), (3, [2.0, 2.0], 0)],
                                "id long, features array<double>, y int")
    out = oversample(spark, one, "id", "features", "y")
    assert out.count() == 3 and out.first()["origin"] == "input"
    dup = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, [5.0, 5.0], 1)]
                                + [(10 + i, [float(i), 1.0], 0) for i in range(30)],
                                "id long, features array<double>, y int")
    plan = plan_oversampling(dup, "y")
    k = knn_within(dup.where("y = 1"), "id", "features", 1, plan.n_min)
    nn = {r["id"]: r["nbr_id"] for r in k.collect()}
    assert nn[1] == 2 and nn[2] == 1


def test_synthetic_points_on_segment(spark):
    pts = [(i, [float(i), float(i * i % 7)], 1) for i in range(6)] + \
          [(100 + i, [float(i), -1.0], 0) for i in range(40)]
    df = spark.createDataFrame(pts, "id long, features array<double>, y int")
    from raretab.operators.oversample import synthetic_rows
    plan = plan_oversampling(df, "y")
    src = {i: v for i, v, y in pts}
    for r in synthetic_rows(spark, df, "id", "features", "y", plan).collect():
        a, b, g = src[r["src_id"]], src[r["nbr_id"]], r["gap"]
        assert 0 <= g < 1
        assert r["features"] == pytest.approx([x + g * (z - x) for x, z in zip(a, b)])


def test_blocked_knn_is_exact(spark):
    import random
    rnd = random.Random(3)
    pts = [(i, [rnd.random() for _ in range(4)]) for i in range(600)]
    # a tight cluster of duplicates and near-duplicates (hot region)
    pts += [(1000 + i, [0.5, 0.5, 0.5, 0.5 + (i % 3) * 1e-9]) for i in range(150)]
    df = spark.createDataFrame(pts, "id long, features array<double>")
    n = len(pts)
    exact = {(r["id"], r["nbr_id"], r["rank"]) for r in knn_within(df, "id", "features", 3, n).collect()}
    blocked = {(r["id"], r["nbr_id"], r["rank"]) for r in
               knn_within(df, "id", "features", 3, n, block_size=64, n_projections=3).collect()}
    assert len(exact) == 3 * n
    assert blocked == exact


def test_partition_invariance_median_and_auc(spark):
    from raretab.operators import prefix
    rows = [(("g%d" % (i % 3)), float((i * 37) % 101) / 7.0, int(i % 5 == 0)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double, y int")
    sc = df.select(F.lit("m").alias("model"), F.monotonically_increasing_id().alias("row_id"),
                   "y", F.col("v").alias("p"))
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    saved = prefix.ROWS_PER_BUCKET
    try:
        for parts, rpb in ((1, 100_000), (16, 9)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            prefix.ROWS_PER_BUCKET = rpb
            med = sorted(tuple(r) for r in grouped_median(df.repartition(parts), ["g"], "v").collect())
            auc = EV.roc_auc(sc.repartition(parts)).first()["auc_roc"]
            out.append((med, auc))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        prefix.ROWS_PER_BUCKET = saved
    assert out[0] == out[1]


def test_split_multi_bucket_matches_single_bucket(spark, monkeypatch):
    from raretab.operators import prefix
    df = spark.range(5110).select(F.col("id"), (F.col("id") < 249).cast("int").alias("y"))
    one = {(r["id"], r["split"]) for r in three_way_split(df, "y", "id", 0.2, 0.2, seed=7).collect()}
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 50)
    many = {(r["id"], r["split"]) for r in three_way_split(df, "y", "id", 0.2, 0.2, seed=7).collect()}
    assert one == many
    f1 = stratified_folds(df, "y", "id", k=5).collect()
    assert len(f1) == 5110


def test_rank_tests_of_many_parts(spark):
    """Exact p for a tiny part without ties, the normal one with ties, none for
    a part with one class."""
    rows = ([("clear", float(i), int(i < 4)) for i in range(9)] + [("tied", float(i // 2), i % 2) for i in range(8)]
            + [("one class", 1.0, 0), ("one class", 2.0, 0), (None, 1.0, 0), (None, 2.0, 1)])
    df = spark.createDataFrame(rows, "k string, value double, y int")
    got = {r["k"]: r for r in with_rank_p(rank_tests(df, ["k"])).collect()}
    assert got["clear"]["p_value"] == pytest.approx(2 / 126) and not got["clear"]["tied"]
    assert got["tied"]["tied"] and got["tied"]["p_value"] == 1.0
    assert got["one class"]["p_value"] is None and got["one class"]["z"] is None
    assert got[None]["p_value"] == 1.0 and (got[None]["n0"], got[None]["n1"]) == (1, 1)


def _brute_neighbours(rows, k):
    """By id: a missing distance first, NaN last, ties by id; ids may repeat."""
    import math
    found = {}
    for a, x in rows:
        for b, y in rows:
            if a is None or b is None or a == b:
                continue
            missing = x is None or y is None or len(x) != len(y) or None in x or None in y
            d = None if missing else sum((u - v) * (u - v) for u, v in zip(x, y))
            found.setdefault(a, []).append((0 if missing else 2 if math.isnan(d) else 1, d if d == d and not missing else 0, b))
    return {(a, b, i + 1) for a, t in found.items() for i, (_, _, b) in enumerate(sorted(t)[:k])}


def test_knn_odd_vectors_and_repeated_ids(spark):
    import random
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) * s for s in (1e5, 100.0, 1.0, 1.0, 0.1)]) for i in range(300)]
    rows += rows[:7] + [(None, rows[0][1]), (900, None), (901, [1.0] * 3), (902, [1.0, None, 0.0, 0.0, 0.0]),
                        (903, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id long, features array<double>").repartition(5)
    expected = _brute_neighbours(rows, 4)
    for block in (4096, 32):
        got = knn_within(df, "id", "features", 4, len(rows), block_size=block).collect()
        assert {(r["id"], r["nbr_id"], r["rank"]) for r in got} == expected
        assert len(got) == len(expected)


def test_knn_of_many_rows(spark):
    """20,000 rows: as shuffled pairs of vectors, blocks along four directions
    are some 70 GB; here only rows and their k neighbours leave a task."""
    import numpy as np
    n, k = 20_000, 3
    x = np.random.default_rng(8).normal(size=(n, 6))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, features array<double>")
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in knn_within(df, "id", "features", k, n).collect()}
    assert len(got) == n * k
    for i in range(0, n, 97):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[i, j + 1] for j in range(k)] == np.argsort(d, kind="stable")[:k].tolist()


def test_oversample_counts_of_many_rows(spark):
    """A minority of several blocks: every draw finds its base and its neighbour."""
    df = spark.range(70_000).selectExpr(
        "id", "cast(id % 7 = 0 as int) as y", "transform(sequence(1, 6), j -> hash(id, j) / 2147483648D) as features")
    plan = plan_oversampling(df, "y")
    assert plan.n_min == 10_000 and plan.n_gen == 11_000
    counts = {(r["origin"], r["y"]): r["count"] for r in
              oversample(spark, df, "id", "features", "y").groupBy("origin", "y").count().collect()}
    assert counts == {("majority", 0): 60_000, ("minority", 1): 10_000, ("synthetic", 1): 11_000}


def test_neighbour_search_crosses_blocks(spark):
    """Blocks meet by a cross join: no vector is shuffled once for every block that it asks."""
    import numpy as np
    x = np.random.default_rng(9).normal(size=(400, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, features array<double>")
    found = knn_within(df, "id", "features", 3, 400, block_size=32)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    got = {(r["id"], r["rank"]): r["nbr_id"] for r in found.collect()}
    for i in range(400):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[i, j + 1] for j in range(3)] == np.argsort(d, kind="stable")[:3].tolist()
