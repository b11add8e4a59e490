"""DuckDB oracle statements, one per registered query (same names).

Written independently of the Spark code: plain windows and aggregates over
the fixture CTEs of ``fixture_sql``.
"""

from __future__ import annotations

from ..sources.fixture_sql import with_fixtures

ORACLES: dict[str, str] = {}

PATIENT_COLS = ("gender, age, age_group, has_hypertension, has_heart_disease, marital_status, "
                "employment_type, residence, glucose_level, high_glucose, bmi_value, bmi_category, "
                "smoking_habit, risk_score, stroke_event")

AGE_BIN = ("CASE WHEN age > 0 AND age <= 40 THEN 'young' WHEN age > 40 AND age <= 60 THEN 'middle' "
           "WHEN age > 60 AND age <= 200 THEN 'senior' END")


def median_sql(src: str, keys: list[str], value: str, out: str) -> str:
    """Exact median as the mean of the two middle values."""
    k = ", ".join(keys)
    part = f"PARTITION BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    return f"""
      SELECT {sel}(max(CASE WHEN rn = (n + 1) // 2 THEN v END)
                 + max(CASE WHEN rn = n // 2 + 1 THEN v END)) / 2 AS {out}
      FROM (SELECT {sel}CAST({value} AS DOUBLE) AS v,
                   row_number() OVER ({part} ORDER BY {value}) AS rn,
                   count(*) OVER ({part}) AS n
            FROM {src} WHERE {value} IS NOT NULL) t
      {grp}"""


DEDUP = f"SELECT min(patient_id) AS patient_id, {PATIENT_COLS} FROM patients_raw GROUP BY ALL"
DEDUP_COUNTS = (f"SELECT min(patient_id) AS patient_id, {PATIENT_COLS}, count(*) AS _copies "
                f"FROM patients_raw GROUP BY ALL")

CLEAN = [
    ("dd", DEDUP),
    ("b", f"SELECT *, {AGE_BIN} AS _bin FROM dd"),
    ("gm", median_sql("(SELECT * FROM b WHERE gender IS NOT NULL AND _bin IS NOT NULL)",
                      ["gender", "_bin"], "bmi_value", "_gm")),
    ("gmed", median_sql("dd", [], "bmi_value", "_glob")),
    ("imp", f"""SELECT b.patient_id, b.gender, b.age, b.age_group, b.has_hypertension,
                 b.has_heart_disease, b.marital_status, b.employment_type, b.residence,
                 b.glucose_level, b.high_glucose,
                 coalesce(b.bmi_value, gm._gm, gmed._glob) AS bmi_value,
                 b.bmi_category, b.smoking_habit, b.risk_score, b.stroke_event
              FROM b LEFT JOIN gm ON b.gender = gm.gender AND b._bin = gm._bin, gmed"""),
    ("cleaned", """SELECT *, age * age AS age_squared,
                     age * has_hypertension AS age_x_hypertension,
                     age * has_heart_disease AS age_x_heart,
                     glucose_level * has_hypertension AS glucose_x_hypertension,
                     age * (has_hypertension + has_heart_disease) AS age_risk_score
                   FROM imp"""),
]

ORACLES["clean_table"] = with_fixtures("SELECT * FROM cleaned", "patients_raw", extra=CLEAN)

ORACLES["clean_prevalence_by_bin"] = with_fixtures(f"""
  SELECT {AGE_BIN} AS age_bin, CAST(count(*) AS BIGINT) AS n_rows,
         CAST(sum(stroke_event) AS BIGINT) AS n_pos,
         round(avg(CAST(stroke_event AS DOUBLE)), 10) AS prevalence,
         round(avg(bmi_value), 8) AS mean_bmi
  FROM cleaned GROUP BY 1""", "patients_raw", extra=CLEAN)

ORACLES["dedup_rows"] = with_fixtures(DEDUP, "patients_raw")

ORACLES["dedup_summary"] = with_fixtures("""
  SELECT CAST(sum(_copies) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
         CAST(sum(_copies - 1) AS BIGINT) AS rows_removed FROM dd""",
                                         "patients_raw", extra=[("dd", DEDUP_COUNTS)])

ORACLES["dedup_removed_by_class"] = with_fixtures("""
  SELECT stroke_event, CAST(sum(_copies) AS BIGINT) AS rows_before,
         CAST(count(*) AS BIGINT) AS rows_after, CAST(sum(_copies - 1) AS BIGINT) AS rows_removed
  FROM dd GROUP BY stroke_event""", "patients_raw", extra=[("dd", DEDUP_COUNTS)])

ORACLES["dedup_documents"] = """
  SELECT CAST(sum(c) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after,
         CAST(sum(c - 1) AS BIGINT) AS rows_removed
  FROM (SELECT text, lang, source, n_chars, count(*) AS c FROM documents GROUP BY ALL) t"""

ORACLES["grouped_median_bmi"] = with_fixtures(
    median_sql(f"(SELECT *, {AGE_BIN} AS age_bin FROM patients)", ["gender", "age_bin"],
               "bmi_value", "median_bmi"), "patients")

ORACLES["global_median_bmi"] = with_fixtures(
    median_sql("patients", [], "bmi_value", "median_bmi"), "patients")

ORACLES["grouped_median_lineitem"] = median_sql(
    "lineitem", ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price")


# --- step 2: profiling ------------------------------------------------------

NUM = ["age", "glucose_level", "bmi_value"]
CAT = ["gender", "smoking_habit", "employment_type", "residence", "has_hypertension",
       "has_heart_disease"]
CORR_COLS = ["age", "has_hypertension", "has_heart_disease", "marital_status", "glucose_level",
             "bmi_value", "stroke_event"]
PATIENT_ALL = ["patient_id", *[c.strip() for c in PATIENT_COLS.split(",")]]


def unpivot_num_sql(src: str, feats: list[str], target: str = "stroke_event") -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST({target} AS INTEGER) AS y "
        f"FROM {src} WHERE {f} IS NOT NULL" for f in feats)


def unpivot_lvl_sql(src: str, feats: list[str], target: str = "stroke_event",
                    keep_null: bool = False) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, CAST({target} AS INTEGER) AS y "
        f"FROM {src}" + ("" if keep_null else f" WHERE {f} IS NOT NULL") for f in feats)


ORACLES["class_counts"] = with_fixtures("""
  SELECT stroke_event AS class, CAST(count(*) AS BIGINT) AS count,
         CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share
  FROM patients GROUP BY stroke_event""", "patients")

ORACLES["prevalence"] = with_fixtures("""
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(stroke_event), 0) AS BIGINT) AS n_pos,
         coalesce(avg(CAST(stroke_event AS DOUBLE)), 0.0) AS prevalence FROM cleaned""",
                                      "patients_raw", extra=CLEAN)

ORACLES["class_ratio"] = with_fixtures("""
  SELECT sum(CASE WHEN stroke_event = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE
         / greatest(sum(CASE WHEN stroke_event = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE, 1.0::DOUBLE)
         AS class_ratio FROM patients""", "patients")

ORACLES["balanced_weights"] = with_fixtures("""
  SELECT class, CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight
  FROM (SELECT stroke_event AS class, count(*) AS n FROM patients GROUP BY 1) t""", "patients")

ORACLES["class_extremes"] = with_fixtures("""
  SELECT class, count,
         first(class ORDER BY count, class) OVER () AS min_class,
         first(class ORDER BY count DESC, class) OVER () AS max_class
  FROM (SELECT stroke_event AS class, CAST(count(*) AS BIGINT) AS count FROM patients GROUP BY 1) t""",
                                          "patients")

ORACLES["null_counts"] = with_fixtures(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_null, "
        f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) AS null_rate FROM patients"
        for c in PATIENT_ALL) + ") t WHERE n_null > 0", "patients")

ORACLES["contingency_long"] = with_fixtures(f"""
  SELECT feature, level, y, CAST(count(*) AS BIGINT) AS count
  FROM ({unpivot_lvl_sql("patients", CAT)}) u GROUP BY ALL""", "patients")

ORACLES["category_counts"] = with_fixtures(f"""
  SELECT c.feature, c.level,
         r.freq_rank, c.y, c.count
  FROM (SELECT feature, level, y, CAST(count(*) AS BIGINT) AS count
        FROM ({unpivot_lvl_sql("patients", ["gender", "employment_type", "residence", "smoking_habit"], keep_null=True)}) u
        GROUP BY ALL) c
  JOIN (SELECT feature, level, sum(count) AS tot FROM (
          SELECT feature, level, count(*) AS count
          FROM ({unpivot_lvl_sql("patients", ["gender", "employment_type", "residence", "smoking_habit"], keep_null=True)}) u2
          GROUP BY ALL) z GROUP BY ALL) lt
    ON c.feature = lt.feature AND c.level IS NOT DISTINCT FROM lt.level
  JOIN (SELECT feature, level,
               row_number() OVER (PARTITION BY feature ORDER BY tot DESC, level ASC NULLS LAST) AS freq_rank
        FROM (SELECT feature, level, count(*) AS tot
              FROM ({unpivot_lvl_sql("patients", ["gender", "employment_type", "residence", "smoking_habit"], keep_null=True)}) u3
              GROUP BY ALL) q) r
    ON c.feature = r.feature AND c.level IS NOT DISTINCT FROM r.level""", "patients")

ORACLES["level_prevalence"] = with_fixtures(f"""
  SELECT feature, level, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS n_pos,
         avg(CAST(y AS DOUBLE)) AS prevalence
  FROM ({unpivot_lvl_sql("patients", CAT)}) u GROUP BY ALL""", "patients")

ORACLES["class_means"] = with_fixtures(f"""
  SELECT feature, round(avg(value) FILTER (WHERE y = 0), 8) AS mean_neg,
         round(avg(value) FILTER (WHERE y = 1), 8) AS mean_pos,
         round(avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0), 8) AS mean_diff
  FROM ({unpivot_num_sql("patients", NUM)}) u GROUP BY feature""", "patients")


def _lerp_sql(q: float, name: str) -> str:
    h = f"((n - 1) * {q}::DOUBLE)"
    a = f"max(CASE WHEN rn = CAST(floor({h}) AS BIGINT) + 1 THEN value END)"
    b = f"max(CASE WHEN rn = CAST(ceil({h}) AS BIGINT) + 1 THEN value END)"
    t = f"max({h} - floor({h}))"
    return (f"CASE WHEN {t} >= 0.5 THEN {b} - ({b} - {a}) * (1.0::DOUBLE - {t}) "
            f"ELSE {a} + ({b} - {a}) * {t} END AS {name}")


ORACLES["box_summary"] = with_fixtures(f"""
  SELECT f.feature, f.y AS class, f.n, f.q1, f.median, f.q3,
         min(u.value) FILTER (WHERE u.value >= f.q1 - 1.5 * (f.q3 - f.q1)) AS whisker_lo,
         max(u.value) FILTER (WHERE u.value <= f.q3 + 1.5 * (f.q3 - f.q1)) AS whisker_hi,
         CAST(count(*) FILTER (WHERE u.value < f.q1 - 1.5 * (f.q3 - f.q1)
                                OR u.value > f.q3 + 1.5 * (f.q3 - f.q1)) AS BIGINT) AS n_outliers
  FROM ({unpivot_num_sql("patients", NUM)}) u
  JOIN (SELECT feature, y, max(n) AS n, {_lerp_sql(0.25, "q1")}, {_lerp_sql(0.5, "median")},
               {_lerp_sql(0.75, "q3")}
        FROM (SELECT feature, y, value,
                     row_number() OVER (PARTITION BY feature, y ORDER BY value) AS rn,
                     count(*) OVER (PARTITION BY feature, y) AS n
              FROM ({unpivot_num_sql("patients", NUM)}) v) r
        GROUP BY feature, y) f
    ON u.feature = f.feature AND u.y = f.y
  GROUP BY f.feature, f.y, f.n, f.q1, f.median, f.q3""", "patients")

def correlation_sql(cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_i, '{b}' AS col_j, " + (
            "1.0::DOUBLE" if a == b else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8)") + " AS r"
        + ("" if a == b else " FROM patients") for a in cols for b in cols)


ORACLES["correlation_by_type"] = with_fixtures(correlation_sql(
    ["age", "has_hypertension", "has_heart_disease", "marital_status", "glucose_level", "bmi_value",
     "high_glucose", "risk_score", "stroke_event"]), "patients")

ORACLES["chart_labels"] = with_fixtures("""
  SELECT stroke_event AS class, 'Stroke Event' AS title,
         printf('%d\n(%.1f%%)', count(*), count(*) * 100.0 / sum(count(*)) OVER ()) AS label
  FROM patients GROUP BY stroke_event""", "patients")

_pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
ORACLES["correlation_matrix"] = with_fixtures(
    " UNION ALL ".join(
        [f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) AS r FROM patients"
         for a, b in _pairs]
        + [f"SELECT '{b}' AS col_i, '{a}' AS col_j, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 8) AS r FROM patients"
           for a, b in _pairs]
        + [f"SELECT '{c}' AS col_i, '{c}' AS col_j, 1.0::DOUBLE AS r" for c in CORR_COLS]),
    "patients")

ORACLES["target_correlations"] = with_fixtures(
    "SELECT feature, r, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(stroke_event AS DOUBLE)), 8) AS r "
        f"FROM patients" for c in CORR_COLS if c != "stroke_event") + ") t", "patients")

ORACLES["snapshot"] = with_fixtures("""
  SELECT * FROM (
    SELECT 1 AS ord, 'Rows' AS Metric, format('{:,}', count(*)) AS Value FROM cleaned
    UNION ALL SELECT 2, 'Stroke cases', format('{:,}', CAST(sum(stroke_event) AS BIGINT)) FROM cleaned
    UNION ALL SELECT 3, 'Stroke prevalence', printf('%.2f%%', avg(CAST(stroke_event AS DOUBLE)) * 100) FROM cleaned
    UNION ALL SELECT 4, 'Source file', 'patients_cleaned') t""", "patients_raw", extra=CLEAN)

RANKS_SQL = """
  SELECT feature, value, n0, n1, t,
         CAST(coalesce(sum(t) OVER (PARTITION BY feature ORDER BY value
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           + (t + 1) / 2.0::DOUBLE AS avg_rank
  FROM (SELECT feature, value, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
               CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
               CAST(count(*) AS BIGINT) AS t
        FROM ({src}) u GROUP BY feature, value) vc"""

ORACLES["avg_ranks_age"] = with_fixtures(RANKS_SQL.format(src=unpivot_num_sql("patients", ["age"])),
                                         "patients")

ORACLES["mann_whitney"] = with_fixtures(f"""
  SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, u0 AS u_stat,
         round((greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5)
               / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))), 9) AS z
  FROM (SELECT feature, CAST(sum(n0) AS DOUBLE) AS n0, CAST(sum(n1) AS DOUBLE) AS n1,
               sum(n0 * avg_rank) - CAST(sum(n0) AS DOUBLE) * (CAST(sum(n0) AS DOUBLE) + 1) / 2 AS u0,
               sum(CAST(t AS DOUBLE) * t * t - t) AS ties
        FROM ({RANKS_SQL.format(src=unpivot_num_sql("patients", NUM))}) r GROUP BY feature) g""",
                                        "patients")

CHI_CTES = [
    ("obs", f"SELECT feature, level, y, count(*) AS o FROM ({unpivot_lvl_sql('patients', CAT)}) u GROUP BY ALL"),
    ("rws", "SELECT feature, level, sum(o) AS r_tot FROM obs GROUP BY ALL"),
    ("cls", "SELECT feature, y, sum(o) AS c_tot FROM obs GROUP BY ALL"),
    ("dims", """SELECT r.feature, r.n_levels, r.n, c.n_classes FROM
             (SELECT feature, count(*) AS n_levels, sum(r_tot) AS n FROM rws GROUP BY feature) r
             JOIN (SELECT feature, count(*) AS n_classes FROM cls GROUP BY feature) c USING (feature)"""),
    ("cells", """SELECT rws.feature, rws.level, cls.y, coalesce(obs.o, 0) AS o,
                   CAST(r_tot AS DOUBLE) * c_tot / n AS e,
                   (n_levels - 1) * (n_classes - 1) AS dof
            FROM rws JOIN cls USING (feature) JOIN dims USING (feature)
            LEFT JOIN obs ON obs.feature = rws.feature AND obs.level = rws.level AND obs.y = cls.y"""),
]
ORACLES["chi_square"] = with_fixtures("""
  SELECT feature,
         round(sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 9)
           AS statistic,
         CAST(max(dof) AS INTEGER) AS dof
  FROM cells GROUP BY feature""", "patients", extra=CHI_CTES)

def erfc_sql(x: str) -> str:
    """erfc for x >= 0: power series below 2, continued fraction from 2 on."""
    series = (f"1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), "
              f"lambda n: power(-1.0, n) * power({x}, 2 * n + 1) / (gamma(n + 1.0) * (2 * n + 1))))")
    steps = ", ".join(str(float(k)) for k in range(120, 0, -1))
    fraction = f"list_reduce([1.0, {steps}], lambda a, k: 1.0 + k / (2 * {x} * {x}) / a)"
    return (f"CASE WHEN {x} < 2 THEN {series} "
            f"ELSE exp(-{x} * {x}) / ({x} * sqrt(pi())) / {fraction} END")


def chi2_tail_sql(x: str, dof: str) -> str:
    """Upper tail by the closed forms of 1 to 4 degrees of freedom."""
    root = f"sqrt({x} / 2)"
    return (f"CASE {dof} WHEN 1 THEN {erfc_sql(root)} WHEN 2 THEN exp(-{x} / 2) "
            f"WHEN 3 THEN {erfc_sql(root)} + sqrt(2 * {x} / pi()) * exp(-{x} / 2) "
            f"WHEN 4 THEN exp(-{x} / 2) * (1 + {x} / 2) END")


# p-values and their logarithms agree to far more digits than are kept here.
BATTERY = f"""
  SELECT Feature, Test, round(p, 12) AS p_value, round(statistic, 6) AS statistic,
         round(-log10(greatest(p, 1e-300)), 6) AS neg_log10_p
  FROM (SELECT feature AS Feature, 'Mann-Whitney U' AS Test, u_stat AS statistic,
               least(1.0, {erfc_sql("(greatest(z, 0) / sqrt(2.0))")}) AS p FROM mw
        UNION ALL
        SELECT feature, 'Chi-square', statistic, least(1.0, {chi2_tail_sql("statistic", "dof")}) FROM chi) b"""
CHI_EXACT = ("chi", """SELECT feature, sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e)
                         AS statistic, max(dof) AS dof FROM cells GROUP BY feature""")
MW_EXACT = ("mw", f"""SELECT feature, u0 AS u_stat,
         (greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5)
           / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))) AS z
  FROM (SELECT feature, CAST(sum(n0) AS DOUBLE) AS n0, CAST(sum(n1) AS DOUBLE) AS n1,
               sum(n0 * avg_rank) - CAST(sum(n0) AS DOUBLE) * (CAST(sum(n0) AS DOUBLE) + 1) / 2 AS u0,
               sum(CAST(t AS DOUBLE) * t * t - t) AS ties
        FROM ({RANKS_SQL.format(src=unpivot_num_sql("patients", NUM))}) r GROUP BY feature) g""")
ORACLES["test_battery"] = ORACLES["test_summary_sink"] = with_fixtures(
    BATTERY, "patients", extra=[*CHI_CTES, CHI_EXACT, MW_EXACT])


# --- step 3: splits, folds, permutation --------------------------------------

def _h(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT)"


def holdout_ctes(src: str, frac: float, salt: str, name: str) -> list[tuple[str, str]]:
    """Stratified hold-out flag ``is_hold`` for every row of ``src``."""
    p = f"{name}_"
    return [
        (f"{p}h", f"SELECT *, {_h('patient_id', '42:' + salt)} AS _h FROM {src}"),
        (f"{p}a", f"SELECT stroke_event, count(*) AS n_c, sum(count(*)) OVER () AS n FROM {p}h GROUP BY 1"),
        (f"{p}b", f"SELECT *, n - CAST(ceil(n * {frac}::DOUBLE) AS BIGINT) AS n_train FROM {p}a"),
        (f"{p}c", f"SELECT *, (n_train * n_c) // n AS base, (n_train * n_c) % n AS rem FROM {p}b"),
        (f"{p}d", f"""SELECT *, n_train - sum(base) OVER () AS need,
                        row_number() OVER (ORDER BY rem DESC, stroke_event) AS ord FROM {p}c"""),
        (f"{p}alloc", f"""SELECT stroke_event,
                            n_c - (base + CASE WHEN ord <= need THEN 1 ELSE 0 END) AS take_c FROM {p}d"""),
        (name, f"""SELECT r.* EXCLUDE (_h, rn), rn <= take_c AS is_hold
                  FROM (SELECT *, row_number() OVER (PARTITION BY stroke_event ORDER BY _h, patient_id) AS rn
                        FROM {p}h) r JOIN {p}alloc USING (stroke_event)"""),
    ]


SPLIT_CTES = (
    holdout_ctes("patients", 0.2, "test", "t1")
    + [("rest", "SELECT * EXCLUDE (is_hold) FROM t1 WHERE NOT is_hold")]
    + holdout_ctes("rest", 0.2, "validation", "t2")
    + [("splits", """SELECT * EXCLUDE (is_hold), 'test' AS split FROM t1 WHERE is_hold
                     UNION ALL
                     SELECT * EXCLUDE (is_hold), CASE WHEN is_hold THEN 'validation' ELSE 'train' END
                     FROM t2""")]
)

ORACLES["split_sizes"] = with_fixtures("""
  SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(stroke_event) AS BIGINT) AS n_pos,
         avg(CAST(stroke_event AS DOUBLE)) AS pos_rate FROM splits GROUP BY split""",
                                       "patients", extra=SPLIT_CTES)

ORACLES["split_membership"] = with_fixtures("SELECT patient_id, split FROM splits", "patients",
                                            extra=SPLIT_CTES)

FOLD_CTE = [("folds", f"""SELECT patient_id, stroke_event,
    CAST((row_number() OVER (ORDER BY stroke_event, {_h('patient_id', '42:fold')}, patient_id) - 1) % 5
         AS INTEGER) AS fold FROM patients""")]

ORACLES["fold_sizes"] = with_fixtures(
    "SELECT fold, stroke_event, CAST(count(*) AS BIGINT) AS n_rows FROM folds GROUP BY ALL",
    "patients", extra=FOLD_CTE)

ORACLES["fold_membership"] = with_fixtures("SELECT * FROM folds", "patients", extra=FOLD_CTE)

ORACLES["early_stop_sizes"] = with_fixtures("""
  SELECT is_hold AS is_validation, stroke_event, CAST(count(*) AS BIGINT) AS n_rows
  FROM es GROUP BY ALL""", "patients",
    extra=SPLIT_CTES + [("train_rows", "SELECT * EXCLUDE (split) FROM splits WHERE split = 'train'")]
    + holdout_ctes("train_rows", 0.12, "early_stop", "es"))

ORACLES["permuted_labels"] = with_fixtures(f"""
  SELECT a.patient_id, a.stroke_event, b.stroke_event AS y_perm
  FROM (SELECT patient_id, stroke_event,
               row_number() OVER (ORDER BY {_h('patient_id', '42:perm_rows')}, patient_id) AS r
        FROM patients) a
  JOIN (SELECT stroke_event,
               row_number() OVER (ORDER BY {_h('patient_id', '42:perm_labels')}, patient_id) AS r
        FROM patients) b ON a.r = b.r""", "patients")


# --- step 5: evaluation on formula scores ------------------------------------

VOTE = ("vote", """SELECT 'voting' AS model, row_id, y, list_reduce(list_prepend(0.0, list_sort(list(p))), lambda a, x: a + x) / count(p) AS p
                   FROM scored GROUP BY row_id, y""")
SV = ("sv", "SELECT * FROM scored UNION ALL SELECT * FROM vote")

SC_CTE = ("sc", """SELECT model, p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
                          sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY model, p""")
CUM_CTE = ("cum", """SELECT model, p, pos, neg,
                  sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tps,
                  sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS fps,
                  sum(pos) OVER (PARTITION BY model) AS PT, sum(neg) OVER (PARTITION BY model) AS NT
                  FROM sc""")


def _sd(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN 0.0::DOUBLE ELSE CAST({n} AS DOUBLE) / ({d}) END"


SWEEP = f"""
  SELECT model, k, threshold, tp, fp, fn, tn,
         {_sd('tp', 'tp + fp')} AS precision, {_sd('tp', 'tp + fn')} AS recall,
         {_sd('2 * tp', '2 * tp + fp + fn')} AS f1, {_sd('tp + tn', 'tp + tn + fp + fn')} AS accuracy
  FROM (SELECT s.model, CAST(t.k AS INTEGER) AS k, t.k / 100.0::DOUBLE AS threshold,
               CAST(count(*) FILTER (WHERE y = 1 AND p >= t.k / 100.0::DOUBLE) AS BIGINT) AS tp,
               CAST(count(*) FILTER (WHERE y <> 1 AND p >= t.k / 100.0::DOUBLE) AS BIGINT) AS fp,
               CAST(count(*) FILTER (WHERE y = 1 AND p < t.k / 100.0::DOUBLE) AS BIGINT) AS fn,
               CAST(count(*) FILTER (WHERE y <> 1 AND p < t.k / 100.0::DOUBLE) AS BIGINT) AS tn
        FROM sv s, range(1, 99) t(k) GROUP BY s.model, t.k) c"""

TUNED = """
  SELECT m.mode, a.model,
         coalesce((SELECT k FROM (SELECT k, CASE WHEN m.objective = 'recall' THEN recall ELSE f1 END AS sc
                                  FROM sweep w WHERE w.model = a.model AND w.precision >= m.min_precision) q
                   ORDER BY sc DESC, k ASC LIMIT 1) / 100.0::DOUBLE, 0.5::DOUBLE) AS threshold
  FROM (SELECT DISTINCT model FROM sv) a,
       (VALUES ('High Sensitivity', 0.08::DOUBLE, 'recall'), ('Balanced', 0.10::DOUBLE, 'f1'))
         m(mode, min_precision, objective)"""

CONF = f"""
  SELECT mode, model, threshold, tn, fp, fn, tp,
         {_sd('tp', 'tp + fp')} AS precision, {_sd('tp', 'tp + fn')} AS recall,
         {_sd('2 * tp', '2 * tp + fp + fn')} AS f1, {_sd('tp + tn', 'tp + tn + fp + fn')} AS accuracy
  FROM (SELECT t.mode, t.model, t.threshold,
               CAST(count(*) FILTER (WHERE y <> 1 AND p < t.threshold) AS BIGINT) AS tn,
               CAST(count(*) FILTER (WHERE y <> 1 AND p >= t.threshold) AS BIGINT) AS fp,
               CAST(count(*) FILTER (WHERE y = 1 AND p < t.threshold) AS BIGINT) AS fn,
               CAST(count(*) FILTER (WHERE y = 1 AND p >= t.threshold) AS BIGINT) AS tp
        FROM sv JOIN tuned t USING (model) GROUP BY t.mode, t.model, t.threshold) c"""

AUC = """
  SELECT model, sum(CAST(pos AS DOUBLE) * (nb + neg / 2.0::DOUBLE)) / (CAST(max(PT) AS DOUBLE) * max(NT)) AS auc_roc
  FROM (SELECT model, p, pos, neg,
               coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
               sum(pos) OVER (PARTITION BY model) AS PT, sum(neg) OVER (PARTITION BY model) AS NT
        FROM sc) r GROUP BY model"""

AP = """
  SELECT model, round(CASE WHEN max(PT) = 0 THEN 0.0::DOUBLE
                           ELSE sum(pos * (CAST(tps AS DOUBLE) / (tps + fps))) / max(PT) END, 10) AS auc_pr,
         CAST(max(PT) AS DOUBLE) / (max(PT) + max(NT)) AS baseline
  FROM cum GROUP BY model"""

RESULTS = """
  SELECT c.mode, c.model, c.threshold, a.auc_roc, ap.auc_pr, c.recall, c.precision, c.f1, c.accuracy
  FROM conf c JOIN auc a USING (model) JOIN ap USING (model)"""

EVAL_CTES = [VOTE, SV, (SC_CTE[0], SC_CTE[1].format(src="sv")), CUM_CTE, ("sweep", SWEEP),
             ("tuned", TUNED), ("conf", CONF), ("auc", AUC), ("ap", AP), ("results", RESULTS)]

ORACLES["soft_vote"] = with_fixtures("SELECT * FROM vote", "scored", extra=[VOTE])

ORACLES["wide_scores"] = with_fixtures("""
  SELECT row_id, y, first(p) FILTER (WHERE model = 'a') AS a, first(p) FILTER (WHERE model = 'b') AS b,
         first(p) FILTER (WHERE model = 'c') AS c FROM scored GROUP BY row_id, y""", "scored")

ORACLES["roc_auc"] = with_fixtures("SELECT * FROM auc", "scored", extra=EVAL_CTES)
ORACLES["average_precision"] = with_fixtures("SELECT * FROM ap", "scored", extra=EVAL_CTES)

ORACLES["roc_curve"] = with_fixtures(f"""
  SELECT model, p AS threshold, {_sd('fps', 'NT')} AS fpr, {_sd('tps', 'PT')} AS tpr
  FROM (SELECT *, lead(pos) OVER (PARTITION BY model ORDER BY p DESC) AS sp,
               lead(neg) OVER (PARTITION BY model ORDER BY p DESC) AS sn,
               row_number() OVER (PARTITION BY model ORDER BY p DESC) AS rn FROM cum) c
  WHERE rn = 1 OR sp IS NULL OR sp <> pos OR sn <> neg
  UNION ALL SELECT DISTINCT model, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM scored""",
                                     "scored", extra=[(SC_CTE[0], SC_CTE[1].format(src="scored")), CUM_CTE])

ORACLES["pr_curve"] = with_fixtures(f"""
  SELECT model, p AS threshold, {_sd('tps', 'tps + fps')} AS precision,
         CASE WHEN PT = 0 THEN 1.0::DOUBLE ELSE CAST(tps AS DOUBLE) / PT END AS recall FROM cum
  UNION ALL SELECT DISTINCT model, NULL::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM scored""",
                                    "scored", extra=[(SC_CTE[0], SC_CTE[1].format(src="scored")), CUM_CTE])

ORACLES["threshold_sweep"] = with_fixtures("SELECT * FROM sweep", "scored", extra=EVAL_CTES)
ORACLES["tuned_thresholds"] = with_fixtures("SELECT * FROM tuned", "scored", extra=EVAL_CTES)
ORACLES["confusion_at_tuned"] = with_fixtures("SELECT * FROM conf", "scored", extra=EVAL_CTES)
ORACLES["results_table"] = with_fixtures("SELECT * FROM results", "scored", extra=EVAL_CTES)

RESULTS_LONG = " UNION ALL ".join(
    f"SELECT mode, model, '{m}' AS metric, {m} AS value FROM results"
    for m in ("auc_roc", "auc_pr", "recall", "precision", "f1"))
ORACLES["results_long"] = with_fixtures(RESULTS_LONG, "scored", extra=EVAL_CTES)

ORACLES["best_by_metric"] = with_fixtures(f"""
  SELECT mode, metric, first(model ORDER BY value DESC, model) AS best_model, max(value) AS best_value
  FROM ({RESULTS_LONG}) l GROUP BY mode, metric""", "scored", extra=EVAL_CTES)

ORACLES["metric_matrix"] = with_fixtures(f"""
  SELECT mode, metric, first(value) FILTER (WHERE model = 'a') AS a,
         first(value) FILTER (WHERE model = 'b') AS b, first(value) FILTER (WHERE model = 'c') AS c,
         first(value) FILTER (WHERE model = 'voting') AS voting
  FROM ({RESULTS_LONG}) l GROUP BY mode, metric""", "scored", extra=EVAL_CTES)


# --- step 6: oversampling ------------------------------------------------------

DIST = ("list_reduce(list_transform(range(1, len(a.features) + 1), "
        "lambda i: (a.features[i] - b.features[i]) * (a.features[i] - b.features[i])), lambda x, y: x + y)")

OV_CTES = [
    ("cnt", """SELECT max(n) FILTER (WHERE y = 1) AS n_min, max(n) FILTER (WHERE y = 0) AS n_maj
               FROM (SELECT y, count(*) AS n FROM embed_binary GROUP BY y) t"""),
    ("plan", """SELECT n_min, n_maj, greatest(0, CAST(ceil(0.35::DOUBLE * n_maj) AS BIGINT) - n_min) AS n_gen,
                       least(5, n_min - 1) AS k_eff FROM cnt"""),
    ("mino", f"""SELECT vec_id, features,
                   row_number() OVER (ORDER BY {_h('vec_id', '42:minority')}, vec_id) - 1 AS idx
                 FROM embed_binary WHERE y = 1"""),
    ("knn", f"""SELECT vec_id, nbr_id, rank, dist2 FROM (
                  SELECT a.vec_id, b.vec_id AS nbr_id, {DIST} AS dist2,
                         row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS rank
                  FROM mino a JOIN mino b ON a.vec_id <> b.vec_id) t, plan
                WHERE rank <= plan.k_eff"""),
    ("draws", f"""SELECT g AS draw,
                    CAST(floor(CAST({_h('g', '42:base')} AS DOUBLE) / 4294967296.0::DOUBLE * n_min) AS BIGINT) AS idx,
                    CAST(floor(CAST({_h('g', '42:slot')} AS DOUBLE) / 4294967296.0::DOUBLE * k_eff) AS INTEGER) + 1 AS rank,
                    CAST({_h('g', '42:gap')} AS DOUBLE) / 4294967296.0::DOUBLE AS gap
                  FROM plan, range(plan.n_gen) t(g)"""),
    ("syn", """SELECT d.draw, m.vec_id AS src_id, k.nbr_id, d.gap,
                 list_transform(range(1, len(m.features) + 1),
                   lambda i: round(m.features[i] + d.gap * (n.features[i] - m.features[i]), 6)) AS features
               FROM draws d JOIN mino m ON d.idx = m.idx
               JOIN knn k ON k.vec_id = m.vec_id AND k.rank = d.rank
               JOIN mino n ON n.vec_id = k.nbr_id"""),
]

ORACLES["knn_minority"] = with_fixtures(
    "SELECT vec_id, nbr_id, CAST(rank AS INTEGER) AS rank, round(dist2, 9) AS dist2 FROM knn",
    "embed_binary", extra=OV_CTES)

ORACLES["smote_synthetic"] = with_fixtures("SELECT * FROM syn", "embed_binary", extra=OV_CTES)

ORACLES["smote_counts"] = with_fixtures("""
  SELECT 'majority' AS origin, 0 AS y, CAST(count(*) AS BIGINT) AS n_rows FROM embed_binary WHERE y = 0
  UNION ALL SELECT 'minority', 1, CAST(count(*) AS BIGINT) FROM embed_binary WHERE y = 1
  UNION ALL SELECT 'synthetic', 1, CAST(count(*) AS BIGINT) FROM syn""", "embed_binary", extra=OV_CTES)


# --- step 8: density ------------------------------------------------------------

KDE_CTES = [
    ("lg", unpivot_num_sql("patients", NUM)),
    ("vc", "SELECT feature, y, value, count(*) AS c FROM lg GROUP BY ALL"),
    ("st", """SELECT feature, y, count(*) AS n,
                     stddev_samp(value) * pow(CAST(count(*) AS DOUBLE), -0.2::DOUBLE) AS h,
                     min(value) AS mn, max(value) AS mx FROM lg GROUP BY ALL"""),
    ("g", """SELECT feature, y, n, h, j,
               CASE WHEN j = 199 THEN mx + h * 3.0::DOUBLE
                    ELSE (mn - h * 3.0::DOUBLE)
                         + j * (((mx + h * 3.0::DOUBLE) - (mn - h * 3.0::DOUBLE)) / 199.0::DOUBLE) END AS x
             FROM st, range(0, 200) t(j)"""),
]
ORACLES["kde_grid"] = with_fixtures("""
  SELECT g.feature, g.y AS class, CAST(g.j AS INTEGER) AS j, round(g.x, 6) AS x,
         round(sum(vc.c * exp(-0.5::DOUBLE * ((g.x - vc.value) / g.h) * ((g.x - vc.value) / g.h)))
               / (max(g.n) * max(g.h) * sqrt(2 * pi())), 9) AS density
  FROM g JOIN vc ON g.feature = vc.feature AND g.y = vc.y
  GROUP BY g.feature, g.y, g.j, g.x""", "patients", extra=KDE_CTES)


# --- step 4: sources, projections, preprocessing --------------------------------

ORACLES["csv_roundtrip"] = with_fixtures("SELECT * FROM patients", "patients")

ORACLES["csv_quoted_newlines"] = """
  SELECT doc_id, nullif(source, '') AS source, md5(nullif(text, '')) AS text_md5,
         length(nullif(text, ''))::BIGINT AS n_chars,
         (length(nullif(text, '')) - length(replace(nullif(text, ''), chr(10), '')))::BIGINT AS n_newlines
  FROM documents"""

ORACLES["model_features"] = with_fixtures("""
  SELECT patient_id AS row_id, age * has_hypertension AS age_x_hypertension,
         age * has_heart_disease AS age_x_heart_disease,
         coalesce(glucose_level * bmi_value, 0.0::DOUBLE) AS glucose_x_bmi,
         age * age AS age_squared, has_hypertension + has_heart_disease AS cvd_count,
         CAST(age >= 55 AS INTEGER) AS is_senior, round(ln(glucose_level + 1.0::DOUBLE), 10) AS log_glucose
  FROM patients""", "patients")

ORACLES["fill_zero"] = with_fixtures("""
  SELECT patient_id, coalesce(bmi_value, 0.0::DOUBLE) AS bmi_value, coalesce(bmi_category, '0') AS bmi_category
  FROM patients""", "patients")

ORACLES["high_risk_profile"] = with_fixtures("""
  SELECT risk_criteria, CAST(risk_criteria >= 3 AS INTEGER) AS high_risk, stroke_event,
         CAST(count(*) AS BIGINT) AS n_rows
  FROM (SELECT *, CAST(age > 60 AS INTEGER) + CAST(has_hypertension = 1 AS INTEGER)
                  + CAST(glucose_level > 140 AS INTEGER) + CAST(has_heart_disease = 1 AS INTEGER) AS risk_criteria
        FROM patients) t GROUP BY ALL""", "patients")

ORACLES["extra_features"] = with_fixtures("""
  SELECT patient_id, age / 10 AS age_over_10,
         round(glucose_level / nullif(bmi_value, 0.0::DOUBLE), 10) AS glucose_per_bmi,
         round(bmi_value - (SELECT _m FROM gm), 10) AS bmi_deviation
  FROM patients""", "patients", extra=[("gm", median_sql("patients", [], "bmi_value", "_m"))])

CODES_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM {{src}}"
    for c in ["gender", "employment_type", "residence", "smoking_habit"])

ORACLES["label_codes"] = with_fixtures(f"""
  SELECT "column", value, CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT "column", value FROM ({CODES_SQL.format(src="patients")}) u) d""", "patients")

PRE_CTES = SPLIT_CTES + [
    ("trn", "SELECT * FROM splits WHERE split <> 'test'"),
    ("tst", "SELECT * FROM splits WHERE split = 'test'"),
    ("tb", f"SELECT *, {AGE_BIN} AS _bin FROM trn"),
    ("tgm", median_sql("(SELECT * FROM tb WHERE gender IS NOT NULL AND _bin IS NOT NULL)",
                       ["gender", "_bin"], "bmi_value", "_gm")),
    ("tglob", median_sql("trn", [], "bmi_value", "_glob")),
    ("codes", f"""SELECT "column", value,
                         CAST(dense_rank() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INTEGER) AS code
                  FROM (SELECT DISTINCT "column", value FROM ({CODES_SQL.format(src="trn")}) u) d"""),
]


def _code(c: str) -> str:
    return (f"coalesce((SELECT code FROM codes WHERE \"column\" = '{c}' "
            f"AND value = coalesce(CAST(x.{c} AS VARCHAR), 'nan')), -1) AS {c}")


ORACLES["preprocess_train_apply"] = with_fixtures(f"""
  SELECT x.patient_id, coalesce(x.bmi_value, tgm._gm, tglob._glob) AS bmi_value,
         {_code('gender')}, {_code('employment_type')}, {_code('residence')}, {_code('smoking_habit')}
  FROM (SELECT *, {AGE_BIN} AS _bin FROM tst) x
  LEFT JOIN tgm ON x.gender = tgm.gender AND x._bin = tgm._bin, tglob""", "patients", extra=PRE_CTES)


# --- step 8: sinks, chart tables, report extras -----------------------------------

ORACLES["snapshot_preferred_source"] = ORACLES["snapshot"].replace("'patients_cleaned'", "'patients_cleaned'")

ORACLES["contingency_wide_smoking"] = with_fixtures("""
  SELECT smoking_habit AS level,
         CAST(count(*) FILTER (WHERE stroke_event = 0) AS BIGINT) AS n_neg,
         CAST(count(*) FILTER (WHERE stroke_event = 1) AS BIGINT) AS n_pos
  FROM patients WHERE smoking_habit IS NOT NULL GROUP BY 1""", "patients")

EXT_NUM = [*NUM, "age_squared", "age_x_hypertension"]
EXT_CAT = [*CAT, "marital_status"]

ORACLES["mann_whitney_extended"] = with_fixtures(f"""
  SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, u0 AS u_stat,
         round((greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5)
               / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))), 9) AS z
  FROM (SELECT feature, CAST(sum(n0) AS DOUBLE) AS n0, CAST(sum(n1) AS DOUBLE) AS n1,
               sum(n0 * avg_rank) - CAST(sum(n0) AS DOUBLE) * (CAST(sum(n0) AS DOUBLE) + 1) / 2 AS u0,
               sum(CAST(t AS DOUBLE) * t * t - t) AS ties
        FROM ({RANKS_SQL.format(src=unpivot_num_sql("cleaned", EXT_NUM))}) r GROUP BY feature) g""",
                                                 "patients_raw", extra=CLEAN)

CHI_EXT_CTES = CLEAN + [("obs", f"SELECT feature, level, y, count(*) AS o FROM ({unpivot_lvl_sql('cleaned', EXT_CAT)}) u GROUP BY ALL")] + CHI_CTES[1:]
ORACLES["chi_square_extended"] = with_fixtures("""
  SELECT feature,
         round(sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 9)
           AS statistic,
         CAST(max(dof) AS INTEGER) AS dof
  FROM cells GROUP BY feature""", "patients_raw", extra=CHI_EXT_CTES)


# --- the same operators on real labels and on the largest table -------------------

def chi_ctes(src: str, feats: list[str], target: str) -> list[tuple[str, str]]:
    return [("obs", f"SELECT feature, level, y, count(*) AS o FROM ({unpivot_lvl_sql(src, feats, target)}) u "
                    f"GROUP BY ALL")] + CHI_CTES[1:]


CHI_FINAL = """
  SELECT feature,
         round(sum(power(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e), 9)
           AS statistic,
         CAST(max(dof) AS INTEGER) AS dof
  FROM cells GROUP BY feature"""

ORACLES["doc_labels_chi_square"] = with_fixtures(
    CHI_FINAL, "doc_labels", extra=chi_ctes("doc_labels", ["lang", "source", "quality"], "toxic"))

ORACLES["doc_labels_mann_whitney"] = with_fixtures(f"""
  SELECT feature, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, u0 AS u_stat,
         round((greatest(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5)
               / sqrt(n0 * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1)))), 9) AS z
  FROM (SELECT feature, CAST(sum(n0) AS DOUBLE) AS n0, CAST(sum(n1) AS DOUBLE) AS n1,
               sum(n0 * avg_rank) - CAST(sum(n0) AS DOUBLE) * (CAST(sum(n0) AS DOUBLE) + 1) / 2 AS u0,
               sum(CAST(t AS DOUBLE) * t * t - t) AS ties
        FROM ({RANKS_SQL.format(src=unpivot_num_sql("doc_labels", ["n_chars"], "toxic"))}) r GROUP BY feature) g""",
                                                   "doc_labels")

# ways(m, n, u): orders of m and n rows with u pairs out of order, one more row a round
ORACLES["customer_rank_tests"] = f"""
  WITH RECURSIVE long AS (
    SELECT o_custkey, o_totalprice AS v, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
    FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
  ranked AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, v) AS t,
               rank() OVER (PARTITION BY o_custkey ORDER BY v) + (count(*) OVER (PARTITION BY o_custkey, v) - 1) / 2.0::DOUBLE AS r
             FROM long),
  g AS (SELECT o_custkey, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1,
               coalesce(sum(r) FILTER (WHERE y = 0), 0)::DOUBLE - count(*) FILTER (WHERE y = 0) * (count(*) FILTER (WHERE y = 0) + 1) / 2 AS u0,
               sum(t * t - 1)::DOUBLE AS ties FROM ranked GROUP BY o_custkey),
  ways(m, n, u, c) AS (
    SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT
    UNION ALL
    SELECT m + dm, n + 1 - dm, u + dm * n, sum(c)::BIGINT FROM ways, (VALUES (0::BIGINT), (1::BIGINT)) d(dm)
    WHERE m + dm <= 8 AND m + n < (SELECT max(n0 + n1) FROM g) GROUP BY 1, 2, 3),
  tails AS (SELECT m, n, u, sum(c) OVER (PARTITION BY m, n ORDER BY u)::DOUBLE / sum(c) OVER (PARTITION BY m, n) AS tail FROM ways),
  z AS (SELECT *, greatest((greatest(u0, n0 * n1 - u0) - n0 * n1 / 2.0::DOUBLE - 0.5)
          / sqrt(n0 * n1 / 12.0::DOUBLE * ((n0 + n1 + 1) - ties / ((n0 + n1) * (n0 + n1 - 1.0::DOUBLE)))), 0) / sqrt(2.0::DOUBLE) AS x
        FROM g WHERE n0 > 0 AND n1 > 0)
  SELECT g.o_custkey, g.n0, g.n1, g.u0 AS u_stat, g.ties > 0 AS tied,
         round(CASE WHEN g.n0 = 0 OR g.n1 = 0 THEN NULL
                    WHEN g.ties = 0 AND least(g.n0, g.n1) <= 8 THEN least(1.0::DOUBLE, 2 * tail)
                    ELSE least(1.0::DOUBLE, {erfc_sql("x")}) END, 10) AS p_value
  FROM g LEFT JOIN z USING (o_custkey) LEFT JOIN tails
    ON m = least(g.n0, g.n1) AND n = greatest(g.n0, g.n1) AND u = least(g.u0, g.n0 * g.n1 - g.u0)"""

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_li_pairs = [(a, b) for i, a in enumerate(_LI) for b in _LI[i + 1:]]
ORACLES["lineitem_correlation"] = " UNION ALL ".join(
    [f"SELECT '{a}' AS col_i, '{b}' AS col_j, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _li_pairs]
    + [f"SELECT '{b}' AS col_i, '{a}' AS col_j, round(corr({a}, {b}), 8) AS r FROM lineitem" for a, b in _li_pairs]
    + [f"SELECT '{c}' AS col_i, '{c}' AS col_j, 1.0::DOUBLE AS r" for c in _LI])
