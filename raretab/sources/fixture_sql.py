"""DuckDB spellings of the fixture views (for the SQL oracles only).

Kept textually parallel to ``fixtures.py``; the arithmetic is bit-equal in
both engines (doubles everywhere, explicit ``::DOUBLE`` on literals).
"""

from __future__ import annotations

U32 = "(('0x' || substr(md5({s}), 1, 8))::BIGINT)"


def u32(s: str) -> str:
    return U32.format(s=s)


def uniform(s: str) -> str:
    return f"(CAST({u32(s)} AS DOUBLE) / 4294967296.0::DOUBLE)"


PATIENTS_BASE = f"""
  SELECT
    o_orderkey AS patient_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender,
    CAST(1 + (o_orderkey * 37 + o_custkey * 11) % 82 AS DOUBLE) AS age,
    CAST(o_orderpriority LIKE '1%' AS INTEGER) AS has_hypertension,
    CAST(o_orderstatus = 'F' AND o_custkey % 5 = 0 AS INTEGER) AS has_heart_disease,
    CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 1 END AS marital_status,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'working'
         WHEN c_mktsegment = 'HOUSEHOLD' THEN 'government' ELSE 'other' END AS employment_type,
    CASE WHEN c_nationkey % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS residence,
    55.0::DOUBLE + o_totalprice % 217 AS glucose_level,
    CASE WHEN o_orderkey % 25 = 7 THEN NULL
         ELSE 15.0::DOUBLE + (o_totalprice % 3000) / 100 END AS bmi_value,
    CASE (o_orderkey * 7 + o_custkey) % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'formerly'
         WHEN 2 THEN 'smokes' ELSE 'unknown' END AS smoking_habit,
    {uniform("'42|' || CAST(o_orderkey AS VARCHAR)")} AS _u
  FROM orders JOIN customer ON o_custkey = c_custkey
"""

PATIENTS = f"""
  SELECT patient_id, gender, age,
    CASE WHEN age < 40 THEN 'young' WHEN age < 60 THEN 'middle' ELSE 'senior' END AS age_group,
    has_hypertension, has_heart_disease, marital_status, employment_type, residence,
    glucose_level,
    CAST(glucose_level >= 140 AS INTEGER) AS high_glucose,
    bmi_value,
    CASE WHEN bmi_value < 18.5 THEN 'under' WHEN bmi_value < 25 THEN 'normal'
         WHEN bmi_value < 30 THEN 'over' WHEN bmi_value IS NOT NULL THEN 'obese' END AS bmi_category,
    smoking_habit,
    has_hypertension + has_heart_disease AS risk_score,
    CAST(_u < 0.09::DOUBLE * (age / 82) * (age / 82)
             * (1 + has_hypertension + has_heart_disease) AS INTEGER) AS stroke_event
  FROM patients_base
"""

PATIENTS_RAW = """
  SELECT * FROM patients
  UNION ALL
  SELECT patient_id + r * 1000000000000 AS patient_id, gender, age, age_group, has_hypertension,
         has_heart_disease, marital_status, employment_type, residence, glucose_level,
         high_glucose, bmi_value, bmi_category, smoking_habit, risk_score, stroke_event
  FROM patients, range(1, 19) t(r)
  WHERE stroke_event = 1
"""

SCORED = f"""
  SELECT m.model, patient_id AS row_id, stroke_event AS y,
    CAST(floor(1000 * (0.5::DOUBLE * (age / 82)
        + 0.3::DOUBLE * {uniform("CAST(m.salt AS VARCHAR) || '|' || CAST(patient_id AS VARCHAR)")}
        + 0.1::DOUBLE * has_hypertension + 0.1::DOUBLE * has_heart_disease)) AS DOUBLE) / 1000 AS p
  FROM patients, (VALUES ('a', 43), ('b', 44), ('c', 45)) m(model, salt)
"""

EMBED_BINARY = """
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label = 0 AS INTEGER) AS y
  FROM embeddings
"""

DOC_LABELS = """
  SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id
"""

_DEFS = {
    "patients_base": PATIENTS_BASE,
    "patients": PATIENTS,
    "patients_raw": PATIENTS_RAW,
    "scored": SCORED,
    "embed_binary": EMBED_BINARY,
    "doc_labels": DOC_LABELS,
}
_DEPS = {
    "patients": ["patients_base"],
    "patients_raw": ["patients"],
    "scored": ["patients"],
}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixture CTEs>, <extra CTEs> <body>``."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({_DEFS[n]})" for n in order]
    ctes += [f"{n} AS ({q})" for n, q in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
