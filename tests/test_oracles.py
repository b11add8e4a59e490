"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import canon, duck

from .conftest import SF_SMALL

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    scols, srows = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.sql(ORACLES[name])
    dcols, drows = canon(res.columns, res.fetchall())
    assert scols == dcols
    assert srows == drows


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["age_bin", "n_rows", "n_pos", "prevalence", "mean_bmi"]
    assert df.count() >= 1


PREFIX_QUERIES = ["grouped_median_bmi", "global_median_bmi", "grouped_median_lineitem", "box_summary",
                  "avg_ranks_age", "mann_whitney", "roc_auc", "roc_curve", "pr_curve",
                  "average_precision", "fold_membership", "permuted_labels", "clean_table"]


@pytest.mark.parametrize("name", PREFIX_QUERIES)
def test_prefix_queries_many_buckets(spark, con, name, monkeypatch):
    """Force tiny bucket windows so the multi-bucket prefix path is used."""
    from raretab.operators import prefix
    monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", 7)
    test_query_matches_oracle(spark, con, name)
