"""Values computed independently for the formula-score fixture at sf0.01,
and the label-permutation control."""

import pytest
from pyspark.sql import functions as F

from raretab.operators import evaluate as EV
from raretab.operators.stats import mann_whitney
from raretab.sources import fixtures as FX

from .conftest import SF_MID

# Class sizes, U of class 0, |z| and average precision per
# formula-score model at sf0.01.
KNOWN = {
    "a": (14389, 611, 2233845.5, 20.622895, 0.101054445),
    "b": (14389, 611, 2175732.5, 21.177225, 0.105401981),
    "c": (14389, 611, 2155029.0, 21.374713, 0.099980720),
}


def test_formula_scores_known_values(spark):
    s = FX.scored(spark, SF_MID)
    ap = {r["model"]: r["auc_pr"] for r in EV.average_precision(s).collect()}
    for m, (n0, n1, u0, z, ap_m) in KNOWN.items():
        r = mann_whitney(s.where(F.col("model") == m), ["p"], "y").first()
        assert (r["n0"], r["n1"]) == (n0, n1)
        assert r["u_stat"] == u0
        assert r["z"] == pytest.approx(z, abs=1e-6)
        assert ap[m] == pytest.approx(ap_m, abs=1e-9)


def test_label_shuffle_auc_near_half(spark):
    from raretab.plans.catalog import REGISTRY
    aucs = [r["auc_roc"] for r in REGISTRY["label_shuffle_auc"](spark, SF_MID).collect()]
    assert len(aucs) == 3
    assert all(abs(a - 0.5) < 0.1 for a in aucs)
