"""Tail probabilities against published golden values (statistic -> p)."""

import itertools
import math

import pytest

from raretab.functions.pvalues import chi2_sf, normal_two_sided, rank_two_sided

# Published chi-square statistics, degrees of freedom and p-values.
GOLDEN_CHI2 = [
    (0.34312923759376157, 1, 0.5580285118426893),
    (29.14726919139926, 3, 2.0853997025008497e-06),
    (38.00668602082237, 2, 5.584097503494919e-09),
    (1.0816367471627524, 1, 0.29833169286876987),
    (81.6053682482931, 1, 1.661621901511823e-19),
    (90.25956125843324, 1, 2.0887845685229236e-21),
]


@pytest.mark.parametrize("stat,dof,p", GOLDEN_CHI2)
def test_chi2_golden(stat, dof, p):
    assert math.isclose(chi2_sf(stat, dof), p, rel_tol=1e-11)


def test_chi2_even_dof_matches_series():
    # dof 4: Q = exp(-x/2) (1 + x/2)
    x = 3.7
    assert math.isclose(chi2_sf(x, 4), math.exp(-x / 2) * (1 + x / 2), rel_tol=1e-14)


def test_chi2_edges():
    assert chi2_sf(0.0, 1) == 1.0
    assert chi2_sf(5.0, 0) == 1.0


def test_normal_two_sided():
    assert math.isclose(normal_two_sided(1.959963984540054), 0.05, rel_tol=1e-9)
    assert normal_two_sided(-0.1) == 1.0  # capped


# Published two-sided 5% critical values of U (largest U that is significant).
CRITICAL_U = {(5, 5): 2, (4, 6): 2, (7, 7): 8, (8, 8): 13, (3, 10): 3, (8, 15): 29}


@pytest.mark.parametrize("sizes,u", CRITICAL_U.items())
def test_exact_rank_test_critical_values(sizes, u):
    assert rank_two_sided(u, *sizes) <= 0.05 < rank_two_sided(u + 1, *sizes)


@pytest.mark.parametrize("m,n", [(1, 1), (1, 6), (2, 5), (3, 4), (4, 4), (5, 3)])
def test_exact_rank_test_counts_arrangements(m, n):
    us = [sum(i - k for k, i in enumerate(c)) for c in itertools.combinations(range(m + n), m)]
    for u in range(m * n + 1):
        far = max(u, m * n - u)
        assert math.isclose(rank_two_sided(u, m, n), min(1.0, 2 * sum(x >= far for x in us) / len(us)), rel_tol=1e-14)
    assert rank_two_sided(0, m, n) == rank_two_sided(0, n, m)


def test_exact_rank_test_nears_the_normal_one():
    # 8 against 4000 rows: large counts, still exact integers
    z = (8 * 4000 / 2 * 0.5 - 0.5) / math.sqrt(8 * 4000 / 12 * 4009)
    assert math.isclose(rank_two_sided(8 * 4000 / 4, 8, 4000), normal_two_sided(z), abs_tol=0.003)
