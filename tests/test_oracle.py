"""Every query with a SQL counterpart must agree with it; the others must give rows."""

from __future__ import annotations

import pytest

import check
from pathpulse.catalog import all_oracles, all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, small, name):
    assert check.compare(spark, con, QUERIES[name], ORACLES[name], small) == ""


@pytest.mark.parametrize("name", ["feat_all", "pca2", "rf_importance", "cv_logistic", "model_vote"])
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
