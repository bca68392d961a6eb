"""Registered queries equal their SQL twins row by row.

Here models have fewer trees and steps than in the catalog; ``python tests/check.py`` runs them in full size.
"""

import pytest
from oracle import compare, connect

from tablewright.catalog import ORACLES, QUERIES
from tablewright.operators import models


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Sizes of the models in this test.
SMALLER = {"boosted": {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}, "forest": {"numTrees": 20, "maxDepth": 6}, "logistic": {"maxIter": 30}}


@pytest.fixture
def smaller_models(monkeypatch):
    whole = models.classifier

    def smaller(name, *args, **kwargs):
        return whole(name, *args, **{**SMALLER.get(name, {}), **kwargs})

    monkeypatch.setattr(models, "classifier", smaller)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, smaller_models, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
