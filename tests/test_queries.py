"""Registered queries against their SQL on the smallest tables: the headline ones, or all with TEST_ALL=1.

``python tests/compare.py`` runs the same comparison for all queries at sf0.01.
"""

import os

import pytest

import comptoir.registry.all  # noqa: F401
from bench import HEADLINE
from comptoir.registry.base import REGISTRY
from tests.compare import compare, connect

CHECKED = REGISTRY if os.environ.get("TEST_ALL") else {n: REGISTRY[n] for n in HEADLINE if n in REGISTRY}
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, q in CHECKED.items() if q.sql))
def test_query_agrees_with_sql(spark, duck, name):
    problem = compare(spark, duck, REGISTRY[name], SF_DIR)
    assert problem in ("", "no rows"), problem


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_query_without_sql_returns_rows(spark, name):
    assert not REGISTRY[name].run(spark, SF_DIR).isEmpty()
