"""Every registered query against its SQL restatement (DuckDB) on sf0.001."""

import pytest

import __spark_entry__ as E
from pressroll.plans import catalog
from pressroll.plans.compare import compare, duck

from conftest import SF_SMALL

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF_SMALL, con)
    assert r["status"] == "match", r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "label_ko", "label_en", "headline_ko", "headline_en", "storyCount",
                          "moveCount", "tags"]
    assert df.count() > 0
