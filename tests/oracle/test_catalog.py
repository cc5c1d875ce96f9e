"""Every query of the catalog against its SQL twin."""

import pytest
from compare import of_spark, of_sql

from siltstone.plans import catalog

SF = "/root/testdata/sf0.001"
#: Approximate, so SQL has no rows for it; tests/unit/test_tools.py holds its recall against brute force.
WITHOUT_SQL = {"knn_index_top5"}


def test_every_query_has_a_twin():
    assert set(catalog.oracle_sql()) == set(catalog.queries()) - WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - WITHOUT_SQL))
def test_twin(spark, name):
    assert of_spark(catalog.queries()[name](spark, SF)) == of_sql(catalog.oracle_sql()[name], SF)
