"""Every registered query with a DuckDB twin gives the same rows, columns and types."""

from __future__ import annotations

import pytest

from nearvote.plans import catalogue
from tests.conftest import SF
from tests.helpers import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"query_id", "fraud", "approved", "fraud_score"} <= set(rows[0].asDict())


def test_queries_without_sql_run(spark):
    for name in set(catalogue.QUERIES) - set(catalogue.ORACLES):
        assert catalogue.QUERIES[name](spark, SF).count() > 0
