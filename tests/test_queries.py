"""Every registered query against its DuckDB SQL."""

import pytest

from lodestrata.plans.oracles import ORACLES
from lodestrata.plans.queries import QUERIES

from .conftest import same_rows


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got, want = same_rows(QUERIES[name](spark, sf_dir), duck.execute(ORACLES[name]))
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 12
    assert set(QUERIES) <= set(e.queries())
