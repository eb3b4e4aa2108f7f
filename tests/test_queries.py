"""Every registered query of the engine against its SQL."""

import pytest
from oracle import difference

import __spark_entry__
from navella.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf_dir, name):
    assert difference(spark, QUERIES[name], ORACLES[name], sf_dir) == ""


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "scheme_id"
    assert df.count() > 0
