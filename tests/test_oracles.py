"""Every registered query against its SQL."""

import pytest

from check_oracles import compare, duck
from threatloom.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    assert name in ORACLES
    assert compare(spark, con, name, sf_dir) is None


def test_entry_gives_rows(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["cwe_id", "vulnerable", "safe", "total"]
    assert frame.count() > 0
