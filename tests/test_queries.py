import pytest

import __spark_entry__ as entry
from tests.oracle import differences

NAMES = sorted(q for q in entry.oracle_sql() if not q.startswith("op") and q != "pipeline")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(name, spark, sf_dir) == ""


def test_every_query_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
