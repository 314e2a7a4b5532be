import os

import pytest

from patquarry.plans import catalog
from tests.compare import DATA, assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(name, spark):
    assert_same(catalog.QUERIES[name], catalog.ORACLES[name], spark)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert {"R1_application_trend"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert DATA


def test_imports_need_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
