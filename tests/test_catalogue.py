"""Every query of the catalogue gives the rows of its SQL."""

import subprocess
import sys

import pytest

from folio import catalogue
from tests.compare import agree

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    agree(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_queries_are_registered_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not set(e.oracle_sql()) - set(e.queries())"], check=True)
