"""Every registered query against its DuckDB statement, on the smallest tables."""

import oracle
import pytest
from oracle import DATA

import __spark_entry__ as entry
from trawlkit.plans import catalog

QUERIES, STATEMENTS = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle.connect(DATA)


def test_every_crawl_query_has_a_statement():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_statement(spark, db, name):
    assert oracle.compare(spark, db, DATA, QUERIES[name], STATEMENTS[name]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
