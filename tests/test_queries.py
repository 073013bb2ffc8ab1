import os

import pytest

import oracle
from ledgerview.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no fixture tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, con, name):
    assert oracle.difference(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name]) == ""


def test_catalogues(spark):
    assert {r.name for r in catalogue.queries()["view_catalog"](spark, SF).collect()} >= {"SalesInvoice", "SalesItemRows"}
    assert {r.name for r in catalogue.queries()["schema_catalog"](spark, SF).collect()} >= {"Serial", "Date"}


def test_entry_point_and_its_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    def plan(name):
        return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan("date_year")
    assert "o_totalprice" not in plan("filter_date_literal")


def test_pages_are_top_k(spark):
    plan = catalogue.queries()["sort_page_asc"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
