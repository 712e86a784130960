"""Every registered query against its SQL in DuckDB, and the same results without broadcasts."""

import pytest

from tests.check_oracles import compare, connect
from tierworks.plans.oracle import ORACLE
from tierworks.plans.registry import QUERIES

NO_SQL = {"risk_scores", "class_metrics", "confusion_matrix", "v_risk", "v_opportunity", "cluster_quality"}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_query_has_sql_but_the_learned_ones():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLE)))
def test_query_equals_sql(spark, duck, sf, name):
    assert compare(spark, duck, name, sf) is None


@pytest.mark.parametrize(
    "name",
    ["fact_kpi1", "fact_kpi3", "fact_kpi5", "fact_kpi7", "silver_customer", "w1_skew_join", "lineage_closure",
     "lineage_completeness", "umt_filled", "glossary_merged", "anomaly_rate", "kpi_cards"],
)
def test_query_without_broadcast(spark, duck, sf, name, no_broadcast):
    assert compare(spark, duck, name, sf) is None


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_learned_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
