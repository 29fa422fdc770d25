import pytest

from sparkloom import plans

from harness import SMALL, assert_equal


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_its_sql(spark, name):
    assert_equal(plans.queries()[name](spark, SMALL), plans.oracles()[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracles())))
def test_query_without_sql_runs(spark, name):
    assert plans.queries()[name](spark, SMALL).count() > 0
    spark.catalog.clearCache()


def test_entry_has_the_flagship(spark):
    import __spark_entry__ as entry

    assert {r["pipeline"] for r in entry.entry(spark).collect()} == {"dense", "dense_rerank", "hybrid", "hybrid_rerank"}
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
