import __spark_entry__ as entry
from conftest import DATA

from snapmill.llm import plans


def test_registered():
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.SQL) <= set(entry.oracle_sql())


def test_small_tables(spark):
    for name in ("p8_fill", "p9_shares", "p10_profile"):
        assert plans.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0
