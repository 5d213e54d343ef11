"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; the others have rows that agree with each other."""

import math
from collections import Counter

import pandas as pd
import pytest
from conftest import DATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
FOLDER = f"{DATA}/sf0.001"


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    return f"{float(value):.5f}" if isinstance(value, float | int) and not isinstance(value, bool) else str(value)


def counted(frame):
    return Counter(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert counted(ours) == counted(theirs)


#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"collinear_groups", "vif_report"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    """What SQL can't express has rows, all of one shape, and the same ones again; what they hold is tested with its operator."""
    first, again = (QUERIES[name](spark, FOLDER).toPandas() for _ in range(2))
    assert len(first) > 0 or name in MAY_BE_EMPTY
    assert first.columns.is_unique and counted(first.astype(str)) == counted(again.astype(str))


def rows_of(spark, name):
    return QUERIES[name](spark, FOLDER).toPandas()


def test_log_queries_agree(spark):
    found, messages = rows_of(spark, "p2_found"), rows_of(spark, "p2_messages")
    assert counted(found) == counted(messages[found.columns])
    assert (messages["message"].str.count("\n") == messages["last_line"] - messages["first_line"]).all()
    assert set(rows_of(spark, "p2_layouts")["layout"].str.contains("t:")) == {True}


def test_instant_queries_agree(spark):
    found, forms = rows_of(spark, "p3_found"), rows_of(spark, "p3_forms")
    assert forms.groupby("source_table")["readable"].sum().to_dict() == found.groupby("source_table").size().to_dict()


def test_drift_queries_agree(spark):
    table, failed, kinds = rows_of(spark, "p4_table"), rows_of(spark, "p4_failed_casts"), rows_of(spark, "p4_kinds")
    assert table["failed"].map(len).sum() == len(failed)
    assert set(table["section"]) <= set(kinds["section"]) and set(rows_of(spark, "p4_found")["field_path"].str.rsplit(".", n=1).str[0]) <= set(kinds["section"])


def test_hourly_queries_agree(spark):
    found, filled = rows_of(spark, "p6_found"), rows_of(spark, "p6_filled")
    assert len(found) == len(filled) and (filled["n"] == 0).all() and (filled["value"].dropna() >= 0).all()


def test_reading_queries_agree(spark):
    found, report = rows_of(spark, "p7_found"), rows_of(spark, "p7_report")
    assert report.groupby(["source_table", "field_name"])["n"].sum().to_dict() == found.groupby(["source_table", "field_name"]).size().to_dict()
    told = sum(len(rows_of(spark, n)) for n in ("p7_impossible", "p7_stuck"))
    assert told == report.loc[report["why"] != "spike", "n"].sum()


def test_gradient_queries_agree(spark):
    models, impacts = rows_of(spark, "gradient_models"), rows_of(spark, "gradient_impacts")
    assert set(impacts["model"]) <= {"ridge", "elastic_net", "huber", "quantile95"} and (models["vif"] >= 1).all()
    assert (impacts[impacts["model"] == "ridge"].groupby(["db_id", "instance_num"]).size() == models.groupby(["db_id", "instance_num"]).size()).all()
    labels = rows_of(spark, "cross_model_labels")
    assert labels["label"].notna().all() and len(labels) <= len(models)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert not set(SQL) - set(QUERIES)
