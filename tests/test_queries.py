"""Every registered query against its SQL twin on the smallest tables, where they are there."""

import os

import duckdb
import pandas as pd
import pytest

from oddsmill.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def text(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and pd.isna(x)):
        return "<null>"
    if isinstance(x, float) and x.is_integer():
        return str(int(x))
    return str(x).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_twin(spark, db, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = db.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def many_alike(spark, tmp_path_factory):
    """600 parts of one name and type: 300 a venue, all in one block, 90,000 pairs."""
    folder = str(tmp_path_factory.mktemp("alike"))
    spark.range(300).selectExpr("explode(array(id * 840 * 6, id * 840 * 6 + 1)) AS p_partkey").selectExpr("p_partkey", "'hot bolt' AS p_name", "'SMALL' AS p_type").write.parquet(f"{folder}/part.parquet")
    return folder


def most_rows(df) -> int:
    """Of all operators of the plan that ran."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if node.metrics().contains("numOutputRows"):
            found = max(found, node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_matching_run_makes_no_row_for_a_pair(spark, many_alike):
    assert most_rows(registry.queries()["matching_run"](spark, many_alike)) < 10_000


def test_productive_series_scores_no_row_for_a_pair(spark, many_alike):
    df = registry.queries()["productive_series"](spark, many_alike)
    plan = df._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan
    assert [tuple(r) for r in df.collect()] == []


def test_backtest_summary_broadcasts_no_market(spark):
    plan = registry.queries()["backtest_summary"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashedRelationBroadcastMode" not in plan


@pytest.fixture(scope="module")
def many_matching(spark, tmp_path_factory):
    """600 parts of two names: 300 a venue, all in one block, and matches in one series."""
    folder = str(tmp_path_factory.mktemp("matching"))
    parts = spark.range(300).selectExpr("id", "explode(array(id * 840 * 6, id * 840 * 6 + 721)) AS p_partkey")
    parts.selectExpr("p_partkey", "if(id % 2 = 0, 'hot bolt', 'cold bolt') AS p_name", "'SMALL' AS p_type").write.parquet(f"{folder}/part.parquet")
    return folder


@pytest.mark.parametrize("name, rows", [("matching_run", 3), ("productive_series", 1)])
def test_matching_sends_blocks_not_markets_by_way_of_the_driver(spark, many_matching, name, rows):
    """What is broadcast goes through the driver's memory: one row a block, however many markets are in it."""
    df = registry.queries()[name](spark, many_matching)
    assert len(df.collect()) == rows
    assert 0 < most_rows_broadcast(df) <= 7


def most_rows_broadcast(df) -> int:
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "BroadcastExchangeExec":
            found = max(found, node.metrics().apply("numOutputRows").value())
        todo += [getattr(node, into)() for end, into in (("AdaptiveSparkPlanExec", "executedPlan"), ("QueryStageExec", "plan"), ("ReusedExchangeExec", "child")) if kind.endswith(end)]
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
