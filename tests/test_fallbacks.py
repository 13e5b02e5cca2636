"""With broadcasts ruled out, the shuffle-join fallbacks give the same answers."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from tests.conftest import SF_SMALL  # noqa: E402

QUERIES = ["bfs_host_word", "bfs_path_counts", "crawl_plan", "robots_verdicts", "rate_limit_flags",
           "disk_quota", "config_filtered_pages"]


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    import pagelake.plans.graph as G
    import pagelake.session as S
    monkeypatch.setattr(S, "BROADCAST_ROW_LIMIT", 0)
    monkeypatch.setattr(G, "FRONTIER_BROADCAST_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shuffle_fallbacks_match_oracle(no_broadcast):
    import parity
    import __spark_entry__ as entry

    spark = no_broadcast
    con = parity.oracle_con(SF_SMALL)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name in QUERIES:
        df = qs[name](spark, SF_SMALL)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan, name
        if parity.rows_of(df.toPandas()) != parity.rows_of(con.execute(sqls[name]).df()):
            bad.append(name)
    assert not bad, bad
