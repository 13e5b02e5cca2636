"""Every registered query against its DuckDB oracle on the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from tests.conftest import SF_SMALL  # noqa: E402


def test_all_queries_match_oracle(spark):
    import parity
    import __spark_entry__ as entry

    con = parity.oracle_con(SF_SMALL)
    sqls = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        sdf = fn(spark, SF_SMALL).toPandas()
        if name not in sqls:
            continue
        odf = con.execute(sqls[name]).df()
        if parity.rows_of(sdf) != parity.rows_of(odf):
            bad.append(name)
    assert not bad, bad


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


@pytest.mark.parametrize("name", ["links_strict", "top_domains"])
def test_plans_push_down_projection(spark, name):
    """The page scan reads only the columns a query needs."""
    import __spark_entry__ as entry
    plan = entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "FileScan parquet" in plan
