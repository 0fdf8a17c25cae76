"""Every query against its SQL, and those without SQL for a stable schema."""

import oracle
import pytest

from texloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_rows_equal_sql(spark, sf_dir, con, name):
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    first, second = (catalog.QUERIES[name](spark, sf_dir) for _ in range(2))
    assert first.schema == second.schema and first.count() == second.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark, sf_dir):
    plan = catalog.QUERIES["keyword_in_ids"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan and "EqualTo(quality,1)" in plan
