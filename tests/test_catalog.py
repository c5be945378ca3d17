import pytest

from gridloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, agree):
    assert agree(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plan_of_overview(spark, sf_dir):
    """Partial sums before the shuffle, and a scan of two columns only."""
    plan = catalog.overview_average(spark, sf_dir)._jdf.queryExecution().toString()
    assert "partial_sum" in plan and plan.count("Exchange hashpartitioning") <= 2
    scan = plan[plan.rindex("ReadSchema") :].split("\n")[0]
    assert "o_totalprice" in scan and "o_orderpriority" not in scan


def test_entry_needs_no_session():
    import os
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 40)"], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=120)
    assert said.stdout.strip() == "True", said.stderr
