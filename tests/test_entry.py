"""Driver contract."""

import os

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "intervention_status" in df.columns


def test_oracles_are_for_registered_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_queries_load_without_a_session():
    """The registry is imported before any session exists."""
    import subprocess
    import sys
    code = "import __spark_entry__ as E; assert len(E.queries()) > 100 and set(E.oracle_sql()) <= set(E.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
