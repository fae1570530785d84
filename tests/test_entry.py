"""The driver contract, with and without the subpackage that may be taken away."""

import collections
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from glossloom.plans import registry
from glossloom.session import ROOT

TESTDATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")


def rounded(x):
    return round(x, 6) if isinstance(x, float) else x


@needs_tables
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_queries_have_their_sql_s_rows(spark, name):
    rows = registry.QUERIES[name](spark, TESTDATA)
    names = sorted(rows.columns)
    got = collections.Counter(tuple(rounded(r[c]) for c in names) for r in rows.collect())
    if name not in registry.ORACLES:
        assert got
        return
    db = duckdb.connect()
    for t in os.listdir(TESTDATA):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS FROM '{TESTDATA}/{t}'")
    found = db.execute(registry.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    assert collections.Counter(tuple(rounded(r[at.index(c)]) for c in names) for r in found.fetchall()) == got


@needs_tables
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e, sys; print(len(e.queries()), len(e.oracle_sql()), [m for m in sys.modules if 'llm' in m and m.startswith('glossloom')])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[:2] == [str(len(registry.QUERIES)), str(len(registry.ORACLES))], out.stderr
    assert out.stdout.strip().endswith("[]")
