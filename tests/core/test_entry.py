import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import __spark_entry__ as e

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no driver tables here")
def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["id", "total", "o_orderpriority"] and df.count() == 10


def test_entry_imports_without_a_session():
    import subprocess

    code = "import __spark_entry__ as e; print(len(e.queries()) > 100, set(e.oracle_sql()) <= set(e.queries()))"
    root = str(Path(__file__).parents[2])
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split() == ["True", "True"]


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
    from docspark import queries as core

    assert set(core.ORACLES) == set(core.QUERIES)
