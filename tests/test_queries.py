"""Every registered query against its SQL twin, run by another engine over the same tables."""

import pytest

from spanlake.plans import ORACLE, QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, data, duck, name):
    got = rows(QUERIES[name](spark, data).toArrow())
    assert got == rows(duck.sql(ORACLE[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["item_id", "doc_id", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 100"], cwd=root, check=True)
