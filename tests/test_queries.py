"""Every registered query of the catalogue against its DuckDB counterpart on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle_compare import connection, same

from jobs import queries as jobs
from tallyspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DATA)
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert same(df, con, sql) == ""


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_folders(tmp_path, pipeline):
    """A copy of the tree without the subpackage and its tests still lists its queries, whether the pipeline's file is there or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tallyspark"), tmp_path / "tallyspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(root, "jobs"), tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and os.path.exists(os.path.join(root, "corpus_pipeline.py"))):
        shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    names = out.stdout.split()
    assert set(names) == set(catalogue.queries()) | set(jobs.queries())
