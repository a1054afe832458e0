"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert sql <= names and len(names) > 80


@pytest.mark.parametrize("left_in", [(), ("corpus_pipeline.py",)])
def test_without_the_subpackage(tmp_path, left_in):
    for p in ("querent", "__spark_entry__.py", *left_in):
        os.system(f"cp -r {REPO / p} {tmp_path}/")
    gone = tmp_path / "querent" / "llm"
    gone.rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
