"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("whole", [True, False])
def test_entry_imports(tmp_path, whole):
    for name in ("gridloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *([] if whole else ["llm"])))
        elif source.exists() and (whole or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    there = whole and (ROOT / "gridloom/llm").exists()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, ops, pipeline = said.stdout.split()
    assert int(n) > 50 and (int(ops), pipeline) == ((10, "True") if there else (0, "False"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
