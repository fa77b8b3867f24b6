"""The entry points without the subpackage of training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from harvest import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("stages", [True, False])
def test_entry_without_the_subpackage(tmp_path, stages):
    shutil.copytree(ROOT / "harvest", tmp_path / "harvest", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if stages and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    names, with_sql = (line.split() for line in done.stdout.strip().splitlines())
    assert names == sorted(catalog.QUERIES) and with_sql == sorted(catalog.ORACLES)
