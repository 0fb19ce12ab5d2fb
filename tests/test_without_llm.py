"""The library without its training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("lumispan/llm",), ("lumispan/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_loads_without_parts(tmp_path, gone):
    for name in ("lumispan", "__spark_entry__.py", "corpus_pipeline.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "lumispan/llm" in gone else [])))
        elif source.exists() and name not in gone:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 70 and 'pipeline' not in q and set(s) <= set(q); print(sum(k.startswith('op') and k[2].isdigit() for k in q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    there = (REPO / "lumispan/llm").exists() and "lumispan/llm" not in gone
    assert there == (out.stdout.strip() != "0")
