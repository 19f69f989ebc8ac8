"""The engine without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "timeline" in q and set(o) <= set(q), sorted(q)
print(*sorted(x for x in q if x.startswith("op") and x[2].isdigit() or x == "pipeline"))
"""


@pytest.mark.parametrize("gone", [("reelquery/llm", "tests/llm"), ("reelquery/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without(tmp_path, gone):
    repo = tmp_path / "repo"
    shutil.copytree(ROOT, repo, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for name in gone:
        if (repo / name).is_dir():
            shutil.rmtree(repo / name)
        else:
            (repo / name).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=repo, env=os.environ | {"PYTHONPATH": str(repo)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    if "reelquery/llm" in gone:
        assert not said.stdout.split()
    else:
        assert "pipeline" not in said.stdout.split()
