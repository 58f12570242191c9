"""The driver's entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert {"final_quote", "flatten_request"} <= names and set(e.oracle_sql()) <= names
print(len(names), sum(n.startswith("op") for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("missing", [("samplequote/llm", "tests/llm"), ("samplequote/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports_without(tmp_path, missing):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.parquet"))
    for m in missing:
        shutil.rmtree(copy / m) if (copy / m).is_dir() else os.remove(copy / m) if (copy / m).exists() else None
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, ops, pipeline = done.stdout.split()
    assert pipeline == "False" and (int(ops) == 0 or "samplequote/llm" not in missing)
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests/test_oracles.py"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0 and collected.stdout.count("test_query_matches_oracle") == int(n) - int(ops)
