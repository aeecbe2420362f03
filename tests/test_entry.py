"""The driver contract holds with and without the corpus operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_corpus_operators(tmp_path):
    away = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=away)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"],
                          cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert said.stdout.split() == ["134", "True"], said.stderr
    assert not [n for n in os.listdir(tmp_path / "repo" / "tidalspan") if n == "llm"]


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "tidalspan")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, n)).read(), n
