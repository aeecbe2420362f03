"""What Python workers hold between tasks."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import gc, re, sys
from collections import deque
import pyarrow as pa
sys.path.insert(0, {root!r})
{prepare}
def held():
    gc.collect()
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
last = []
def run(batches):
    for batch in batches:
        texts = [t.lower() for t in batch.column(0).to_pylist()]
        last.append(texts[-1])  # holds the end of the heap
        yield batch
def batches():
    for i in range(3):
        yield pa.RecordBatch.from_arrays([pa.array([f"{{j}} " * 300 for j in range(20_000)])], ["text"])
before = held()
deque({task}(batches()), 0)
print(held() - before)
"""


def grown(prepare: str, task: str) -> float:
    code = CODE.format(root=str(Path(__file__).parents[2]), prepare=prepare, task=task)
    return float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_tasks_give_memory_back():
    plain, lean = grown("", "run"), grown("from tidalspan.llm.workers import lean", "lean(run)")
    assert 2 * lean < plain


@pytest.mark.parametrize("module", ["near_dedup", "language_id", "decontaminate"])
def test_stages_of_the_pipeline_are_lean(module):
    code = (Path(__file__).parents[2] / "tidalspan" / "llm" / f"{module}.py").read_text()
    assert re.findall(r"mapInArrow\((?!\s*lean\()", code) == []
