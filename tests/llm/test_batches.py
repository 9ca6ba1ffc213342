"""Batches in tasks: memory that a worker gives back, and texts that few others travel with."""

import subprocess
import sys
from pathlib import Path

import pytest

from barweave.llm import shared

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import re, sys
sys.path.insert(0, sys.argv[1])
import pyarrow as pa
from barweave.llm.batches import grouped, pieces_of

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read()).group(1)) >> 10

def batches():
    for k in range(12):
        yield pa.RecordBatch.from_arrays([pa.array([k] * 4000), pa.array([bytes([65 + k]) * 3000] * 4000)], names=["k", "text"])

pa.array([b"x"]).cast("string")
before = held()
kept = [x.column(1).cast("string").nbytes for x in (pieces_of if sys.argv[2] == "pieces" else grouped)(batches())]
print(held() - before)
"""


@pytest.mark.parametrize("how", ["pieces", "grouped"])
def test_workers_give_memory_back(how):
    out = subprocess.run([sys.executable, "-c", CODE, str(ROOT), how], capture_output=True, text=True, timeout=60, check=True)
    assert int(out.stdout) < 30, out.stdout  # the last batch; all that was read is 140 MB


def test_texts_among_ids(spark):
    rows = spark.createDataFrame([(i, f"text {i}" if i % 5 else None) for i in range(-2000, 2000)] + [(7, "again"), (None, "x")], "doc_id long, text string")
    wanted = spark.createDataFrame([(i,) for i in range(-2000, 2000, 40)] + [(7,), (7,)], "of long")
    found = shared.packed_among(rows, wanted).join(wanted.distinct(), shared.F.col("doc_id") == shared.F.col("of"))
    assert sorted(r["doc_id"] for r in found.collect()) == sorted([*range(-2000, 2000, 40), 7, 7])
    assert shared.packed_among(rows, wanted).count() < 500 and shared.packed_among(rows, wanted.where("false")).count() == 0
