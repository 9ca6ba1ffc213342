"""What a worker holds while it makes the passages' seeds and matches into blocks."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import re, sys
from types import SimpleNamespace
sys.path.insert(0, sys.argv[1])
import numpy as np
import pyarrow as pa
import zstandard
from barweave.llm import substring_chain
from barweave.llm.batches import give_back

class Documents:
    sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda key: "51"))
    def mapInArrow(self, run, kind):
        return run

def held(what):
    return int(re.search(what + r":\\s+(\\d+)", open("/proc/self/status").read()).group(1)) >> 10

substring_chain._read = lambda documents: documents
rng = np.random.default_rng(1)
lines = np.array([" ".join(map(str, rng.integers(0, 60_000, 30))) for _ in range(3000)], dtype=object)

def batches():
    for k in range(6):
        yield pa.RecordBatch.from_arrays([pa.array(range(1000 * k, 1000 * k + 1000)), pa.array([" ".join(rng.choice(lines, 11)) for _ in range(1000)])], names=["doc_id", "text"])

texts, count = list(batches()), 0
run = substring_chain.seeds(Documents())
substring_chain.tokenize([b"a"])
if sys.argv[2] == "matches":
    run, texts = lambda x: substring_chain._match_batches(x, 10), pa.concat_batches(list(run(iter(texts)))).sort_by("bucket")
    texts = [texts.slice(at, 64) for at in range(0, texts.num_rows, 64)]
    give_back()
open("/proc/self/clear_refs", "w").write("5")
before = held("VmRSS")
for block in run(iter(texts)):
    count += block.num_rows
    block = None
assert count >= 1024
print(held("VmHWM") - before)
"""


@pytest.mark.parametrize("what", ["seeds", "matches"])
def test_workers_hold_little(what):
    """Some 2 million seeds. With blocks of a million, copied whole at each step, these took 157 and 137 MB beside the input."""
    out = subprocess.run([sys.executable, "-c", CODE, str(ROOT), what], capture_output=True, text=True, timeout=120, check=True)
    print(out.stdout)
    assert int(out.stdout) < 100, out.stdout
