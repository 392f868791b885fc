import os
import subprocess
import sys
from pathlib import Path

FIT = """
import random, re
from pathlib import Path
import numpy as np, pyarrow as pa
from sedimenta.llm import toxicity

rng = random.Random(5)
known = [f"w{i}" for i in range(30_000)]
rows = [(" ".join(rng.choices(known, k=400)) + (" nasty" if i % 3 == 0 else ""), i % 3 == 0) for i in range(6000)]
table = pa.table({"id": pa.array(range(6000)), "text": [t for t, _ in rows], "label": pa.array([int(y) for _, y in rows]), "crc": pa.array(range(6000)), "h": pa.array(range(6000))})

class Sample:
    def toArrow(self):
        return table

toxicity.labelled_sample = lambda *a: Sample()
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10
before = held()
model = toxicity.fit(None, None)
print(held() - before)
"""


def test_training_gives_its_memory_back():
    """Of what a training takes on the driver, little more than the model (an entry for each bucket) stays."""
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", FIT], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 80, out.stdout
