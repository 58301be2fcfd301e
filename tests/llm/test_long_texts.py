"""A text of 100 MB through what each operator does to a text, within 1.2 GB of memory."""

import subprocess
import sys
from pathlib import Path

import pytest

SETUP = """
import resource, random, sys
import numpy as np, pyarrow as pa
from quillframe.llm import curve_packing, hashed_classifier, near_dedup, secrets, textvec
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(5000)]
part = " ".join(rng.choice(words) for _ in range(160_000))
text = part
while len(text) < 100_000_000:
    text += "\\n" + part[len(text) % 1000 :]
column = pa.array([text], pa.string())
secret = 'token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"'
"""
DONE = "\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
RUN = {
    "op1": "assert [x[0] for x in secrets.scan(text + ' ' + secret)] == ['hex_key']",
    "op2": "del text\nn = [len(s) for _, _, s, at in near_dedup._sets(column, 3)]\nassert n and n[0] > 100_000",
    "op3": "del text\nraw, at = textvec.buffers(column)\nx, n = curve_packing.project(raw[at[0] : at[1]], np.array([0, at[1]]), curve_packing.gaussian())\nassert n[0] > 10_000_000",
    "op6": "del text\nraw, at = textvec.buffers(column)\nm = hashed_classifier.Model(*np.ones((2, 1 << 18), np.float32), 0.0, 1.0, 0.0)\nassert abs(m.scores(raw, at)[0] - 2) < 1e-6\nf, v = hashed_classifier.features_of(raw, 1 << 18)\nassert abs(v.sum() - 2) < 1e-2",
}


@pytest.mark.parametrize("name", sorted(RUN))
def test_room_of_a_text_of_100_mb(name):
    run = subprocess.run([sys.executable, "-c", SETUP + RUN[name] + DONE], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-800:]
    print(name, run.stdout.strip(), "MB")
    assert int(run.stdout) < 1200
