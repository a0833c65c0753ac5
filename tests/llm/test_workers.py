"""Memory of workers: a column is coded run by run, and what a task has freed is returned."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from lodestone.llm import pieces

HELD = """
import random, re, sys, threading, time
from pathlib import Path
import pyarrow as pa
from lodestone.llm import tokens, wordbpe, workers

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

class Plan:
    "Stands for a table: hands the worker's function over."
    sparkSession = sparkContext = property(lambda self: self)
    schema = type("S", (), {"fields": [None]})
    def select(self, *columns): return self
    def broadcast(self, value): return type("B", (), {"value": value})
    def mapInArrow(self, run, schema): return run

tokens.F = type("F", (), {"coalesce": lambda *a: Plan(), "col": str, "lit": str})
Plan.alias = lambda self, name: self
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300_000)]
column = pa.array([" ".join(rng.choices(words, k=450)) for _ in range(4000)])
del words
run = tokens.encode_decode(Plan(), [], lexicon=wordbpe.build_lexicon({b"a": [1]}), digests=True)
wordbpe.worker_encoder(wordbpe.default_tokenizer(), wordbpe.build_lexicon({b"a": [1]}))
before, most, over = held(), 0, False

def watch():
    global most
    while not over:
        most = max(most, held())
        time.sleep(0.01)

thread = threading.Thread(target=watch)
thread.start()
rows = sum(len(b) for b in run(iter([pa.RecordBatch.from_arrays([column], names=["_text"])])))
over = True
thread.join()
print(rows, round(most - before), round(held() - before))
"""


def test_coding_holds_little_and_returns_it():
    if not sys.platform.startswith("linux"):
        pytest.skip("reads /proc")
    rows, most, left = map(int, subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=120, cwd=Path(__file__).parents[2]).stdout.split())
    assert rows == 4000
    assert most < 95 and left < 45


def test_runs_of_a_column(monkeypatch):
    monkeypatch.setattr(pieces, "RUN_POINTS", 5)
    texts = ["ab", "", "çdé", "x" * 9, "", "y"]
    got = list(pieces.runs(pa.array(["left out", *texts]).slice(1)))
    assert [t for _, _, own in got for t in own] == texts
    assert [(a, b) for a, b, _ in got] == [(0, 3), (3, 4), (4, 6)]
    assert list(pieces.runs(pa.array([], pa.string()))) == []
