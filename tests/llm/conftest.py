from __future__ import annotations

import os
import random
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))
# The Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parents[1]), os.environ.get("PYTHONPATH", "")])

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 string, span int"


def _words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, periodic, very long, blank and null texts, a repeated row."""
    rng = random.Random(7)
    base = _words(rng, 300)
    passage = _words(rng, 60)
    near = base.copy()
    near[150] = "changed"
    rows = [(i, "\n".join(" ".join(_words(rng, 40)) for _ in range(3))) for i in range(10, 22)]
    rows += [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(_words(rng, 50) + passage + _words(rng, 50)))]
    rows += [(5, " ".join(passage + _words(rng, 20))), (6, "ab " * 400), (7, "x" * 1500), (8, None), (9, ""), (30, "  \t\n ")]
    rows += [(31, " ".join(_words(rng, 30000, 5000))), (32, "Éa 漢字 😀 " * 60), (33, "one"), (34, "ONE"), (35, "é" * 99 + "z")]
    rows += [(36, "Released under the MIT License.\nApache License, Version 2.0 and CC BY-NC 4.0, under the MIT license"), (36, None)]
    return [*rows, rows[0], (None, " ".join(passage)), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][k % 3], "s" if k % 2 else None, None, "clash", 1) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert got == want, next((g, w) for g, w in zip(got, want) if g != w)


@pytest.fixture(name="same")
def _same():
    return same
