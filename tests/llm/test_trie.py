"""The conversation trie against a plain trie, with every defined case."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from adloom.llm import conversation_trie, queries

ROWS = "conv_id long, turn long, role string, text string, n long, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def turns() -> list[tuple]:
    """(conv_id, turn, role, text): copies, snapshots of one growing conversation, long ones, shared beginnings, nulls and ties."""
    rng = random.Random(3)
    rows = []
    pool = [(rng.choice(["user", "assistant", None]), rng.choice(["a b", " a  b", "", None, "c\td e", "f"])) for _ in range(6)]
    for c in range(0, 160):
        length = rng.randrange(0, 6)
        rows += [(c, t, *rng.choice(pool)) for t in range(length)]
    rows += [(c, t, "user", f"turn {t} of many") for c in range(200, 210) for t in range(c - 198)]
    rows += [(c, t, "user", f"long {t}") for c in (300, 301, 340) for t in range(120)]
    rows += [(400, None, "system", "first"), (400, 0, "user", "second"), (400, 0, "user", "tie"), (400, 0, "user", "tie")]
    rows += [(-7, 1, "user", "below zero"), (-40, 1, "user", "x y z"), (None, 0, "user", "nobody's"), (500, 0, None, None), (520, 3, "user", "w " * 4000)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], ROWS).repartition(4)


def test_trie(spark, turns, same):
    got = conversation_trie.conversation_trie(table(spark, turns)).select(*COLUMNS).collect()
    same([tuple(r) for r in got], brute.trie(brute.conversations(turns)))


def test_rebuilt(spark, turns, same, tmp_path, monkeypatch):
    """The query, with pieces of two ids, so that the lists of ends are put together from several."""
    monkeypatch.setattr(conversation_trie, "PIECE", 2)
    table(spark, turns).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.queries()["op11_truncation_peeling"](spark, str(tmp_path)).collect()
    want = brute.trie(brute.rebuilt(brute.conversations(turns)))
    same([tuple(r) for r in got], want)
    assert any(r[3] > 1 and r[1] > 3 for r in want)


def test_empty(spark):
    assert conversation_trie.conversation_trie(table(spark, [])).count() == 0


def test_running_over_cut_groups(spark, same):
    """A group that holds most rows is numbered across many partitions."""
    rng = random.Random(9)
    rows = [(7 if rng.random() < 0.8 else rng.randrange(20), k, rng.randrange(50)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g long, k long, x long")
    apart = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in apart}
    try:
        for k, v in apart.items():
            spark.conf.set(k, v)
        got = conversation_trie.running(df, "g", ["k"], {"total": F.col("x")}).select("g", "k", "pos", "total").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want, seen = [], {}
    for g, k, x in sorted(rows, key=lambda r: r[1]):
        pos, total = seen.get(g, (0, 0))
        want.append((g, k, pos, total + x))
        seen[g] = (pos + 1, total + x)
    same([tuple(r) for r in got], want)
