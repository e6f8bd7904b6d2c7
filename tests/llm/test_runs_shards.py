"""Periodic runs and shards of equal bytes against plain versions, with every defined case."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import grams, histogram_shards, periodic_runs, queries


def found(sequences, shortest):
    words = np.array([hash(w) & (1 << 64) - 1 for s in sequences for w in s], np.uint64)
    return [tuple(r) for r in periodic_runs.find_runs(grams.mix(words), [len(s) for s in sequences], shortest).tolist()]


def sequence(rng: random.Random) -> list[str]:
    """Words with nested and neighbouring periods, among them those of which a block is periodic itself."""
    kind = rng.randrange(4)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randrange(300))]
    if kind == 1:
        a, b = "a", "ab"
        while len(b) < 300:
            a, b = b, b + a
        return list(b[: rng.randrange(300)])
    out = []
    while len(out) < 250:
        part = [rng.choice("ab")] * rng.randrange(1, 20) + [rng.choice("abc") for _ in range(rng.randrange(4))]
        part = part * rng.randrange(1, 6) + ["c"] * rng.randrange(2) if kind == 2 else [rng.choice("abc") for _ in range(rng.randrange(1, 50))]
        out += (part * rng.randrange(1, 8))[: rng.randrange(1, 200)]
    return out


@pytest.mark.parametrize("shortest", [3, 12, 24, 30])
def test_runs_of_sequences(shortest):
    rng = random.Random(shortest)
    for _ in range(25):
        some = [sequence(rng) for _ in range(6)] + [[], ["a"]]
        assert found(some, shortest) == [(i, *r) for i, s in enumerate(some) for r in brute.runs(s, shortest)]


def test_no_block_stands_twice():
    """Eight words stand twice, but nowhere from a multiple of eight on."""
    again = [f"w{i}" for i in range(8)]
    assert found([["a", *again, "b", "c", *again]], 24) == []
    assert found([[], ["a", *again, "b", "c", *again], ["z"]], 24) == []


def test_range_successor():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1000, 500)
    tree = periodic_runs.WaveletMatrix(values, 10)
    lo = rng.integers(0, 500, 200)
    hi = np.minimum(500, lo + rng.integers(0, 60, 200))
    least = rng.integers(0, 1000, 200)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(lo, hi, least)]
    assert tree.successor(lo, hi, least, -1).tolist() == want


def test_periodic_documents(docs, texts, none, same):
    plain = periodic_runs.collapse_runs(docs, carry=("k1", "span"))
    assert plain.columns == ["id", "kept", "n_words", "runs", "best", "k1", "span"]
    got = [(r.id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in plain.collect()]
    want = [(i, len(w), brute.runs(w), brute.collapse(w, brute.runs(w))) for i, t in texts for w in [brute.words(t)]]
    same(got, want)
    assert any(r[2] for r in want)
    empty = periodic_runs.collapse_runs(none)
    assert empty.count() == 0


def test_periodic_query(spark, docs, texts, none, tmp_path, same):
    """The query's own texts, with periodic tails, from the row's id on; exact ties of exponents included."""
    more = [(i, " ".join(f"w{(i * k) % 97}" for k in range(i % 170))) for i in range(100, 400)]
    docs.union(spark.createDataFrame([(i, t, None, None, None, "k", 0) for i, t in more], docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op12_internal_matching"](spark, str(tmp_path)).collect()
    same([tuple(r) for r in got], [brute.periodic(i, t) for i, t in [*texts, *more]])
    assert sum(r.n_runs > 0 for r in got) > 10


def sizes_of(rows):
    return [len((t or "").encode()) + 1 for _, t in rows]


@pytest.mark.parametrize("parts", [1, 3])
def test_shards(docs, texts, none, same, parts):
    placed = histogram_shards.shard_documents(docs, shards=4, parts=parts, tolerance=0.0, carry=("k1", "span"))
    assert placed.columns == ["id", "text", "size", "text_crc32", "shard", "slot", "k1", "span"]
    same(placed.drop("k1", "span").collect(), brute.shards(texts, 4))
    assert histogram_shards.shard_documents(none).count() == 0


def test_hot_group_is_cut(spark, tmp_path, same):
    """A text that a third of the rows repeat, one row that stands many times, and ids without value."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"t{rng.randrange(999)}" for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [(1000 + i, "the same text again and again") for i in range(200)] + [(7777, "one row, often")] * 100 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = histogram_shards.shard_documents(docs, shards=8, parts=2, tolerance=0.0)
    same(placed.collect(), brute.shards(rows, 8))
    loose = histogram_shards.shard_documents(docs, shards=8, parts=2, tolerance=0.05)
    held = loose.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert sum(r.bytes for r in held) == sum(sizes_of(rows)) and all(r.slots == r.last + 1 for r in held)
    mean, longest = sum(sizes_of(rows)) / 8, max(sizes_of(rows))
    assert all(abs(r.bytes - mean) <= 0.05 * mean + longest for r in held)
    histogram_shards.write_shards(loose, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == len(rows) and again.select("shard").distinct().count() == 8


def test_fewer_rows_than_shards(spark, same):
    rows = [(1, "a"), (2, None), (3, "x" * 5000)]
    same(histogram_shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.0).collect(), brute.shards(rows, 16))


def test_crc_of_text(spark, docs, texts, same):
    placed = histogram_shards.shard_documents(docs, shards=2)
    same(placed.select("id", "text_crc32").collect(), [(i, zlib.crc32((t or "").encode())) for i, t in texts])
