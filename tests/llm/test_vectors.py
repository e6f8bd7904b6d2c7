from __future__ import annotations

import math
import random

import brute
import pytest

from adloom.llm import metric_join

SCHEMA = "vec_id long, embedding array<double>, label int, node string"


def _rows():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.18) for x in centres[i % 12]], i % 3, "clash") for i in range(180)]
    rows += [(200 + i, [2.0 * x for x in rows[0][1]], 0, None) for i in range(5)]
    rows += [(300, None, 1, None), (301, [0.0] * 8, 1, None), (302, [1.0, None] * 4, 1, None), (303, [float("nan")] * 8, 1, None)]
    return rows + [(304, rows[1][1], None, None), (305, [1.0, 2.0], 1, None), (306, [float("inf")] * 8, 1, None)]


@pytest.mark.parametrize("sizes", [{"cell": 2048, "block": 2048}, {"cell": 10, "block": 7}])
def test_links(spark, sizes):
    rows = _rows()
    found = metric_join.range_links(spark.createDataFrame(rows, SCHEMA), **sizes)
    assert sorted(tuple(r) for r in found.collect()) == brute.vectors([r[:3] for r in rows])


def test_chains_across_cells(spark):
    """Chains whose ends are not linked, every vector in a cell of its own, the hashes in every order."""
    step = math.radians(20)
    rows = [(10 * label + i, [math.cos(i * step), math.sin(i * step)], label) for label in range(60) for i in range(3 + label % 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    hashes = vectors.where("vec_id % 10 < 3").selectExpr("label", "vec_id", "xxhash64(string(label), embedding) AS h").collect()
    by_label: dict = {}
    for r in sorted(hashes, key=lambda r: r.h):
        by_label.setdefault(r.label, []).append(r.vec_id % 10)
    assert len({tuple(order) for order in by_label.values()}) == 6
    found = metric_join.range_links(vectors, cell=1, block=1)
    assert sorted(tuple(r) for r in found.collect()) == brute.vectors(rows)


def test_empty(spark):
    assert metric_join.range_links(spark.createDataFrame([], SCHEMA)).count() == 0
