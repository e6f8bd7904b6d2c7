"""Exact cosine range join of vectors with equal labels, by pivots in the metric of unit vectors.

On unit vectors ``cosine >= c`` is a distance of at most ``r = sqrt(2 - 2c)``. Sampled pivots divide the space into cells of
the nearest pivot. A vector at distance ``d`` from its own pivot and ``e`` from another can reach a vector of
that other cell only if ``e - d <= 2r`` (triangle inequality); where both pivots' distance is known the plane between them
gives ``(e*e - d*d) / (2 * between) <= r`` as well. Such vectors are copied to the other cell, and each cell joins its own
vectors with all it holds, independently. A cell with many vectors is split into a grid of blocks, so no task holds more
than two blocks. Blocks return sums and one edge per vector asking or held, never all pairs.

Equal vectors of a label are compared once and count with their number. Pivots are a bounded sample (``max_pivots``); the
result does not depend on it.

Defined cases: a null label, a null or zero vector, or one with null or non-finite components links with nothing; vectors
of different length are never linked; repeated rows count as separate vectors; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm.shared import components, stored

PLACED = "node long, space string, cell int, core boolean, w long, vec array<double>"
BLOCK = "node long, links long, root long"
_SLACK = 1e-9


def _unit(batch_column: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in batch_column.to_pylist()])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _place(distinct: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space = np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(space)):
                rows = np.flatnonzero(space == name)
                part = batch.take(pa.array(rows))
                unit = _unit(part.column(3))
                centre = pivots.get(name)
                if centre is None:
                    at, cell, core = np.arange(rows.size), np.zeros(rows.size, int), np.ones(rows.size, bool)
                else:
                    d = np.sqrt(np.maximum(2 - 2 * unit @ centre.T, 0))
                    own = d.argmin(1)
                    near = d[np.arange(rows.size), own][:, None]
                    between = np.sqrt(np.maximum(2 - 2 * centre @ centre.T, 0))[own]
                    plane = d * d - near * near <= 2 * between * (radius + _SLACK) + _SLACK
                    at, cell = np.nonzero((d - near <= 2 * radius + _SLACK) & plane)
                    core = cell == own[at]
                out = part.take(pa.array(at))
                vectors = pa.array(list(unit[at]), pa.list_(pa.float64()))
                columns = [out.column(0), out.column(1), pa.array(cell, pa.int32()), pa.array(core), out.column(2), vectors]
                yield pa.RecordBatch.from_arrays(columns, ["node", "space", "cell", "core", "w", "vec"])

    return distinct.select("node", "space", "w", "vec").mapInArrow(work, PLACED)


def _local_roots(linked: np.ndarray, query: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and each target the smallest node it is connected with inside the block."""
    mine, theirs = query.copy(), target.copy()
    rows, columns = np.nonzero(linked)
    while rows.size:
        before = mine.copy(), theirs.copy()
        np.minimum.at(mine, rows, theirs[columns])
        np.minimum.at(theirs, columns, mine[rows])
        if (mine == before[0]).all() and (theirs == before[1]).all():
            break
    return mine, theirs


def _join_block(min_cosine: float):
    def work(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("ask").to_pylist(), bool)
        unit = np.stack([np.asarray(v, np.float64) for v in table.column("vec").to_pylist()]) if len(table) else np.zeros((0, 1))
        node, weight = (np.array(table.column(c).to_pylist(), np.int64) for c in ("node", "w"))
        query, target = np.flatnonzero(asks), np.flatnonzero(~asks)
        linked = unit[query] @ unit[target].T >= min_cosine
        linked &= node[query][:, None] != node[target][None, :]
        links = linked @ weight[target]
        mine, theirs = _local_roots(linked, node[query], node[target])
        # A target may be asked about in other cells only: without its edge the two ends of a link can fall apart.
        held = np.flatnonzero(theirs != node[target])
        nodes, roots = np.concatenate((node[query], node[target][held])), np.concatenate((mine, theirs[held]))
        counts = np.concatenate((links, np.zeros(held.size, links.dtype)))
        return pa.table({"node": nodes, "links": pa.array(counts, pa.int64()), "root": roots})

    return work


def range_links(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.93,
    cell: int = 2048,
    max_pivots: int = 4096,
    block: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row: vectors linked directly, and the smallest id reachable by links."""
    radius = math.sqrt(2 - 2 * min_cosine)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).cast("string").alias("label")
    )
    usable = F.expr(
        "label IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
        " AND exists(vec, x -> x <> 0)"
    )
    node = F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vec"))
    rows = rows.withColumn("node", node)
    space = F.concat_ws(":", F.first(F.size("vec")), F.first("label"))
    distinct = stored(
        rows.where("node IS NOT NULL").groupBy("node").agg(
            space.alias("space"), F.count(F.lit(1)).alias("w"), F.min("id").alias("id"), F.first("vec").alias("vec")
        ),
        "vectors",
    )
    share = min(1 / cell, max_pivots / max(1, distinct.count()))
    picked = distinct.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    chosen: dict[str, list] = {}
    for r in picked.orderBy(F.xxhash64("node")).limit(max_pivots).select("space", "vec").collect():
        chosen.setdefault(r["space"], []).append(np.asarray(r["vec"], np.float64))
    pivots = {k: np.stack([v / np.linalg.norm(v / np.abs(v).max()) / np.abs(v).max() for v in vs]) for k, vs in chosen.items()}

    placed = stored(_place(distinct, pivots, radius), "cells")
    sizes = stored(
        placed.groupBy("space", "cell").agg(
            F.ceil(F.count_if("core") / block).cast("int").alias("asking"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("held")
        ),
        "cell-sizes",
    )
    sized = placed.join(sizes.where("asking > 0"), ["space", "cell"])
    spot = F.xxhash64("node", F.lit("block"))
    asks = sized.where("core").select(
        "space", "cell", F.pmod(spot, "asking").alias("i"), F.explode(F.expr("sequence(0L, held - 1L)")).alias("j"), F.lit(True).alias("ask"), "node", "w", "vec"
    )
    holds = sized.select(
        "space", "cell", F.explode(F.expr("sequence(0L, asking - 1L)")).alias("i"), F.pmod(spot, "held").alias("j"), F.lit(False).alias("ask"), "node", "w", "vec"
    )
    joined = asks.union(holds).groupBy("space", "cell", "i", "j").applyInArrow(_join_block(min_cosine), BLOCK)
    found = stored(joined.where("links > 0 OR root <> node"), "links")
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.select("node", "w", "id").join(linked, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("id").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("w") - 1
    named = stored(known.join(smallest, "component").select("node", n_links.alias("n_links"), "component_id"), "names")
    component = F.expr("if(node IS NULL, id, component_id)")
    return rows.select("id", "node").join(named, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )
