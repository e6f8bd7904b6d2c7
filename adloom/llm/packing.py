"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the largest sequence are cut. Pieces are dealt to shards of bounded size, and each shard packs
its own, longest first: a piece goes to the open bin it leaves the least room in. If it fits none, the bin size with the
least cost is opened, where room left over is credited at a rate; several rates are tried and the cheapest whole result is
kept. Finally every bin is reduced to the smallest permitted length that holds its contents.

The cost of a sequence grows with its length and, for attention, with its square. Only ids and lengths reach the shards.

Defined cases: a null, empty or blank text has no tokens and stays out of every bin (bin_id null); repeated rows are packed
each; a null id is packed like any other; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.shared import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
ATTENTION = 8192  # length at which the quadratic part equals the linear one
CREDITS = (0.0, 0.5, 0.8, 0.95, 1.0)
SHARD_PIECES = 4096
PACKED = "id long, piece int, start long, length long, bin_id long, capacity long, at long"


def cost(length: int) -> float:
    return length + length * length / ATTENTION


def token_count(text: Column) -> Column:
    """Words and one end token; 0 without words."""
    n = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(n > 0, n + 1).otherwise(0).cast("long")


def best_fit(sizes: Sequence[int], lengths: Sequence[int], credit: float) -> list[int]:
    """Bin of every piece; ``sizes`` descend. ``credit`` is what a token of room left is worth, relative to the best price."""
    price = credit * min(cost(c) / c for c in lengths)
    opening = {}
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    bins, count = [], 0
    for size in sizes:
        spot = bisect_left(room, (size, -1))
        if spot < len(room):
            left, chosen = room.pop(spot)
        else:
            if size not in opening:
                opening[size] = min((c for c in lengths if c >= size), key=lambda c: (cost(c) - price * (c - size), c))
            left, chosen = opening[size], count
            count += 1
        bins.append(chosen)
        if left > size:
            insort(room, (left - size, chosen))
    return bins


def pack_shard(sizes: Sequence[int], lengths: Sequence[int]) -> tuple[list[int], list[int]]:
    """(bin of every piece, final length of every bin) of the cheapest opening rate; ``sizes`` descend."""
    best = None
    for credit in CREDITS:
        bins = best_fit(sizes, lengths, credit)
        filled = [0] * (max(bins) + 1)
        for b, size in zip(bins, sizes, strict=True):
            filled[b] += size
        final = [min(c for c in lengths if c >= f) for f in filled]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, final
    return best[1], best[2]


def _pack(lengths: Sequence[int]):
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        sizes = table.column("length").to_pylist()
        bins, final = pack_shard(sizes, lengths)
        filled, at = [0] * len(final), []
        for b, size in zip(bins, sizes, strict=True):
            at.append(filled[b])
            filled[b] += size
        shard = table.column("shard")[0].as_py() << 24
        new = {"bin_id": [shard + b for b in bins], "capacity": [final[b] for b in bins], "at": at}
        kept = {c: table.column(c) for c in ("id", "piece", "start", "length")}
        return pa.table({**kept, **{k: pa.array(v, pa.int64()) for k, v in new.items()}})

    return work


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """(id, piece, start, length, bin_id, capacity, at): where the tokens [start, start + length) of a document stand."""
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counted = docs.select(F.col(id_col).cast("long").alias("id"), token_count(text).alias("tokens"))
    counted = stored(counted.withColumn("row", F.monotonically_increasing_id()), "lengths")
    pieces = counted.select("id", "row", "tokens", F.posexplode(F.expr(f"sequence(0L, greatest(tokens - 1, 0L) DIV {longest})")).alias("piece", "i"))
    pieces = pieces.select(
        "id", "row", "piece", (F.col("i") * longest).alias("start"), F.least(F.lit(longest), F.col("tokens") - F.col("i") * longest).alias("length")
    )
    shards = max(1, -(-pieces.count() // shard_pieces))
    full = pieces.where("length > 0").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    packed = full.groupBy("shard").applyInArrow(_pack(lengths), PACKED)
    none = F.lit(None).cast("long")
    empty = pieces.where("length = 0").select("id", "piece", "start", "length", none.alias("bin_id"), none.alias("capacity"), none.alias("at"))
    return packed.union(empty)
