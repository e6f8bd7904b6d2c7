"""Dealing documents to shards of equal bytes by a histogram sort.

Rows are ordered by (digest of the text, digest of the row, number of the row in a stored copy), so equal texts stand together and yet
no group is too large to be cut. The shards are ranges of this order, and each consists of several parts, one for a task each:

1. Every open splitter has two known keys around it, with the exact bytes and rows below them. Each round draws candidate keys
   among the rows between the two (about ``PROBES`` for each splitter, whatever the number of rows), counts the exact bytes and rows below
   every candidate in all partitions, and narrows the brackets.
2. A splitter is done when the bytes below a candidate are within its tolerance, or when no row is left between its two keys:
   then the nearer one is as good as any.
3. When all are done, rows are exchanged once, to their parts. The rows below every splitter are known from the counts, so the place
   in the shard is the row's number within its part plus a constant of the part.

Candidates are rows drawn by hash, so brackets shrink about ``PROBES`` times each round whatever the distribution of keys: the number of
rounds is logarithmic. The driver holds a few numbers for each splitter and candidate, never rows; these lists are what is broadcast.

Defined cases: a null text counts as empty, with one byte of its own as every row; null ids are kept; repeated rows are rows
like others; a document longer than the tolerance makes shards differ by as much; an empty table gives no rows, and fewer
rows than shards leave shards empty; other columns are carried where asked for, under their own names.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.shared import stored

KEY = ("k1", "k2", "k3")
# Expected candidates of each open splitter in a round, and the leading bits by which keys are looked up.
PROBES = 24
PREFIX = 8
KEY_BITS = 60
LOOKUP = "prefix int, first int, keys array<struct<k1:bigint,k2:bigint,k3:bigint>>"

Key = tuple[int, int, int]
LEAST: Key = (-1, -1, -1)


def digest_key(*columns: Column) -> Column:
    """The first 60 bits of the MD5 digest; a null among the columns is marked as such."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *marked).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("bigint")


@dataclass
class Splitter:
    """A cut of the order at ``target`` bytes: (bytes, rows) below the known keys around it. A ``hi`` of None is the end."""

    target: float
    tolerance: float
    below_hi: tuple[int, int]
    lo: Key = LEAST
    below_lo: tuple[int, int] = (0, 0)
    hi: Key | None = None
    done: bool = field(default=False)

    def __post_init__(self) -> None:
        self._settle()

    def narrow(self, key: Key, below: tuple[int, int]) -> None:
        if key <= self.lo or (self.hi is not None and key >= self.hi):
            return
        if below[0] <= self.target:
            self.lo, self.below_lo = key, below
        else:
            self.hi, self.below_hi = key, below
        self._settle()

    def _settle(self) -> None:
        near = min(self.target - self.below_lo[0], self.below_hi[0] - self.target)
        # One row left between the two keys is the one at ``lo`` itself.
        self.done = near <= self.tolerance or self.below_hi[1] - self.below_lo[1] <= 1

    def chosen(self) -> tuple[Key | None, int]:
        """The nearer key, the lower one of two equally near, and the rows below it."""
        if self.target - self.below_lo[0] <= self.below_hi[0] - self.target:
            return self.lo, self.below_lo[1]
        return self.hi, self.below_hi[1]


def _numbered(rows: DataFrame, keys: Sequence[Key], name: str) -> DataFrame:
    """Adds ``name``: how many of the ascending ``keys`` are not greater than the row's key.

    The leading bits lead to the few keys that share them, which are searched by halving.
    """
    shift = KEY_BITS - PREFIX
    sharing: dict[int, list[Key]] = {}
    for key in keys:
        if key[0] >= 0:
            sharing.setdefault(key[0] >> shift, []).append(key)
    lookup = [(p, bisect.bisect_left(keys, (p << shift, -1, -1)), sharing.get(p, [])) for p in range(1 << PREFIX)]
    table = F.broadcast(rows.sparkSession.createDataFrame(lookup, LOOKUP))
    joined = rows.join(table, F.shiftright("k1", shift).cast("int") == F.col("prefix"))
    halved = F.expr(
        "if(size(keys) = 0, 0, aggregate(sequence(1, CAST(ceil(log2(size(keys) + 1)) AS INT)), struct(0 AS lo, size(keys) AS hi), "
        "(a, i) -> if(a.lo >= a.hi, a, if(keys[(a.lo + a.hi) DIV 2] <= struct(k1, k2, k3), "
        "struct(CAST((a.lo + a.hi) DIV 2 + 1 AS INT) AS lo, a.hi AS hi), struct(a.lo AS lo, CAST((a.lo + a.hi) DIV 2 AS INT) AS hi))), a -> a.lo))"
    )
    return joined.withColumn(name, F.col("first") + halved).drop("prefix", "first", "keys")


def _below(rows: DataFrame, keys: Sequence[Key]) -> list[tuple[int, int]]:
    """The exact bytes and rows below each of the ascending keys."""
    counted = _numbered(rows, keys, "at").groupBy("at").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    held = {r["at"]: (r["bytes"], r["n"]) for r in counted.collect()}
    out, size, n = [], 0, 0
    for i in range(len(keys)):
        more = held.get(i, (0, 0))
        size, n = size + more[0], n + more[1]
        out.append((size, n))
    return out


def _candidates(rows: DataFrame, open_: Sequence[Splitter], probes: int, turn: int) -> list[Key]:
    """Keys of rows inside the brackets, about ``probes`` for each splitter, drawn by hash."""
    wanted = Counter((s.lo, s.hi, s.below_hi[1] - s.below_lo[1]) for s in open_)
    # Brackets are the same or apart, so their ends in order are bracket, gap, bracket, ...
    ends: list[Key] = []
    rates = [0.0]
    for (lo, hi, n), count in sorted(wanted.items(), key=lambda x: x[0][0]):
        if ends and ends[-1] == lo:
            rates.pop()
        else:
            ends.append(lo)
        rates.append(min(1.0, probes * count / n))
        if hi is not None:
            ends.append(hi)
            rates.append(0.0)
    table = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(rates)), "at int, rate double").where("rate > 0"))
    drawn = F.pmod(F.xxhash64(*KEY, F.lit(turn)), F.lit(1 << 40)) < F.col("rate") * float(1 << 40)
    picked = _numbered(rows, ends, "at").join(table, "at").where(drawn).select(*KEY)
    return sorted(tuple(r) for r in picked.collect())


def splitters(
    rows: DataFrame, shares: Sequence[float], tolerances: Sequence[float], total: tuple[int, int], probes: int = PROBES
) -> list[tuple[Key | None, int]]:
    """(key, rows below it) of the cuts at the given ascending shares of all bytes, each within its tolerance in bytes or exact to
    the row. ``rows`` (k1, k2, k3, size), ``total`` bytes and rows of them, is read twice a round."""
    cuts = [Splitter(s * total[0], t, total) for s, t in zip(shares, tolerances, strict=True)]
    turn = 0
    while open_ := [s for s in cuts if not s.done]:
        keys = _candidates(rows, open_, probes, turn)
        below = _below(rows, keys)
        for s in open_:
            at = bisect.bisect_right(keys, s.lo)
            stop = len(keys) if s.hi is None else bisect.bisect_left(keys, s.hi)
            # The last candidate up to the target, and the first beyond it.
            last = bisect.bisect_right(below, s.target, at, stop, key=lambda b: b[0])
            for i in range(max(at, last - 1), min(stop, last + 1)):
                s.narrow(keys[i], below[i])
        turn += 1
    out, rows_below = [], 0
    for key, n in (s.chosen() for s in cuts):
        # Within their tolerances two cuts may pass each other only by standing on the same rows.
        if n < rows_below:
            key, n = out[-1]
        out.append((key, n))
        rows_below = n
    return out


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    parts: int | None = None,
    tolerance: float = 0.001,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``docs`` with its shard (0 to ``shards - 1``) and its slot in it (from 0, without gaps).

    The cuts between shards are within ``tolerance``, as a share of a shard's bytes, of equal bytes, or as near as whole documents come; with
    0 they are always that. ``parts`` is the number of tasks that make up a shard; by default all parts together are about the
    session's shuffle partitions. Returns (id, text, size, text_crc32, shard, slot), then the columns to ``carry``.
    """
    spark = docs.sparkSession
    parts = parts or max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows.withColumns(
        {
            "size": F.octet_length("text").cast("bigint") + 1,
            "k1": digest_key(F.col("text")),
            "k2": digest_key(F.col("id"), F.col("text")),
            "k3": F.monotonically_increasing_id(),
        }
    )
    # Stored first: the numbers of equal rows must not change from one reading to the next.
    rows = stored(rows, "ordered")
    keys = rows.select(*KEY, "size")
    total = tuple(keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first())
    n = shards * parts
    # Cuts within a shard only even out the tasks.
    allowed = [total[0] / shards * (tolerance / 2 if i % parts == 0 else 0.1 / parts) for i in range(1, n)]
    cuts = splitters(keys, [i / n for i in range(1, n)], allowed, total)

    first = [0, *(below for _, below in cuts)]
    offsets = [(i, i // parts, first[i] - first[i - i % parts]) for i in range(n)]
    place = F.broadcast(spark.createDataFrame(offsets, "part int, shard int, before bigint"))
    dealt = _numbered(rows, [key for key, _ in cuts if key is not None], "part").join(place, "part")
    order = Window.partitionBy("part").orderBy(*KEY)
    slot = F.col("before") + F.row_number().over(order) - 1
    carried = [F.col(f"carry_{c}").alias(c) for c in carry]
    return dealt.select("id", "text", "size", F.crc32("text").alias("text_crc32"), "shard", slot.alias("slot"), *carried)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard below ``path``, with files in the order of their slots' ranges."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
