"""Periodic runs of words, found by internal pattern matching, and texts with each run cut to its first period.

A run is a stretch with smallest period ``q``, at least ``exponent`` periods and ``shortest`` words long, that no neighbouring word
extends. Such a stretch holds a block of B words at a multiple of B, with B the largest power of two up to ``q``
(no less than ``shortest // 3``), whose copy ``q`` words later is inside the run too. So it suffices to ask, for every dyadic block,
where it occurs again within the next 2 B words:

1. The suffixes of a batch of documents are sorted by their first B words, doubling B; a block's occurrences are then a range
   of the suffix array. Documents never share a range.
2. A wavelet matrix over that array gives range successors: the next occurrence after a place.
3. Occurrences at most B / 2 apart are one progression, whose difference is the block's period. Candidate periods are this difference,
   the distances between occurrences outside progressions, and the distances between the ends of progressions: at most a
   handful for each block.
4. Every candidate is extended both ways by comparing hashes, which gives the whole run; of several periods with the
   same stretch the smallest is the run's.

Work is a map over rows, without shuffle. A batch of documents is worked out at once, up to ``BATCH`` words; memory follows the
longest document, about 200 bytes for each of its words.

Defined cases: null, empty and blank texts have no words and no runs; a text of any length is taken whole; rows are independent
of each other, so repeated rows and ids give the same result each time; an empty table gives no rows; other columns are not
looked at unless carried. Words are compared by 64-bit hashes. Ties for the greatest exponent go to the smallest
start, then the smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams
from adloom.llm.shared import utf8

# Words worked out at once, unless one document is longer.
BATCH = 1 << 18
RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"kept string, n_words bigint, runs array<{RUN}>, best {RUN}"


class WaveletMatrix:
    """Range queries over an array of numbers below ``2 ** bits``; all take arrays of queries."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for bit in reversed(range(bits)):
            zero = (values >> bit) & 1 == 0
            before = np.zeros(values.size + 1, np.int64)
            np.cumsum(zero, out=before[1:])
            self.levels.append((1 << bit, before))
            values = np.concatenate((values[zero], values[~zero]))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of ``values[lo:hi]`` are less than ``bound``."""
        count = np.zeros(lo.size, np.int64)
        for bit, before in self.levels:
            x, y, one = before[lo], before[hi], bound & bit != 0
            count += np.where(one, y - x, 0)
            lo, hi = (np.where(one, before[-1] + a - z, z) for a, z in ((lo, x), (hi, y)))
        return count

    def smallest(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank, from 0, in ``values[lo:hi]``."""
        value = np.zeros(lo.size, np.int64)
        for bit, before in self.levels:
            x, y = before[lo], before[hi]
            one = rank >= y - x
            value += np.where(one, bit, 0)
            rank = np.where(one, rank - (y - x), rank)
            lo, hi = (np.where(one, before[-1] + a - z, z) for a, z in ((lo, x), (hi, y)))
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, none: int) -> np.ndarray:
        """The smallest of ``values[lo:hi]`` that is ``least`` or more, or ``none``."""
        rank = self.below(lo, hi, least)
        found = np.full(lo.size, none, np.int64)
        some = np.flatnonzero(rank < hi - lo)
        found[some] = self.smallest(lo[some], hi[some], rank[some])
        return found


class Blocks:
    """The suffix array of several sequences, sorted by the first words, doubling their number from ``least`` on.

    ``array`` keeps the suffixes whose first ``least`` words stand twice in their sequence. ``ranges`` gives, for each block length, the
    blocks at multiples of that length that stand twice, with their range of the array.
    """

    def __init__(self, words: np.ndarray, owner: np.ndarray, ends: np.ndarray, least: int):
        self.ranges: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        n = words.size
        whole = np.flatnonzero(np.arange(n) + least <= ends[owner])
        key = grams.window_hashes(words, least)[whole] ^ grams.mix(owner[whole].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        suffixes, key = whole[order], key[order]
        first = np.concatenate(([True], key[1:] != key[:-1])) if key.size else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        again = size[group] > 1
        self.array, first = suffixes[again], first[again]
        longest = int(np.diff(ends, prepend=0).max(initial=0)) // 3
        # rank[i]: where the range of the suffix at i begins; -1 if it is alone.
        rank = np.full(n + 1, -1, np.int64)
        block = least
        while self.array.size:
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, first.size))
            rank[self.array] = np.where(np.repeat(size, size) > 1, np.repeat(begin, size), -1)
            at = np.flatnonzero(self.array % block == 0)
            lo = rank[self.array[at]]
            at, lo = at[lo >= 0], lo[lo >= 0]
            stop = np.zeros(first.size, np.int64)
            stop[begin] = begin + size
            self.ranges.append((block, self.array[at], lo, stop[lo]))
            if 2 * block > longest or not (size > 1).any():
                break
            # Suffixes that share their first words are sorted by what follows; the others stay where they are.
            slots = np.flatnonzero(np.repeat(size, size) > 1)
            follow = self.array[slots] + block
            inside = follow + block <= ends[owner[self.array[slots]]]
            second = np.where(inside, rank[np.minimum(follow, n)], -1)
            # A block that stands once, or is cut by the end, equals no other.
            second = np.where(second < 0, n + 1 + np.arange(slots.size), second)
            head = rank[self.array[slots]]
            order = np.lexsort((second, head))
            self.array[slots] = self.array[slots][order]
            head, second = head[order], second[order]
            first[slots] = np.concatenate(([True], (head[1:] != head[:-1]) | (second[1:] != second[:-1])))
            block *= 2


def _common(sums: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words after (or before, ``back``) the places ``a`` and ``b`` are equal, ``limit`` at most; by halving on hashes."""
    lo, hi = np.zeros(a.size, np.int64), limit.astype(np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        x, y, mid = a[open_], b[open_], (lo[open_] + hi[open_] + 1) // 2
        ends = (x, y) if back else (x + mid, y + mid)
        starts = (x - mid, y - mid) if back else (x, y)
        same = np.equal(*(grams.span_hashes(words, s, e, sums=sums) for s, e in zip(starts, ends, strict=True)))
        lo[open_] = np.where(same, mid, lo[open_])
        hi[open_] = np.where(same, hi[open_], mid - 1)
    return lo


def find_runs(words: np.ndarray, sizes: Sequence[int], shortest: int = 24, exponent: int = 3) -> np.ndarray:
    """(sequence, start, length, period) of every run of the sequences, whose hashed words stand one after the other in ``words``."""
    if shortest < 3 or exponent < 3:
        raise ValueError("runs have at least three words and three periods")
    ends = np.cumsum(np.asarray(sizes, np.int64))
    begins = ends - np.asarray(sizes, np.int64)
    owner = np.repeat(np.arange(ends.size), sizes)
    blocks = Blocks(words, owner, ends, 1 << ((shortest // 3).bit_length() - 1))
    if not blocks.array.size:
        return np.zeros((0, 4), np.int64)
    n = words.size
    tree = WaveletMatrix(blocks.array, n.bit_length())
    sums = grams.prefix(words)

    def progression_end(y: np.ndarray, step: np.ndarray) -> np.ndarray:
        return y + step + _common(sums, words, y, y + step, ends[owner[y]] - y - step)

    candidates = []
    for block, x, lo, hi in blocks.ranges:
        # Per block: the last occurrence seen, the block's period once known (else 0), the ends of both progressions.
        y, step, own = x.copy(), np.zeros(x.size, np.int64), np.zeros(x.size, np.int64)
        reach = x.copy()
        while x.size:
            z = tree.successor(lo, hi, np.where(step > 0, reach - block, y) + 1, 4 * n)
            inside = z < x + 2 * block
            x, lo, hi, y, z, step, own, reach = (v[inside] for v in (x, lo, hi, y, z, step, own, reach))
            candidates.append(np.stack((x, z - x)))
            new = (step == 0) & (z - y <= block // 2)
            step = np.where(new, z - y, step)
            known = np.flatnonzero(new)
            own[known] = progression_end(x[known], step[known])
            known = np.flatnonzero(step > 0)
            reach[known] = progression_end(z[known], step[known])
            apart = known[reach[known] > own[known]]
            candidates.append(np.stack((x[apart], reach[apart] - own[apart])))
            periodic = np.flatnonzero(new)
            candidates.append(np.stack((x[periodic], step[periodic])))
            y = z
    if not candidates:  # what stands twice begins at no multiple of a block's length: too short for a run
        return np.zeros((0, 4), np.int64)
    x, period = np.unique(np.concatenate(candidates, 1), axis=1)
    doc = owner[x]
    fits = x + period < ends[doc]
    x, period, doc = x[fits], period[fits], doc[fits]
    start = x - _common(sums, words, x, x + period, x - begins[doc], back=True)
    stop = x + period + _common(sums, words, x, x + period, ends[doc] - x - period)
    long = stop - start >= np.maximum(shortest, exponent * period)
    found = np.stack((doc, start - begins[doc], stop - start, period), 1)[long]
    # The same stretch with a multiple of its period: the least period is the run's.
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[fresh]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BATCH words together, judged by their bytes."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > 6 * BATCH:
            yield at, i
            at, size = i, 0
        size += len(text) + 1
    if at < len(texts):
        yield at, len(texts)


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    words = text.split()
    if runs:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, cut in zip(words, (np.cumsum(gone)[:-1] > 0).tolist(), strict=True) if not cut]
    return b" ".join(words)


def _struct(runs: list[tuple[int, int, int]]) -> list[dict]:
    return [{"start": s, "length": n, "period": q} for s, n, q in runs]


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, exponent: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """Each document with its ``runs`` (by start, then period), the ``best`` of them (greatest exact exponent; null without runs) and
    ``kept``: its words joined by one space, without those that a run covers after the run's first period.

    Returns (id, kept, n_words, runs, best), then the columns to ``carry``.
    """
    run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _batches(texts):
                part = texts[lo:hi]
                data = np.frombuffer(b"\n".join([*part, b""]), np.uint8)
                starts, stops = grams.word_bounds(data)
                offsets = np.cumsum([0, *(len(t) + 1 for t in part)])
                sizes = np.diff(np.searchsorted(starts, offsets))
                found = find_runs(grams.span_hashes(data, starts, stops), sizes, shortest, exponent)
                cuts = np.searchsorted(found[:, 0], np.arange(len(part) + 1))
                runs = [[tuple(r) for r in found[a:b, 1:].tolist()] for a, b in zip(cuts, cuts[1:], strict=False)]
                kept = [_collapsed(t, r) for t, r in zip(part, runs, strict=True)]
                best = [_struct([min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))])[0] if r else None for r in runs]
                columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())]
                columns += [pa.array([_struct(r) for r in runs], pa.list_(run)), pa.array(best, run)]
                slice_ = batch.slice(lo, hi - lo)
                names = ["id", "kept", "n_words", "runs", "best", *(n.removeprefix("carry_") for n in batch.schema.names[2:])]
                yield pa.RecordBatch.from_arrays([slice_.column(0), *columns, *slice_.columns[2:]], names)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text, *[F.col(c).alias(f"carry_{c}") for c in carry])
    kinds = [f"id {rows.schema['id'].dataType.simpleString()}", FOUND]
    kinds += [f"`{c}` {rows.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry]
    return rows.select("id", utf8(), *[f"carry_{c}" for c in carry]).mapInArrow(work, ", ".join(kinds))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts with a periodic tail in each document whose crc32 of the id is divisible by ten, to have runs to look for.

    With h the crc32, g = h div 10 and n words, the words from a = g % n on repeat with period 1 + (n - a) div (3 + g % 8).
    """
    h = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    marked = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_g", F.floor(h / 10))
    marked = marked.withColumn("_n", F.coalesce(F.size("_words"), F.lit(-1)).cast("bigint"))
    marked = marked.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    placed = marked.withColumn("_p", F.expr("CAST(if(_n > 0, 1 + (_n - _a) DIV (3 + _g % 8), NULL) AS INT)"))
    repeated = "flatten(array_repeat(slice(_words, _a + 1, _p), CAST(ceil((_n - _a) / _p) AS INT)))"
    edited = F.expr(f"array_join(slice(concat(slice(_words, 1, _a), {repeated}), 1, CAST(_n AS INT)), ' ')")
    return placed.withColumn(text_col, F.when(F.col("_n") > 0, edited).otherwise(F.col(text_col))).select(*docs.columns)


def listed(runs: str = "runs") -> Column:
    """The runs as text, one line each: ``start,length,period``."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
