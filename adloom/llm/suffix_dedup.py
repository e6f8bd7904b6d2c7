"""Removing repeated substrings with suffix arrays, shard by shard.

Only windows whose anchor occurs twice can repeat (see ``recurring``); their segments are dealt by anchor, so every shard
holds all windows that can be equal to each other. A shard sorts its suffixes (Larsson-Sadakane), derives the common
prefixes of neighbours (Kasai's, in text order) and finds the first occurrence of every window. An anchor too frequent for
one shard is spread over several; their sorted first windows are merged afterwards by binary search.

Defined cases: a null text is empty; texts shorter than the window lose nothing; rows equal in id and text are one
document listed twice and get the same result; a null id sorts before all others; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams, recurring
from adloom.llm.shared import keyed, stored, utf8

GRAM = 16
_SYMBOLS = 7
SHARD = "a long, h long, k1 long, k2 long, p long, cover array<int>, first binary"
KEPT = "id long, kept binary, n_bytes long, spans array<struct<lo:int,hi:int>>"


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _cut(text: bytes):
    return lambda lo, hi: text[lo:hi]


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of several strings laid end to end; ``ends[i]`` is where the string of position ``i`` ends.

    Suffixes are first sorted by their first seven bytes. Each round then sorts only the groups that are still tied, by
    the rank of the suffix as far ahead as is sorted already, which doubles that length. The end of a string ranks below
    every byte, and differently for every string.
    """
    n = data.size
    key = np.zeros(n, np.int64)
    padded = np.concatenate((data.astype(np.int64) + 1, np.zeros(_SYMBOLS, np.int64)))
    at = np.arange(n)
    for j in range(_SYMBOLS):
        key = (key << 9) | np.where(at + j < ends, padded[j : j + n], 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.maximum.accumulate(np.where(head, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    ahead = _SYMBOLS
    slots = at
    while True:
        tied = ~head | np.concatenate((~head[1:], [False]))
        slots = slots[tied]
        if not slots.size:
            return order
        members = order[slots]
        beyond = members + ahead
        inside = beyond < ends[members]
        second = np.where(inside, rank[np.where(inside, beyond, 0)], -ends[members])
        combined = rank[members] * (2 * n + 2) + second + n + 1
        perm = np.argsort(combined, kind="stable")
        members, combined = members[perm], combined[perm]
        order[slots] = members
        head = np.concatenate(([True], combined[1:] != combined[:-1]))
        start = np.maximum.accumulate(np.where(head, np.arange(slots.size), 0))
        rank[members] = slots[start]
        ahead *= 2


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the length it shares with its predecessor in the suffix array.

    A value is one less than that of the position before when both preceding bytes agree too; only the others are
    compared, eight bytes at a time.
    """
    n = data.size
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    first = np.concatenate(([True], ends[1:] != ends[:-1]))
    i = np.arange(n)
    known = before >= 0
    partner = np.where(known, before, 0)
    follows = known & ~first & ~first[partner] & (data[i - 1] == data[partner - 1])
    left = np.flatnonzero(known & ~follows)
    right = before[left]
    words = np.zeros(n + 8, np.uint64)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    for j in range(8):
        words |= padded[j : j + n + 8].astype(np.uint64) << np.uint64(8 * j)
    limit = np.minimum(ends[left] - left, ends[right] - right)
    length = np.zeros(left.size, np.int64)
    active = np.arange(left.size)
    while active.size:
        x = words[left[active] + length[active]] ^ words[right[active] + length[active]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64))
        length[active] += same
        active = active[(same == 8) & (length[active] < limit[active])]
    out = np.zeros(n, np.int64)
    out[left] = np.minimum(length, limit)
    anchor = np.maximum.accumulate(np.where(follows, 0, i))
    return np.where(follows, np.maximum(out[anchor] - (i - anchor), 0), out)


NAMES = [f.split()[0] for f in SHARD.split(", ")]


def _alone(group: recurring.Shard, window: int) -> np.ndarray:
    """Which segments are the only one of their anchor and repeat nothing within themselves.

    Their windows are equal to none of another segment, so at the least occurrence of the segment nothing is a repeat, and
    there is nothing to sort. Windows are compared by hash here: a segment with two equal hashes is not among them.
    """
    _, anchor, n = np.unique(group.a, return_inverse=True, return_counts=True)
    alone = (n[anchor] == 1) & ~group.open
    chosen = np.flatnonzero(alone)
    if chosen.size:
        size = np.array([len(group.bodies[i]) for i in chosen.tolist()])
        data = np.frombuffer(b"".join([group.bodies[i] for i in chosen.tolist()]), np.uint8)
        windows = group.n[chosen].astype(np.int64)
        seg = np.repeat(np.arange(chosen.size), windows)
        offset = np.arange(seg.size) - np.repeat(np.cumsum(windows) - windows, windows)
        key = grams.window_hashes(data, window)[(np.cumsum(size) - size)[seg] + offset] ^ grams.mix(seg.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        twice = order[1:][key[order[1:]] == key[order[:-1]]]
        alone[chosen[seg[twice]]] = False
    return alone


def _resolve(group: recurring.Shard, window: int) -> Iterator[pa.RecordBatch]:
    """What one shard finds: per segment the repeats at its least occurrence, and of open anchors the first windows."""
    alone = _alone(group, window)
    if alone.any():
        settled, group = group.part(np.flatnonzero(alone)), group.part(np.flatnonzero(~alone))
        n = len(settled)
        low = [pa.array(settled.low[:, i]) for i in range(3)]
        empty = pa.array([[]] * n, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(settled.a), pa.array(settled.h), *low, empty, pa.nulls(n, pa.binary())], NAMES)
        if not len(group):
            return
    data = np.frombuffer(b"".join(group.bodies), np.uint8)
    size = np.array([len(b) for b in group.bodies])
    stop = np.cumsum(size)
    begin = stop - size
    order = suffix_array(data, np.repeat(stop, size))
    shared = common_prefixes(data, np.repeat(stop, size), order)[order] >= window
    shared[:1] = False
    seg_of = np.repeat(np.arange(len(group)), size)
    seg = seg_of[order]
    offset = order - begin[seg]
    owned = offset < group.n[seg]
    label = np.cumsum(~shared)[owned]
    seg, offset = seg[owned], offset[owned]
    # Windows that stand alone are done; the others are ordered by place within their class.
    many = np.bincount(label)[label] > 1
    single, label, seg_m, offset_m = np.flatnonzero(~many), label[many], seg[many], offset[many]
    k1, k2, p = group.low[seg_m, 0], group.low[seg_m, 1], group.low[seg_m, 2] + offset_m
    rows = np.lexsort((p, k2, k1, label))
    label, seg_m, offset_m, k1, k2, p = (x[rows] for x in (label, seg_m, offset_m, k1, k2, p))
    again = np.concatenate(([False], label[1:] == label[:-1])) if label.size else np.zeros(0, bool)
    leader = np.maximum.accumulate(np.where(again, 0, np.arange(label.size)))
    again &= (k1 != k1[leader]) | (k2 != k2[leader]) | (p != p[leader])
    by_seg = np.lexsort((offset_m[again], seg_m[again]))
    s, o = seg_m[again][by_seg], offset_m[again][by_seg]
    cover = recurring.covers(s, o, o + window, len(group))
    none = pa.nulls(len(group), pa.binary())
    low = [pa.array(group.low[:, i]) for i in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(group.a), pa.array(group.h), *low, cover, none], NAMES)
    if group.open.any():
        seg = np.concatenate((seg[single], seg_m[~again]))
        offset = np.concatenate((offset[single], offset_m[~again]))
        seg, offset = seg[group.open[seg]], offset[group.open[seg]]
        first = pa.array([group.bodies[i][j : j + window] for i, j in zip(seg.tolist(), offset.tolist(), strict=True)], pa.binary())
        place = [pa.array(group.low[seg, i] + (offset if i == 2 else 0)) for i in range(3)]
        nothing = [pa.nulls(seg.size, pa.int64()), pa.nulls(seg.size, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(group.a[seg]), nothing[0], *place, nothing[1], first], NAMES)


def _merge(opened: DataFrame, window: int) -> DataFrame:
    """Windows that are first in their own shard but not over all shards of their anchor: (k1, k2, lo, hi).

    The shards of an anchor are merged one after the other into one sorted array by binary search. The work of an anchor
    is dealt by the window's hash, so its size does not grow with the anchor's frequency.
    """
    parts = F.pmod(F.xxhash64("first"), F.lit(1 << 16))
    dealt = opened.select("a", parts.alias("part"), "first", "k1", "k2", "p").repartition("a", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.zeros(0, f"S{window + 1}")
        spots: np.ndarray = np.zeros((0, 3), np.int64)
        key = None
        for batch in batches:
            a, part, first, *place = (c.to_pylist() for c in batch.columns)
            cuts = [0, *(i for i in range(1, len(a)) if (a[i], part[i]) != (a[i - 1], part[i - 1])), len(a)]
            lost: list = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if (a[lo], part[lo]) != key:
                    key, base, spots = (a[lo], part[lo]), base[:0], spots[:0]
                new = np.array([w + b"\x01" for w in first[lo:hi]], base.dtype)
                at = np.array([x[lo:hi] for x in place], np.int64).T
                by = np.lexsort((at[:, 2], at[:, 1], at[:, 0], new))
                new, at = new[by], at[by]
                repeat = np.concatenate(([False], new[1:] == new[:-1]))
                lost += at[repeat].tolist()
                new, at = new[~repeat], at[~repeat]
                spot = np.searchsorted(base, new)
                held = spot < base.size
                held[held] = base[spot[held]] == new[held]
                for i, j in zip(np.flatnonzero(held).tolist(), spot[held].tolist(), strict=True):
                    x, y = tuple(spots[j].tolist()), tuple(at[i].tolist())
                    if x != y:
                        lost.append(max(x, y))
                        spots[j] = min(x, y)
                base = np.insert(base, spot[~held], new[~held])
                spots = np.insert(spots, spot[~held], at[~held], axis=0)
            if lost:
                k1, k2, p = np.array(lost, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, p)], ["k1", "k2", "lo"])

    found = dealt.sortWithinPartitions("a", "part").mapInArrow(work, "k1 long, k2 long, lo long")
    return found.select("k1", "k2", "lo", (F.col("lo") + window).alias("hi"))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 100,
    split_at: int = recurring.SPLIT_AT,
) -> DataFrame:
    """Each document without the bytes covered by a ``window``-byte string that also starts earlier.

    Returns (id, kept, n_bytes, spans): the remaining bytes, the original length, and the maximal removed byte ranges.
    """
    rows = keyed(docs, id_col, text_col)
    suspect = recurring.suspects(rows, _bytes, window, GRAM)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in recurring.shards(batches):
            yield from _resolve(group, window)

    found = stored(recurring.by_shard(suspect, _bytes, _cut, window, split_at).mapInArrow(settle, SHARD), "shards")
    firsts = found.where("h IS NOT NULL").select("a", "h", F.struct("k1", "k2", "p").alias("low"), "cover")
    runs = recurring.occurrences(suspect, _bytes, _cut, window, False)
    run = F.struct("k1", "k2", F.shiftright("span", 10).alias("p"))
    whole = F.array(F.lit(0), (F.col("span") % 1024 + (window - 1)).cast("int"))
    placed = runs.join(firsts, ["a", "h"]).select(
        "k1", "k2", run["p"].alias("p"), F.when(run == F.col("low"), F.col("cover")).otherwise(whole).alias("cover")
    )
    pairs = F.expr("transform(sequence(0, size(cover) DIV 2 - 1), i -> struct(p + cover[2 * i] AS lo, p + cover[2 * i + 1] AS hi))")
    spans = placed.where(F.size("cover") > 0).select("k1", "k2", F.inline(pairs))
    spans = spans.union(_merge(found.where("h IS NULL"), window))
    removed = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return rows.join(removed, ["k1", "k2"], "left").select("id", utf8(), "spans").mapInArrow(_apply, KEPT)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted intervals with overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["hi"]))
        else:
            out.append((s["lo"], s["hi"]))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        texts, found = batch.column(1).to_pylist(), batch.column(2)
        kept, spans = [], []
        for text, s in zip(texts, found, strict=True):
            cut = merged(s.as_py())
            at, parts = 0, []
            for lo, hi in cut:
                parts.append(text[at:lo])
                at = hi
            kept.append(b"".join([*parts, text[at:]]))
            spans.append([{"lo": lo, "hi": hi} for lo, hi in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array(spans, span)],
            ["id", "kept", "n_bytes", "spans"],
        )
