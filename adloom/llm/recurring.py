"""Finding the parts of documents in which a window of fixed length may recur, without listing every window.

1. Each run of windows with the same anchor (see ``grams.runs``) is one row: about one row per 14 windows of 35 words,
   one per 43 windows of 100 bytes. Equal windows have equal anchors, so only anchors seen twice can hold repeats.
2. The runs of such anchors go back to their documents, and every document with one is stored with its runs.
3. ``segments`` cuts the text of each run out (its windows and nothing else) and deals it by anchor: all windows that can
   be equal meet in one group. A frequent anchor is split by the hash of the segment, and what its parts
   leave open is settled afterwards by the operator.

Occurrences are (k1, k2, position), ordered like (doc_id, position).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams
from adloom.llm.shared import stored, utf8

# Runs of one anchor that stay together, about the size of a shard; a more frequent anchor is split by segment.
SPLIT_AT = 4000
ANCHORS = "k1 long, k2 long, a long, span long"
SEGMENTS = (
    "a long, salt int, open boolean, h long, n int, body binary, d1 long, e1 long, p1 long, d2 long, e2 long, p2 long"
)

Symbols = Callable[[bytes], np.ndarray]


def anchor_rows(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """One row per run: key, anchor, and span = first window * 1024 + number of windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found, size = [], 0
            for i, text in enumerate(batch.column(2)):
                for a, first, n in grams.runs(symbols(text.as_py()), window, gram):
                    found.append((np.full(a.size, i), a, first * 1024 + n))
                    size += a.size
                if size > 1 << 18:
                    yield _anchor_batch(found, k1, k2)
                    found, size = [], 0
            if found:
                yield _anchor_batch(found, k1, k2)

    return docs.select("k1", "k2", utf8()).mapInArrow(work, ANCHORS)


def _anchor_batch(found: list, k1: np.ndarray, k2: np.ndarray) -> pa.RecordBatch:
    at, a, span = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[at], k2[at], a, span)], ["k1", "k2", "a", "span"])


def suspects(docs: DataFrame, symbols: Symbols, window: int, gram: int) -> DataFrame:
    """The rows of ``docs`` (k1, k2, text) that have anchors seen more than once, with those ``runs``. Stored."""
    anchors = stored(anchor_rows(docs, symbols, window, gram), "anchors")
    counts = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counts = stored(counts, "anchor-counts")
    hits = anchors.join(counts, "a").groupBy("k1", "k2").agg(F.collect_set(F.struct("span", "a", "c")).alias("runs"))
    return stored(docs.select("k1", "k2", "text").join(hits, ["k1", "k2"]), "suspects")


def occurrences(
    suspect: DataFrame, symbols: Symbols, cut: Callable, window: int, with_body: bool, split_at: int = SPLIT_AT
) -> DataFrame:
    """The runs of ``suspect`` as rows.

    With bodies: segments, equal ones of a batch combined into one row with the least and the greatest occurrence.
    Without: every run with the hash ``h`` of its segment, to join what the groups found back to the documents.
    """
    schema = SEGMENTS if with_body else "k1 long, k2 long, a long, h long, span long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts, runs = batch.column(2).to_pylist(), batch.column(3)
            ends = runs.offsets.to_numpy() - runs.offsets[0].as_py()
            values = runs.flatten()
            span, a, c = (values.field(x).to_numpy(zero_copy_only=False) for x in ("span", "a", "c"))
            first, n = span >> 10, span & 1023
            h = [
                grams.span_hashes(symbols(text), first[lo:hi], first[lo:hi] + n[lo:hi] + window - 1, 7)
                for text, lo, hi in zip(texts, ends, ends[1:], strict=False)
            ]
            h = np.concatenate(h).view(np.int64) if h else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(texts)), np.diff(ends))
            if not with_body:
                arrays = [pa.array(x) for x in (k1[doc], k2[doc], a, h, span)]
                yield pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "a", "h", "span"])
                continue
            order = np.lexsort((first, k2[doc], k1[doc], h, a))
            change = (a[order[1:]] != a[order[:-1]]) | (h[order[1:]] != h[order[:-1]])
            heads = order[np.concatenate(([True], change))] if order.size else order
            tails = order[np.concatenate((change, [True]))] if order.size else order
            by_doc = np.argsort(heads, kind="stable")
            heads, tails = heads[by_doc], tails[by_doc]
            for at in range(0, heads.size, 1 << 14):
                x, y = heads[at : at + (1 << 14)], tails[at : at + (1 << 14)]
                yield _segments(texts, cut, window, split_at, (k1, k2, doc, first, n, a, c, h), x, y)

    return suspect.select("k1", "k2", utf8(), "runs").mapInArrow(work, schema)


def _segments(texts: list, cut: Callable, window: int, split_at: int, columns: tuple, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    k1, k2, doc, first, n, a, c, h = columns
    bodies, held, pieces = [], -1, None
    for d, lo, hi in zip(doc[x].tolist(), first[x].tolist(), (first[x] + n[x] + window - 1).tolist(), strict=True):
        if d != held:
            held, pieces = d, cut(texts[d])
        bodies.append(pieces(lo, hi))
    parts = -(-c[x] // split_at)
    arrays = [a[x], ((h[x] & 0x7FFFFFFF) % parts).astype(np.int32), parts > 1, h[x], n[x].astype(np.int32), pa.array(bodies, pa.binary())]
    arrays += [k1[doc[x]], k2[doc[x]], first[x], k1[doc[y]], k2[doc[y]], first[y]]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], [f.split()[0] for f in SEGMENTS.split(", ")])


class Shard:
    """Distinct segments of whole (anchor, salt) groups, column by column; ``low`` and ``high`` are (k1, k2, position)."""

    def __init__(self, table: pa.Table):
        column = {name: table.column(name).combine_chunks() for name in table.column_names}
        number = {name: c.to_numpy(zero_copy_only=False) for name, c in column.items() if name != "body"}
        low, high = (np.stack([number[f"{x}{i}"] for x in "dep"], 1) for i in (1, 2))
        by_low = np.lexsort((*low.T[::-1], number["h"], number["a"]))
        by_high = np.lexsort((*high.T[::-1], number["h"], number["a"]))
        a, h = number["a"][by_low], number["h"][by_low]
        change = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        rows = by_low[np.concatenate(([True], change))]
        self.a, self.h, self.n, self.open = (number[x][rows] for x in ("a", "h", "n", "open"))
        self.low, self.high = low[rows], high[by_high[np.concatenate((change, [True]))]]
        self.bodies = column["body"].take(pa.array(rows)).to_pylist()

    def __len__(self) -> int:
        return len(self.bodies)

    def part(self, rows: np.ndarray) -> Shard:
        """The segments of the given numbers."""
        out = object.__new__(Shard)
        out.a, out.h, out.n, out.open, out.low, out.high = (x[rows] for x in (self.a, self.h, self.n, self.open, self.low, self.high))
        out.bodies = [self.bodies[i] for i in rows.tolist()]
        return out


def shards(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[Shard]:
    """Whole (anchor, salt) groups of a sorted stream, gathered up to about ``limit`` bytes; equal segments combined."""
    waiting: list[pa.RecordBatch] = []
    size, key = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.concatenate(([(a[0], salt[0]) != key], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])))
        total = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column(5)).to_numpy(zero_copy_only=False))))
        starts, at = np.flatnonzero(new), 0
        while True:
            # The first group boundary at which enough has been gathered.
            ready = starts[(starts >= at) & (size + total[starts] - total[at] >= limit)]
            if not ready.size:
                break
            waiting.append(batch.slice(at, ready[0] - at))
            yield Shard(pa.Table.from_batches(waiting))
            waiting, size, at = [], 0, int(ready[0])
        waiting.append(batch.slice(at))
        size += int(total[-1] - total[at])
        key = (a[-1], salt[-1])
    if waiting:
        yield Shard(pa.Table.from_batches(waiting))


def covers(seg: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> pa.Array:
    """Per segment the joined intervals, flattened; ``seg`` and ``start`` ascending."""
    if not seg.size:
        return pa.array([[]] * n, pa.list_(pa.int32()))
    big = np.int64(1) << 40
    reach = np.maximum.accumulate(seg * big + stop) - seg * big
    new = np.concatenate(([True], (seg[1:] != seg[:-1]) | (start[1:] > reach[:-1])))
    last = np.append(new[1:], True)
    flat = np.stack((start[new], reach[last]), 1).ravel().astype(np.int32)
    offsets = 2 * np.searchsorted(seg[new], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def by_shard(suspect: DataFrame, symbols: Symbols, cut: Callable, window: int, split_at: int) -> DataFrame:
    """Segments dealt by anchor (and salt, for a frequent one), sorted so that a task streams group after group."""
    rows = occurrences(suspect, symbols, cut, window, True, split_at)
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt")
