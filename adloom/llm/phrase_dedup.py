"""Removing passages that stand in several places, located with Aho-Corasick automata.

Windows of 35 words that may recur are gathered by anchor (see ``recurring``). A shard counts where each of its windows
starts, joins consecutive recurring windows to passages, confirms them, compiles the distinct passages into an automaton
and streams its segments through it, which gives every place a passage covers. Automata hold one shard's passages, so their
size is bounded whatever the corpus. An anchor too frequent for one shard is spread over several; each tells the distinct
windows it saw, and what one has found once only recurs if any other has found it too.

Defined cases: a null text has no words; fewer words than the window lose nothing; rows equal in id and text are one
document listed twice; a null id is an id of its own; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams, recurring
from adloom.llm.shared import keyed, stored, utf8
from adloom.llm.suffix_dedup import merged

GRAM = 8
SHARD = "a long, h long, k1 long, k2 long, p long, cover array<int>, w long, at long"
KEPT = "id long, kept string, n_words long, spans array<struct<lo:int,hi:int>>"


def _cut(text: bytes):
    words = text.split()
    return lambda lo, hi: b" ".join(words[lo:hi])


NAMES = [f.split()[0] for f in SHARD.split(", ")]


def _locate(texts: list[bytes], patterns: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, word after the last) of every place of a pattern; all are looked up in one automaton.

    Bytes are read as Latin-1, so that offsets in the automaton are those of the bytes.
    """
    automaton = ahocorasick.Automaton()
    for pattern, length in patterns.items():
        automaton.add_word(f" {pattern.decode('latin-1')} ", length)
    found: list[tuple[int, int, int]] = []
    if patterns:
        automaton.make_automaton()
        for i, text in enumerate(texts):
            found += [(i, end, length) for end, length in automaton.iter(f" {text.decode('latin-1')} ")]
    at, end, length = np.array(found, np.int64).reshape(-1, 3).T
    spaces = [np.flatnonzero(np.frombuffer(text, np.uint8) == 32) for text in texts]
    last = np.zeros(at.size, np.int64)
    cuts = np.searchsorted(at, np.arange(len(texts) + 1))
    for i in np.unique(at).tolist():
        lo, hi = cuts[i], cuts[i + 1]
        last[lo:hi] = np.searchsorted(spaces[i], end[lo:hi] - 1) + 1
    return at, last - length, last


def _resolve(group: recurring.Shard, window: int) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(b" ".join(group.bodies), np.uint8)
    starts, ends = grams.word_bounds(data)
    words = group.n + (window - 1)
    begin = np.cumsum(words) - words
    seg = np.repeat(np.arange(len(group)), group.n)
    offset = np.arange(seg.size) - np.repeat(np.cumsum(group.n) - group.n, group.n)
    where = begin[seg] + offset
    hashes = grams.window_hashes(grams.span_hashes(data, starts, ends), window, 11)[where]
    _, label = np.unique(hashes, return_inverse=True)
    low, high = group.low[seg], group.high[seg]
    low[:, 2] += offset
    high[:, 2] += offset
    # A window recurs if its places are not all the same one.
    order = np.argsort(label, kind="stable")
    first = order[np.searchsorted(label[order], np.arange(label.max() + 1))][label]
    again = np.zeros(label.max() + 1, bool)
    again[label[(low != low[first]).any(1) | (high != low[first]).any(1)]] = True
    hit = again[label]
    # Consecutive recurring windows of a segment make one passage; equal passages are one pattern.
    prior = np.concatenate(([False], hit[:-1] & (seg[1:] == seg[:-1])))
    follow = np.concatenate((hit[1:] & (seg[1:] == seg[:-1]), [False]))
    opens, closes = np.flatnonzero(hit & ~prior), np.flatnonzero(hit & ~follow)
    patterns = {}
    text = data.tobytes()
    for lo, hi in zip(where[opens].tolist(), (where[closes] + window).tolist(), strict=True):
        patterns[text[starts[lo] : ends[hi - 1]]] = hi - lo
    at, lo, hi = _locate(group.bodies, patterns)
    by = np.lexsort((lo, at))
    cover = recurring.covers(at[by], lo[by], hi[by], len(group))
    n, nulls = len(group), lambda size: pa.nulls(size, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(group.a), pa.array(group.h), *[nulls(n)] * 3, cover, *[nulls(n)] * 2], NAMES)
    # Of an open anchor every distinct window is told: one seen once with where it stands in its segment, others without.
    told = group.open[seg]
    told = np.concatenate((np.flatnonzero(~hit & told), np.unique(first[hit & told])))
    if told.size:
        s = seg[told]
        place = [pa.array(low[told, i]) for i in range(3)]
        w = [pa.array(hashes[told].view(np.int64)), pa.array(offset[told], mask=hit[told])]
        yield pa.RecordBatch.from_arrays([pa.array(group.a[s]), pa.array(group.h[s]), *place, pa.nulls(s.size, pa.list_(pa.int32())), *w], NAMES)


def remove_recurring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    split_at: int = recurring.SPLIT_AT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Each document without the words covered by a ``window``-word passage that also stands elsewhere.

    Returns (id, kept, n_words, spans): the remaining words joined by one space, the original number of words, and the
    maximal removed word ranges; then the columns to ``carry``.
    """
    rows = keyed(docs, id_col, text_col, carry)
    suspect = recurring.suspects(rows, grams.word_hashes, window, GRAM)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in recurring.shards(batches):
            yield from _resolve(group, window)

    found = stored(recurring.by_shard(suspect, grams.word_hashes, _cut, window, split_at).mapInArrow(settle, SHARD), "shards")
    # Windows of a split anchor that one part saw once: they recur if another part saw them elsewhere, once or more often.
    told = found.where("w IS NOT NULL")
    place = F.struct("k1", "k2", "p")
    seen = told.groupBy("a", "w").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max(F.isnull("at")).alias("again"))
    hits = told.where("at IS NOT NULL").join(seen.where("again OR x <> y").select("a", "w"), ["a", "w"])
    split = hits.select("a", "h", F.array(F.col("at").cast("int"), (F.col("at") + window).cast("int")).alias("cover"))
    covers = found.where("w IS NULL").select("a", "h", "cover").union(split).where(F.size("cover") > 0)
    runs = recurring.occurrences(suspect, grams.word_hashes, _cut, window, False)
    placed = runs.join(covers, ["a", "h"]).select("k1", "k2", F.shiftright("span", 10).alias("p"), "cover")
    pairs = F.expr("transform(sequence(0, size(cover) DIV 2 - 1), i -> struct(p + cover[2 * i] AS lo, p + cover[2 * i + 1] AS hi))")
    spans = placed.select("k1", "k2", F.inline(pairs))
    removed = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    carried = [f"carry_{c}" for c in carry]
    schema = ", ".join([KEPT, *(f"`{c}` {rows.schema[f'carry_{c}'].dataType.simpleString()}" for c in carry)])
    joined = rows.join(removed, ["k1", "k2"], "left")
    return joined.select("id", utf8(), "spans", *carried).mapInArrow(_apply, schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        kept, total, spans = [], [], []
        for text, s in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = text.split()
            total.append(len(words))
            cut = merged(s.as_py())
            for lo, hi in reversed(cut):
                del words[lo:hi]
            kept.append(b" ".join(words).decode())
            spans.append([{"lo": lo, "hi": hi} for lo, hi in cut])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(spans, span), *batch.columns[3:]],
            ["id", "kept", "n_words", "spans", *(n.removeprefix("carry_") for n in batch.schema.names[3:])],
        )
