"""Language-model scores from a log-frequency Bloom filter.

Word counts are exact. Word pairs are counted over the whole training part, their counts are quantised to powers of two, and
a pair with count c is stored as the items (pair, 1) .. (pair, 1 + floor(log2 c)) of a blocked Bloom filter. A
lookup probes level after level until one is missing, which gives the quantised count. The filter is broadcast; it never
exceeds ``max_bits``: pairs that stand once are left out of it at any size, and where the others need more, the rarest of them
too. What is left out stays in a table and is joined with the same quantised counts. The levels that every pair left in the
filter has are not stored, save the last one or two of them, so more pairs fit.

A pair's probability is ``w * pair / history + (1 - w) * word`` with the add-one word probability of the base score, so it
never vanishes. The weight w is fitted on one fold of the training part with the counts of its other folds; scores then use
the counts of all of it.

The most frequent words (at most ``max_words``) are broadcast with their counts. Every other word, also as a history, is
joined by its hash, so words and pairs gathered grow with the corpus while what is broadcast does not. A row that was counted
itself needs no join where only items that stand once are left out: what it holds and the broadcast does not, stands once.
The table of pairs is then joined only as far as held-out rows have them, which is marked as pairs are counted. A token of which
only the pair is open is scored without it, and the join gives back pairs that are found only. So what is joined grows as the
input does, until the filter has no room for all pairs that stand twice; from there on counted rows ask for their rare pairs
too, each row once for each, which is never more than its tokens.

Defined cases: a null or blank text is the end token alone; rows equal in id and text are scored and counted each; a null
id belongs to the training part; without training tokens every probability of the base is one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams
from adloom.llm.shared import stored, utf8

FOLDS, HELD_OUT, TUNING = 7, 2, 3
WEIGHTS = [0.0, 0.05, 0.15, 0.3, 0.45, 0.6]
END = 0x5EED
SLICES, BLOCK_BITS, PROBES = 4096, 512, 6
_FLUSH = 1 << 21
GROUP_BITS = 20
_LEVEL = 0x9FB21C651E98DF25


def _fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def _tokens(text: bytes) -> np.ndarray:
    return np.append(grams.word_hashes(text.lower()), np.uint64(END))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with its predecessor; the first follows the end token."""
    before = np.concatenate((np.array([END], np.uint64), tokens[:-1]))
    return grams.mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def _together(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of consecutive texts end to end, and how many each text has; texts are taken together up to ``SLICE`` bytes."""
    at = 0
    while at < len(texts):
        end, length = at + 1, len(texts[at]) + 1
        while end < len(texts) and length + len(texts[end]) < grams.SLICE:
            length += len(texts[end]) + 1
            end += 1
        if end == at + 1:
            tokens = _tokens(texts[at])
            yield tokens, np.array([tokens.size])
        else:
            data = np.frombuffer(b"\n".join(texts[at:end]).lower(), np.uint8)
            starts, ends = grams.word_bounds(data)
            until = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[at:end]]))
            yield np.insert(grams.span_hashes(data, starts, ends), until, np.uint64(END)), np.diff(until, prepend=0) + 1
        at = end


def _counted(rows: DataFrame, make) -> DataFrame:
    """(item, n, m, asked): how often ``make(tokens)`` gives each item in the training part, and in it without the fold the weight
    is fitted on; and whether a held-out row has the item.

    Combined in every task before anything is shuffled.
    """

    def flush(parts: list, folds: list) -> pa.RecordBatch:
        every, fold = np.concatenate(parts), np.concatenate(folds)
        item, n = np.unique(every, return_counts=True)
        held, k = np.unique(every[fold == HELD_OUT], return_counts=True)
        held = np.searchsorted(item, held)
        n[held] -= k
        asked = np.zeros(item.size, bool)
        asked[held] = True
        without, k = np.unique(every[fold == TUNING], return_counts=True)
        m = n.copy()
        m[np.searchsorted(item, without)] -= k
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (item.view(np.int64), n, m, asked)], ["item", "n", "m", "asked"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, folds, size = [], [], 0
        for batch in batches:
            fold, at = batch.column(0).to_numpy().astype(np.int8), 0
            for tokens, sizes in _together(batch.column(1).to_pylist()):
                parts.append(make(tokens))
                folds.append(np.repeat(fold[at : at + sizes.size], sizes))
                at, size = at + sizes.size, size + tokens.size
                if size >= _FLUSH:
                    yield flush(parts, folds)
                    parts, folds, size = [], [], 0
        if parts:
            yield flush(parts, folds)

    return rows.select("fold", utf8()).mapInArrow(work, "item long, n long, m long, asked boolean")


def word_counts(train: DataFrame) -> DataFrame:
    return _counted(train, lambda tokens: tokens).groupBy("item").agg(F.sum("n").alias("c"), F.sum("m").alias("m"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(item, c, m, asked) of all pairs of the training part; dealt by the slice of the filter they go to."""
    dealt = _counted(rows, _pairs).withColumn("slice", _slice()).repartition("slice")
    counts = dealt.groupBy("slice", "item").agg(F.sum("n").alias("c"), F.sum("m").alias("m"), F.bool_or("asked").alias("asked"))
    return counts.where("c > 0").drop("slice")


def _slice() -> Column:
    return F.shiftrightunsigned("item", 52)


def _positions(item: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First bit of the block inside the item's slice, and the bits set in that block."""
    h = grams.mix(item ^ np.uint64(level * _LEVEL & 0xFFFFFFFFFFFFFFFF))
    block = (h % np.uint64(bits // SLICES // BLOCK_BITS)) * np.uint64(BLOCK_BITS)
    h = grams.mix(h)
    inner = np.stack([(h >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PROBES)])
    return block, inner


def _levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(c)).astype(np.int64)


def _skipped(least: int) -> int:
    """Levels left out of a filter of pairs with at least this count, as all have them: one is stored below four, else two."""
    level = least.bit_length()
    return max(min(level - 1, 1), level - 2)


def build_filter(pairs: DataFrame, bits: int, skipped: int = 0) -> np.ndarray:
    """The filter as bytes, of the levels above ``skipped``.

    Each slice is built in one task from its own items; the driver lays ``SLICES`` pieces together.
    """
    size = bits // SLICES // 8

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece = None, None
        for batch in batches:
            where, items, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            items, levels = items.view(np.uint64), _levels(c)
            cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), where.size]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if where[lo] != at:
                    if piece is not None:
                        yield _piece(at, piece)
                    at, piece = where[lo], np.zeros(size * 8, bool)
                for level in range(skipped + 1, int(levels[lo:hi].max()) + 1):
                    block, inner = _positions(items[lo:hi][levels[lo:hi] >= level], level, bits)
                    piece[(block + inner).ravel()] = True
        if piece is not None:
            yield _piece(at, piece)

    pieces = pairs.select("slice", "item", "c").repartition("slice").sortWithinPartitions("slice").mapInArrow(work, "slice long, piece binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in stored(pieces, "filter").toLocalIterator():
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["piece"], np.uint8)
    return out


def _piece(at: int, piece: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(at)]), pa.array([np.packbits(piece, bitorder="little").tobytes()])], ["slice", "piece"])


def lookup(table: np.ndarray, item: np.ndarray, skipped: int = 0) -> np.ndarray:
    """Quantised count of every item, 0 where it is not in the filter; ``skipped`` as the filter was built."""
    bits = table.size * 8
    base = (item >> np.uint64(52)) * np.uint64(bits // SLICES)
    level = np.zeros(item.size, np.int64)
    active, step = np.arange(item.size), skipped + 1
    while active.size:
        block, inner = _positions(item[active], step, bits)
        spot = base[active] + block + inner
        held = ((table[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1).all(0)
        active = active[held]
        level[active] = step
        step += 1
    return np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)


OPEN = "array<struct<t:long,h:long,x:long,c:long,b:long,p:long,k:long>>"
SCORED = f"doc_id long, fold long, n_tokens long, n_known long, base double, model array<double>, open {OPEN}"


def _score(docs: DataFrame, words, counts, table, cut: int, least: int, total: float, weights: list[float], counted: bool) -> DataFrame:
    names = ["doc_id", "fold", "n_tokens", "n_known", "base", "model", "open"]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((words, counts, _groups(words), table))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            at = 0
            inside = counted & (batch.column(1).to_numpy() != HELD_OUT)
            for tokens, size in _together(batch.column(2).to_pylist()):
                end = at + size.size
                columns = _score_chunk(tokens, size, inside[at:end], *table, cut, least, total, weights)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, size.size).columns[:2], *columns], names)
                at = end

    return docs.select("doc_id", "fold", utf8()).mapInArrow(work, SCORED)


def _score_chunk(
    tokens: np.ndarray, size: np.ndarray, inside: np.ndarray, words, counts, first, table, cut: int, least: int, total: float, weights: list[float]
) -> list[pa.Array]:
    """Columns of ``SCORED`` after the first two; the documents' tokens are worked on end to end.

    Each document ends with the end token, which is just what stands before the first token of the next one. Tokens whose
    word, history or pair may be in a table only are left open, equal ones of a document once with their number ``k``. Where only
    the pair is open, the token is scored as if the pair was absent, and its entry serves to add what a pair found is worth.
    Documents ``inside`` the counts have only words and pairs that were counted: what stands below a threshold of two, stands once.
    """
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(size.size), size)
    c = _count_of(tokens, words, counts, first)
    before = np.concatenate((_count_of(np.array([END], np.uint64), words, counts, first), c[:-1]))
    pairs = _pairs(tokens)
    p = lookup(table, pairs, _skipped(least))
    p[p < 1 << (least.bit_length() - 1)] = 0  # less than the filter holds of any pair: found by chance
    own = inside[doc]
    if cut == 2:
        c[own & (c == 0)] = 1
        before[own & (before == 0)] = 1
    if least == 2:
        p[own & (p == 0)] = 1
    share = np.minimum(p, before) / np.maximum(before, 1)
    word_open, history_open = (c == 0) & (cut > 1), (before == 0) & (cut > 1)
    pair_open = (p == 0) & ((c > 0) | word_open) & ((before > 0) | history_open)
    sure = ~(word_open | history_open)
    word = np.log10((c + 1) / total)
    base = np.add.reduceat(np.where(sure, word, 0.0), begin)
    backed = np.add.reduceat((sure & (before > 0)).astype(np.int64), begin)
    paired = np.flatnonzero(sure & (share > 0))
    plain, bonus = 10 ** word[paired], share[paired]
    model = np.empty((size.size, len(weights)))
    for i, w in enumerate(weights):
        gain = np.log10(w * bonus + (1 - w) * plain) - word[paired] - np.log10(1 - w)
        model[:, i] = base + backed * np.log10(1 - w) + np.bincount(doc[paired], gain, size.size)
    known = np.add.reduceat((sure & (c > 0)).astype(np.int64), begin)
    rest = np.flatnonzero(~sure | pair_open)
    rest = rest[np.lexsort((pairs[rest], doc[rest]))]
    new = np.ones(rest.size, bool)
    new[1:] = (pairs[rest][1:] != pairs[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])
    k = np.diff(np.append(np.flatnonzero(new), rest.size))
    rest = rest[new]
    previous = np.concatenate((np.array([END], np.uint64), tokens[:-1]))
    keys = [
        pa.array(x[rest].view(np.int64), mask=~is_open[rest])
        for x, is_open in ((tokens, word_open), (previous, history_open), (pairs, pair_open))
    ]
    items = pa.StructArray.from_arrays([*keys, *(pa.array(x.astype(np.int64)) for x in (c[rest], before[rest], p[rest], k))], list("thxcbpk"))
    offsets = np.searchsorted(doc[rest], np.arange(size.size + 1)).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, model.size + 1, len(weights), dtype=np.int32)), pa.array(model.ravel()))
    return [pa.array(size), pa.array(known), pa.array(base), flat, pa.ListArray.from_arrays(pa.array(offsets), items)]


def _groups(words: np.ndarray) -> np.ndarray:
    """Where the words of each value of the first ``GROUP_BITS`` bits begin in the sorted ``words``."""
    return np.searchsorted(words >> np.uint64(64 - GROUP_BITS), np.arange((1 << GROUP_BITS) + 1, dtype=np.uint64)).astype(np.int32)


def _count_of(tokens: np.ndarray, words: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The count of every token, 0 where it is none of ``words``; only words of its group are looked at."""
    out = np.zeros(tokens.size, np.int64)
    group = (tokens >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    at, end = first[group], first[group + 1]
    left = np.flatnonzero(at < end)
    at, end, wanted = at[left], end[left], tokens[left]
    while left.size:
        hit = words[at] == wanted
        out[left[hit]] = counts[at[hit]]
        at += 1
        more = np.flatnonzero(~hit & (at < end))
        left, at, end, wanted = left[more], at[more], end[more], wanted[more]
    return out


def _threshold(columns: dict[int, int], limit: int) -> int:
    """Least threshold with at most ``limit`` items at or above it."""
    return min((t for t, n in columns.items() if n <= limit), default=max(columns))


def _totals(
    rows: DataFrame, words: DataFrame, pairs: DataFrame, weights: list[float], max_bits: int, max_words: int, bits_per_item: int, counted: bool
) -> tuple[DataFrame, int]:
    """(doc_id, fold, n_tokens, n_known, base_score, m0, m1, ..) per row, one m per weight; and the tokens counted in ``words``.

    ``counted``: the counts are those of all ``rows`` that are not held out. ``pairs`` are marked as ``asked`` where a row that
    was not counted has them.
    """
    steps = [1, 2, 3, *(2**i for i in range(2, 40))]
    stats = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *[F.count_if(F.col("c") >= t).alias(f"t{t}") for t in steps]).first()
    total = float(stats["n"] + stats["t1"] + 1)
    cut = _threshold({t: stats[f"t{t}"] for t in steps}, max_words)
    common = words.where(F.col("c") >= cut).toArrow()
    known = common.column("item").to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, counts = known[order], common.column("c").to_numpy()[order]

    level = F.length(F.bin("c"))
    sizes = pairs.agg(*[F.coalesce(F.sum(F.when(F.col("c") >= t, level - _skipped(t))), F.lit(0)).alias(f"t{t}") for t in steps[1:]]).first()
    # Pairs that stand once are in no filter, however small the table: counted rows know theirs, so rows asked for grow with the input.
    least = _threshold({t: sizes[f"t{t}"] for t in steps[1:]}, max_bits // bits_per_item)
    need = max(sizes[f"t{least}"] * bits_per_item, SLICES * BLOCK_BITS)
    bits = min(max_bits, 1 << (int(need) - 1).bit_length())
    table = build_filter(pairs.where(F.col("c") >= least).withColumn("slice", _slice()), bits, _skipped(least))

    scored = _score(rows, known, counts, table, cut, least, total, weights, counted).withColumn("row", F.monotonically_increasing_id())
    scored = stored(scored, "scores")
    models = [F.col("model")[i] for i in range(len(weights))]
    base, n_known = F.col("base"), F.col("n_known")
    gone = scored.select("row", F.posexplode("open").alias("i", "o")).select("row", "i", "o.*")
    quantised = F.expr("shiftleft(1L, length(bin(c)) - 1)")
    rare = words.where(F.col("c") < cut).select("item", F.col("c").alias("n"))
    below = pairs.where(F.col("c") < least)
    if least == 2 or not counted:
        below = below.where("asked")  # of the pairs that stand once, counted rows ask for none
    tables = {"t": rare, "h": rare, "x": below.select("item", quantised.alias("n"))}
    word = (F.col("c") + 1) / F.lit(total)

    def with_pair(w: float) -> Column:
        return F.log10(w * F.least("p", "b") / F.greatest(F.col("b"), F.lit(1)) + (1 - w) * word)

    # Where only the pair is open, words are known and above 0, and the token has been scored without the pair.
    lone = F.col("t").isNull() & F.col("h").isNull()
    found = gone.where(lone).select("row", "c", "b", "k", F.col("x").alias("item")).join(tables["x"].withColumnRenamed("n", "p"), "item")
    gains = [(F.col("k") * (with_pair(w) - F.log10((1 - w) * word))).alias(f"w{i}") for i, w in enumerate(weights)]
    tokens = found.select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("rest"), *gains)
    if cut > 1:
        keys = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("item"))) for k in tables]))
        several = gone.where(~lone).select("row", "i", "c", "b", "p", "k", F.explode(keys).alias("key")).select("row", "i", "c", "b", "p", "k", "key.*")
        every = reduce(DataFrame.union, [several.where(F.col("kind") == k).join(tables[k], "item", "left") for k in tables])
        # What a key stood for was 0 so far; a token can have several keys.
        values = [F.max(F.greatest(v, F.when(F.col("kind") == k, F.col("n")))).alias(v) for v, k in zip("cbp", tables, strict=True)]
        token = every.groupBy("row", "i").agg(*values, F.first("k").alias("k"))
        sums = [(F.col("k") * F.when(F.col("b") > 0, with_pair(w)).otherwise(F.log10(word))).alias(f"w{i}") for i, w in enumerate(weights)]
        known_now = F.when(F.col("c") > 0, F.col("k")).otherwise(0)
        tokens = tokens.union(token.select("row", known_now.alias("more"), (F.col("k") * F.log10(word)).alias("rest"), *sums))
    extra = tokens.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "rest", *(f"w{i}" for i in range(len(weights))))])
    complete = scored.drop("open").join(extra, "row", "left")
    models = [m + F.coalesce(f"w{i}", F.lit(0.0)) for i, m in enumerate(models)]
    base, n_known = base + F.coalesce("rest", F.lit(0.0)), n_known + F.coalesce("more", F.lit(0))
    named = [m.alias(f"m{i}") for i, m in enumerate(models)]
    return complete.select("doc_id", "fold", "n_tokens", n_known.alias("n_known"), base.alias("base_score"), *named), stats["n"]


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_bits: int = 1 << 28,
    max_words: int = 1 << 20,
    bits_per_item: int = 12,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, weight) per row."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), _fold(id_col).cast("long").alias("fold"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    train = rows.where(F.col("fold") != HELD_OUT)
    words, pairs = stored(word_counts(train), "word-counts"), stored(pair_counts(rows), "pair-counts")
    limits = (max_bits, max_words, bits_per_item)
    rest = [words.where("m > 0").withColumn("c", F.col("m")), pairs.where("m > 0").select("item", F.col("m").alias("c"), (F.col("c") > F.col("m")).alias("asked"))]
    tuned, _ = _totals(rows.where(F.col("fold") == TUNING), *rest, WEIGHTS, *limits, False)
    fits = stored(tuned, "tuned").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(len(WEIGHTS))]).first()
    best = max(range(len(WEIGHTS)), key=lambda i: (fits[f"m{i}"] is not None, fits[f"m{i}"] or 0.0))
    complete, tokens = _totals(rows, words, pairs, [WEIGHTS[best]], *limits, True)
    return complete.select(
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        F.col("m0").alias("score"),
        F.lit(WEIGHTS[best]).alias("weight"),
    )
