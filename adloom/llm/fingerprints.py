"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame expressions only.

A text is the set of its paragraphs' digests; a paragraph longer than ``PIECE`` characters counts as several. A digest has 48 bits
of hash and 16 bits of check, so a cell that holds exactly one is recognised. Every digest is entered in one cell of each of
three tables; a cell has a count and the exclusive-or of its digests. The cells of one version minus those of another
hold only what differs; peeling takes out cells with one digest until none is left. A comparison that does not
come out is repeated with four times as many cells.

Cells are rows. They are grouped by document after one exchange of its digests, so building and all rounds of peeling are
aggregates inside one stage, and a long document costs in proportion to its length.

The next document of each is found without a global sort: ids are cut at quantiles, each range is one window, and a guard row
with the first text of the following range closes it.

Defined cases: a null text is empty, and two texts without paragraphs are alike (1.0); a null id comes first; rows with
the same id are ordered by text; a single row is its own successor; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.shared import NO_ID, stored

PIECE = 128
TABLES, SLOTS = 3, 8
ROUNDS = 4
EDITED, NEXT = 0, 1
# Share of the digests of both versions that is expected to differ; it only sets the first number of cells.
EXPECTED = {EDITED: 0.4, NEXT: 1.0}
_KEYS = ["row", "pair", "m", "cell"]
_RECOVERED = -1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def digests(text: str) -> Column:
    """Distinct paragraph digests of a text column."""
    high = f"(xxhash64(p) & {~0xFFFF}L)"
    pieces = f"regexp_extract_all({text}, '[^\\n]{{1,{PIECE}}}', 0)"
    return F.expr(f"array_distinct(transform({pieces}, p -> {high} | CAST(hash({high}) & 65535 AS BIGINT)))")


def _place(table: str, digest: str, slots: str) -> str:
    return f"CAST({table} * {slots} + pmod(xxhash64({digest}, {table}), {slots}) AS INT)"


def cells(items: DataFrame) -> DataFrame:
    """Non-empty cells of the signed digests (row, pair, m, n, k), m slots in each table."""
    entered = items.withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])))
    entered = entered.select("row", "pair", "m", F.expr(_place("t", "k", "m")).alias("cell"), "n", "k")
    return entered.groupBy(*_KEYS).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k")).where("n <> 0 OR k <> 0")


def peel_round(found: DataFrame) -> DataFrame:
    """Takes every digest that is alone in a cell out of all its cells and adds it as a row of cell -1.

    A digest alone in several cells is taken out once: equal removals are combined before they are applied.
    """
    alone = f"cell >= 0 AND abs(n) = 1 AND (k & 65535) = (hash(k & {~0xFFFF}L) & 65535)"
    takes = [f"struct({_place(str(t), 'k', 'm')} AS cell, 1 AS take, -n AS n, k AS k)" for t in range(TABLES)]
    gain = f"struct({_RECOVERED} AS cell, 1 AS take, n AS n, k AS k)"
    own = "struct(cell AS cell, 0 AS take, n AS n, k AS k)"
    rows = found.select("row", "pair", "m", F.expr(f"inline(if({alone}, array({own}, {', '.join(takes)}, {gain}), array({own})))"))
    once = rows.groupBy(*_KEYS, "take", "k").agg(F.min("n").alias("n"))
    apart = F.expr(f"if(cell = {_RECOVERED}, k, 0L)").alias("own")
    left = once.groupBy(*_KEYS, apart).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"))
    return left.where("n <> 0 OR k <> 0").drop("own")


def differences(versions: DataFrame, growth: int) -> DataFrame:
    """Recovered digests (cell -1, n the side they stand on) and cells that could not be emptied, per (row, pair)."""

    def signed(column: str, pair: int, n: int) -> str:
        return f"transform({column}, d -> struct({pair} AS pair, m{pair} AS m, CAST({n} AS BIGINT) AS n, d AS k))"

    parts = [signed("a", EDITED, 1), signed("b", EDITED, -1), signed("a", NEXT, 1), signed("c", NEXT, -1)]
    sizes = {
        f"m{pair}": F.expr(f"CAST({growth} * greatest(4, ceil((size(a) + size({other})) * {EXPECTED[pair]})) AS INT)")
        for pair, other in ((EDITED, "b"), (NEXT, "c"))
    }
    items = versions.withColumns(sizes).select("row", F.expr(f"inline(concat({', '.join(parts)}))"))
    found = cells(items)
    for _ in range(ROUNDS):
        found = peel_round(found)
    return found


def _likeness(pair: int, other: str) -> Column:
    total, differing = f"(size(a) + size({other}))", f"coalesce(d{pair}, 0L)"
    return F.expr(f"if({total} = 0, 1D, CAST({total} - {differing} AS DOUBLE) / CAST({total} + {differing} AS DOUBLE))")


def peeled(versions: DataFrame) -> DataFrame:
    """(row, d0, d1): number of differing digests of both comparisons, for the rows that differ at all. Stored."""
    pending, growth, done = versions.select("row", "a", "b", "c"), 1, None
    while True:
        found = differences(pending.repartition("row"), growth).groupBy("row").agg(
            F.count_if(F.col("cell") >= 0).alias("open"),
            *[F.count_if((F.col("cell") == _RECOVERED) & (F.col("pair") == pair)).alias(f"d{pair}") for pair in (EDITED, NEXT)],
        )
        found = stored(found, "peeled")
        settled = found.where("open = 0").drop("open")
        done = settled if done is None else done.union(settled)
        failed = found.where("open > 0").select("row")
        if failed.isEmpty():
            return done
        pending, growth = stored(versions.select("row", "a", "b", "c").join(failed, "row"), "pending"), growth * 4


def sketches(versions: DataFrame) -> DataFrame:
    """(row, fingerprint, edited_fingerprint): the 24-cell sketches, count and exclusive-or of every cell in hexadecimal.

    Empty cells are left out; a cell is written as number:count:digests.
    """
    both = "concat(transform(a, d -> struct(0 AS side, d AS k)), transform(b, d -> struct(1 AS side, d AS k)))"
    items = versions.select("row", F.expr(f"inline({both})")).withColumn("t", F.explode(F.array(*[F.lit(t) for t in range(TABLES)])))
    items = items.select("row", "side", F.expr(_place("t", "k", str(SLOTS))).alias("cell"), "k")
    held = items.groupBy("row", "side", "cell").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("k").alias("k"))
    shown = held.select("row", "side", F.expr("concat(lpad(hex(cell), 2, '0'), ':', hex(n), ':', hex(k))").alias("shown"))

    def side(number: int) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(F.col("side") == number, F.col("shown")))), " ")

    return shown.groupBy("row").agg(side(0).alias("fingerprint"), side(1).alias("edited_fingerprint"))


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """(id, text, next_text): every document with the text of the one after it by id, the last with that of the first."""
    spark = docs.sparkSession
    ranges = ranges or min(2000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("id", _long(NO_ID)))
    cuts = rows.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)] or [0.5], 10 * ranges)).first()[0] or []
    bounds = F.array(*[_long(c) for c in sorted(set(cuts))]) if cuts else F.array(_long(0))
    size = max(1, len(set(cuts)))

    def search(at: Column, step: Column) -> Column:
        return F.when((at + step <= size) & (F.get(bounds, at + step - 1) < F.col("k")), at + step).otherwise(at)

    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    rows = rows.withColumn("range", F.aggregate(steps, F.lit(0), search))
    least = rows.groupBy("range").agg(F.min("k").alias("k"))
    heads = rows.select("range", "k", "text").join(F.broadcast(least), ["range", "k"]).groupBy("range").agg(F.min("text").alias("text"))
    over = Window.orderBy("range")  # one row per range
    following = F.coalesce(F.lead("text").over(over), F.first("text").over(over))
    guards = heads.select(F.lit(None).cast("long").alias("id"), following.alias("text"), _long(0).alias("k"), "range", F.lit(True).alias("guard"))
    both = rows.select("id", "text", "k", "range", F.lit(False).alias("guard")).union(guards)
    inside = Window.partitionBy("range").orderBy("guard", "k", "text")
    return both.withColumn("next_text", F.lead("text").over(inside)).where(~F.col("guard")).select("id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last quarter comes from the start of the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); the likeness is the number
    of shared digests over that of all, from the sizes and the peeled difference.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr("concat(substring(text, 1, CAST(n_chars - n_chars DIV 4 AS INT)), substring(next_text, 1, CAST(n_chars DIV 4 AS INT)))")
    rows = rows.withColumn("edited", edited)
    versions = rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digests("text").alias("a"), digests("edited").alias("b"), digests("next_text").alias("c"),
    )
    versions = stored(versions, "versions")
    near = peeled(versions)
    joined = versions.join(near, "row", "left").join(sketches(versions.select("row", "a", "b").repartition("row")), "row", "left")
    return joined.select(
        "id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"), F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        _likeness(EDITED, "b").alias("near_edited"), _likeness(NEXT, "c").alias("near_next"),
    )
