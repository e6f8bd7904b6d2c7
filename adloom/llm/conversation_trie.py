"""The prefix trie of conversations, aggregated by truncation peeling from the deepest turns upwards.

A node is a distinct sequence of first turns. Turns are ordered and numbered first (see ``running``), and a prefix is known by the sums of
position-dependent digests of its turns, so a conversation of any length can be cut between tasks. Then

1. one aggregate over all prefixes finds the nodes, their members and their smallest member;
2. nodes in a row with the same members form a chain: taking turns off inside it changes no group. So a step of the peeling takes
   off all turns down to the next depth at which conversations meet or one ends, instead of a single one;
3. the peeling descends from the greatest such depth. At each, conversations that end there and the survivors from below, cut to this
   depth, are grouped again by what is left, which adds up children, leaves and saved tokens; the merged chains survive;
4. nodes take their figures from their chain.

Each round reads only the chains that meet at its depth and stores what survives. The number of rounds is the number of depths at
which conversations meet, whatever the length of the longest one. Text is read once, for digest and word count, and never
shuffled.

Defined cases: rows without conversation id belong to none and are left out; null roles and texts are empty ones; turns with the same
number (null comes first) are ordered by their digest, repeated rows are turns of their own; an empty table has no nodes, not even
a root; very long texts only lengthen the digest; other columns are not looked at. Digests of 120 bits stand for equality.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.shared import shared_folder, stored

# Three numbers of 40 bits each: their sums stay within a long for conversations of up to eight million turns.
LANES = ("s1", "s2", "s3")
NODE = ["depth", *LANES]
UP = ["up", *(f"u{i}" for i in (1, 2, 3))]
# Ids in one piece of a list that is hashed.
PIECE = 8192


def running(rows: DataFrame, group: str, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds ``pos``, the row's number from 0 in its group, and the running sums, both in the given order; a group may be of any size.

    Rows are laid out by range, so a large group is cut into parts, which are numbered on their own and moved up by what stands before
    them. Only groups that a boundary cuts need that: at most two rows for every partition, which is what is broadcast.
    """
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    laid = stored(ranged.withColumn("part", F.spark_partition_id()), "laid")
    local = Window.partitionBy(group, "part").orderBy(*order)
    until = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = laid.withColumns({"pos": F.row_number().over(local).cast("bigint") - 1, **{n: F.sum(c).over(until) for n, c in sums.items()}})
    parts = laid.groupBy(group, "part").agg(F.count(F.lit(1)).alias("pos"), *[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["pos", *sums]
    moved = parts.select(group, "part", *[F.sum(n).over(before).alias(f"_{n}") for n in names]).where("_pos IS NOT NULL")
    joined = numbered.join(F.broadcast(moved), [group, "part"], "left")
    return joined.withColumns({n: F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in names}).drop("part", *(f"_{n}" for n in names))


def ordered_turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, pos, turn digest, words) of every turn with a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"),
        F.col(turn_col).alias("number"),
        F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    return running(stored(rows, "turns"), "conv", ["number", "digest"], {}).drop("number")


def members(turns: DataFrame) -> DataFrame:
    """(conv, n): every conversation with its number of turns."""
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def rebuilt(turns: DataFrame, span: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings, to have prefixes in common: turns and members.

    Conversation c gets the first h = crc32(c) % ``most`` turns of conversation c - c % ``span``, then its own from the h-th on.
    """
    counted = stored(members(turns), "members")
    heads = F.crc32(F.col("conv").cast("string")) % most
    base = F.col("conv") - F.col("conv") % span
    lengths = counted.select(F.col("conv").alias("base"), F.col("n").alias("held")).where(F.col("base") % span == 0)
    joined = counted.withColumns({"h": heads, "base": base}).join(lengths, "base", "left")
    joined = joined.withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    plan = stored(joined.withColumn("m", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    # A beginning has fewer than ``most`` turns and goes to the conversations of one span.
    lent = turns.where(f"conv % {span} = 0 AND pos < {most - 1}").withColumnRenamed("conv", "base")
    first = lent.join(plan.where("taken > 0").select("conv", "base", "taken"), "base").where("pos < taken")
    own = turns.join(plan.select("conv", "h", "taken"), "conv").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    kept = ["conv", "pos", "digest", "words"]
    return first.select(*kept).unionByName(own.select(*kept)), plan.select("conv", F.col("m").alias("n"))


def _lanes() -> list[Column]:
    """The digest of a turn at its place, as three numbers."""
    placed = F.md5(F.concat_ws(":", "at", "digest").cast("binary"))
    return [F.conv(F.substring(placed, 1 + 10 * i, 10), 16, 10).cast("bigint") for i in range(3)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix but the empty one: conversation, depth, digest sums, those of the prefix one turn shorter, words of the last turn
    and of all turns."""
    own = [f"f{i}" for i in (1, 2, 3)]
    rows = turns.withColumnRenamed("pos", "at").withColumns(dict(zip(own, _lanes(), strict=True))).drop("digest")
    summed = running(rows, "conv", ["at"], {**{s: F.col(f) for s, f in zip(LANES, own, strict=True)}, "path": F.col("words")})
    up = [(F.col(s) - F.col(f)).alias(u) for s, f, u in zip(LANES, own, UP[1:], strict=True)]
    return summed.select("conv", (F.col("pos") + 1).alias("depth"), *LANES, F.col("pos").alias("up"), *up, "words", "path")


def _peeled(chains: DataFrame) -> DataFrame:
    """(conv, n, children, leaves, below) of every chain: children and leaves at its lower end, and the tokens saved below that.

    ``chains`` (conv, n, depth and sums of the lower end, up and sums above the upper end, own) are stored.
    """
    spark = chains.sparkSession
    met = chains.groupBy(*UP).agg(F.count(F.lit(1)).alias("children")).where("up >= 0")
    joined = chains.join(met.select(*[F.col(u).alias(k) for u, k in zip(UP, NODE, strict=True)], "children"), NODE, "left")
    waiting, survivors = (f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}" for name in ("waiting", "survivors"))
    joined = stored(joined, "meeting")
    _append(joined.where("children IS NOT NULL").drop("children"), waiting, "depth")
    none, one = (F.lit(i).cast("bigint") for i in (0, 1))
    leaves = joined.where("children IS NULL").withColumns({"children": none, "leaves": one, "below": none})
    _append(leaves, survivors, "up")
    inner = spark.read.schema(chains.schema).parquet(waiting)
    for depth in sorted((r[0] for r in inner.select("depth").distinct().collect()), reverse=True):
        # The survivors that meet at this depth, cut to it, are grouped by what is left of them.
        cut = spark.read.schema(leaves.schema).parquet(survivors).where(F.col("up") == depth)
        sums = [F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.col("below") + F.col("own")).alias("below")]
        grouped = cut.groupBy(*UP[1:]).agg(*sums).withColumnsRenamed(dict(zip(UP[1:], LANES, strict=True)))
        merged = inner.where(F.col("depth") == depth).join(grouped, list(LANES)).select(*leaves.columns)
        _append(merged, survivors, "up")
    every = spark.read.schema(leaves.schema).parquet(survivors)
    return every.select("conv", "n", F.col("depth").alias("bottom"), F.col("path").alias("deepest"), "children", "leaves", "below")


def _append(rows: DataFrame, path: str, by: str) -> None:
    """Adds the rows to the table at ``path``, a folder for each value of ``by``."""
    rows.hint("rebalance", by).write.mode("append").option("compression", "zstd").partitionBy(by).parquet(path)


def _hashed(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ascending ids of the conversations that end at each node, joined by commas.

    Ids are laid out by range and joined to pieces first, so even the ids of one large group are sorted by many tasks; the digest itself, which
    has to be taken in order, is streamed over the pieces.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (row[:4] != held or len(ids) == PIECE):
                    out.append((*held, ids[0], ",".join(map(str, ids))))
                    ids = []
                held = row[:4]
                ids.append(row[4])
            yield _rows(out, [*NODE, "first", "ids"], 5)
        if ids:
            yield _rows([(*held, ids[0], ",".join(map(str, ids)))], [*NODE, "first", "ids"], 5)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] == held:
                    state.update(b"," + row[5].encode())
                    continue
                if held is not None:
                    out.append((*held, state.hexdigest()))
                held, state = row[:4], hashlib.sha256(row[5].encode())
            yield _rows(out, [*NODE, "ends_sha256"], 4)
        if held is not None:
            yield _rows([(*held, state.hexdigest())], [*NODE, "ends_sha256"], 4)

    node = "depth bigint, s1 bigint, s2 bigint, s3 bigint"
    columns = [*NODE, "conv"]
    sorted_ = stored(ends.select(*columns), "ends").repartitionByRange(*columns).sortWithinPartitions(*columns)
    joined = sorted_.mapInArrow(pieces, f"{node}, first bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{node}, ends_sha256 string")


def _rows(rows: list[tuple], names: list[str], longs: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    kinds = [pa.int64()] * longs + [pa.string()] * (len(names) - longs)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def prefix_trie(turns: DataFrame, counted: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, pos, digest, words); ``counted`` (conv, n) has every conversation, with or without turns.

    Returns, per node: its identity (depth and digest sums), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    prefixes = stored(_prefixes(turns), "prefixes")
    least, n = F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")
    same = [F.first(c).alias(c) for c in (*UP, "words", "path")]
    found = prefixes.groupBy(*NODE).agg(least, n, *same)
    zero = F.lit(0).cast("bigint")
    top = counted.agg(least, n).where("n > 0")
    blank = {**{k: zero for k in (*NODE, "words", "path")}, "up": F.lit(-1).cast("bigint"), **{u: zero for u in UP[1:]}}
    nodes = stored(found.unionByName(top.withColumns(blank)), "nodes")

    # Nodes with the same smallest member lie on one path, and those of them with as many members have the same members.
    lower = F.max(F.struct(*NODE, "path")).alias("lower")
    upper = F.min(F.struct("depth", *UP, (F.col("path") - F.col("words")).alias("above"))).alias("upper")
    chains = nodes.groupBy("conv", "n").agg(lower, upper)
    own = ((F.col("n") - 1) * (F.col("lower.path") - F.col("upper.above"))).alias("own")
    chains = stored(chains.select("conv", "n", "lower.*", *[f"upper.{u}" for u in UP], own), "chains")
    figures = _peeled(chains)

    ended = prefixes.join(counted, "conv").where("depth = n").select("conv", *NODE)
    turnless = counted.where("n = 0").select("conv", *[zero.alias(k) for k in NODE])
    hashed = _hashed(ended.unionByName(turnless))
    # Below the root every depth-1 node would meet in one task; the root's smallest member is a single number.
    root = counted.agg(F.min("conv")).first()[0]
    parents = nodes.where("depth > 0").select(*[F.col(k).alias(u) for k, u in zip(NODE, UP, strict=True)], F.col("conv").alias("parent"))
    high = nodes.where("up <= 0").withColumn("parent", F.when(F.col("up") == 0, F.lit(root).cast("bigint")))
    joined = nodes.where("up > 0").join(parents, UP, "left").unionByName(high)
    full = joined.join(figures, ["conv", "n"]).join(hashed, NODE, "left")
    saved = F.col("below") + (F.col("n") - 1) * (F.col("deepest") - F.col("path") + F.col("words"))
    return full.select(
        *NODE,
        F.col("conv").alias("conv_id"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("bottom"), F.lit(1)).otherwise(F.col("children")).cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of a table of conversations as it stands."""
    turns = stored(ordered_turns(conversations), "ordered-turns")
    return prefix_trie(turns, stored(members(turns), "members"))
