"""Near-duplicate documents by min-max hashing of word shingles, confirmed on the full sets.

Of every hash function both the minimum and the maximum over a document's shingles are kept, so 144 evaluations give 288
values. Bands of six values are hashed to buckets; two sets of similarity 0.8 miss each other in all 48 bands
with probability 5e-7.

Unlike pairs are ruled out while buckets are joined, before anything is written or a text is looked at. First by one bit of each of 256 of
the values: sets of similarity s agree in a bit with probability (1 + s) / 2, so a pair that agrees in fewer, by five standard
deviations, than the wanted similarity gives is unlike. Then by the parity of the shingles that fall on each of 2304 places: two sets differ in
no more places than they have shingles apart, so a pair that differs in more than the wanted similarity allows is unlike for certain; in
long texts, where several of these fall on one place, five standard deviations above the mean count again. Together this misses
a pair at the limit with probability 6e-7.

Documents with equal sets form one class, and only classes are compared. First each class is compared with one leader: of those in its
buckets that may be similar, the one that meets most others, such as the original of many near copies. Where a bucket then still holds
several components, the rest of its pairs follow, those with its next leaders first; only pairs across components that are not
ruled out and were not compared before. So every pair of a bucket is inside one component, unlike or compared.

Defined cases: a null or blank text has no set and is linked with nothing; rows that repeat an id share its result; a row
without id can link others but has a null component unless a row with an id is reachable; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm import grams
from adloom.llm.shared import components, keyed, stored, utf8

FUNCTIONS, BANDS, ROWS = 144, 48, 6
WORDS = 4
SKETCH = [f"x{i}" for i in range(WORDS)]
SETS = "k1 long, k2 long, n long, class long, bands array<long>, parity array<long>, " + ", ".join(f"{x} long" for x in SKETCH)
# How far below its mean the agreement of a similar pair may be, and how many leaders the rounds across components compare with.
DEVIATIONS = 5.0
PLACES = 2304
LEADERS = (8, 1 << 40)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_ODD = _RNG.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 4096


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of the whole sequence if there are fewer words."""
    words = grams.word_hashes(text.lower())
    if words.size == 0:
        return words
    return np.unique(grams.window_hashes(words, min(size, words.size), min(size, words.size)))


def band_keys(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One bucket key per band of the min-max signature, the parity of the items on each place, and one bit of each value."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max)
    high = np.zeros(FUNCTIONS, np.uint64)
    for at in range(0, items.size, _CHUNK):
        image = _ODD[:, None] * items[None, at : at + _CHUNK]
        np.minimum(low, image.min(1), out=low)
        np.maximum(high, image.max(1), out=high)
    signature = grams.mix(np.stack((low, high), 1).reshape(BANDS, ROWS))
    keys = (signature * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    bits = (signature.ravel()[: 64 * WORDS] & np.uint64(1)).astype(np.uint8)
    places = (grams.mix(items + np.uint64(1)) % np.uint64(PLACES)).astype(np.int64)
    parity = (np.bincount(places, minlength=PLACES) & 1).astype(np.uint8)
    return grams.mix(keys).view(np.int64), np.packbits(parity).view(np.int64), np.packbits(bits).view(np.int64)


def document_sets(rows: DataFrame, size: int) -> DataFrame:
    """Set size, class (hash of the set) and band keys of every row; class and bands are null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, bands, parities, sketches = [], [], [], [], []
            for text in batch.column(2):
                items = shingles(text.as_py(), size)
                n.append(items.size)
                digest = hashlib.blake2b(items.tobytes(), digest_size=8).digest()
                classes.append(int.from_bytes(digest, "little", signed=True) if items.size else None)
                keys, parity, sketch = band_keys(items) if items.size else (None, None, np.zeros(WORDS, np.int64))
                bands.append(keys)
                parities.append(parity)
                sketches.append(sketch)
            columns = [pa.array(n, pa.int64()), pa.array(classes, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, parities))]
            columns += [pa.array(x) for x in np.array(sketches, np.int64).reshape(-1, WORDS).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["k1", "k2", "n", "class", "bands", "parity", *SKETCH])

    return rows.select("k1", "k2", utf8()).mapInArrow(work, SETS)


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets, given by their size and sketch, can have the similarity."""
    differing = " + ".join(f"bit_count({a}{x} ^ {b}{x})" for x in SKETCH)
    bits, share = 64 * WORDS, (1 + percent / 100) / 2
    least = math.floor(bits * share - DEVIATIONS * math.sqrt(bits * share * (1 - share)))
    return F.expr(f"100 * least({a}n, {b}n) >= {percent} * greatest({a}n, {b}n) AND {differing} <= {bits - least}")


def _close(a: str, b: str, percent: int) -> Column:
    """The same by the places in which two sets differ: at most as many as shingles that only one has."""
    apart = f"floor(({a}n + {b}n) * {100 - percent} / {100 + percent})"
    even, both = (f"pow({1 - k / PLACES!r}D, {apart})" for k in (2, 4))
    mean = f"{PLACES / 2}D * (1 - {even})"
    spread = f"sqrt(greatest(0, {PLACES / 4}D * (1 - {even} * {even}) + {PLACES * (PLACES - 1) / 4}D * ({both} - {even} * {even})))"
    differing = f"aggregate(zip_with({a}parity, {b}parity, (x, y) -> x ^ y), 0, (n, x) -> n + CAST(bit_count(x) AS INT))"
    return F.expr(f"{differing} <= least({apart}, {mean} + {DEVIATIONS} * {spread} + 1)")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose sets reach the similarity; compared on the whole texts."""
    member = pairs.join(texts.select(F.col("class").alias("u"), F.col("text").alias("first")), "u")
    both = member.join(texts.select(F.col("class").alias("v"), F.col("text").alias("second")), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, items = None, None
        for batch in batches:
            u, v = [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != known:
                    known, items = b, shingles(y, size)
                other = shingles(x, size)
                shared = np.intersect1d(items, other, assume_unique=True).size
                if 100 * shared >= percent * (items.size + other.size - shared):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return both.select("u", "v", utf8("first"), utf8("second")).mapInArrow(work, "u long, v long")


def _mixed(members: DataFrame, parts: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, each with its component. Stored."""
    placed = members.join(parts.withColumnRenamed("node", "class"), "class", "left")
    placed = placed.select("key", "class", "n", *SKETCH, "meets", F.coalesce("component", "class").alias("part"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    return stored(placed.join(mixed, "key").join(classes.select("class", "parity"), "class"), "mixed")


def _across(opened: DataFrame, tested: DataFrame, leaders: int, percent: int) -> DataFrame:
    """Pairs of members of different components with the first ``leaders`` of their bucket that may be similar and are not yet
    tested. Stored."""
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("meets"), F.xxhash64("class"), "class"))
    heads = opened.withColumn("order", order).where(F.col("order") <= leaders).drop("order", "meets")
    heads = heads.select("key", *[F.col(c).alias(f"h_{c}") for c in ("class", "n", *SKETCH, "parity", "part")])
    # Where all are leaders a pair would be found from both sides.
    once = F.lit(True) if leaders < LEADERS[-1] else F.expr("class < h_class")
    apart = F.expr("part <> h_part") & _alike("", "h_", percent) & once & _close("", "h_", percent)
    met = opened.join(heads, (opened["key"] == heads["key"]) & apart)
    pairs = met.select(F.least("class", "h_class").alias("u"), F.greatest("class", "h_class").alias("v")).distinct()
    done = tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return stored(pairs.join(done, ["u", "v"], "left_anti"), "pairs")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """(k1, k2, group, id, n_shingles, component_id, kept) per row of ``docs``; the group is null for an empty set.

    Components are those of the graph that links sets with ``100 * intersection >= percent * union``.
    """
    rows = keyed(docs, id_col, text_col)
    sets = stored(document_sets(rows, size), "sets")
    ids = sets.where("class IS NOT NULL").withColumn("id", F.expr(f"nullif(k1, {-(1 << 63)})"))
    same = [F.first(c).alias(c) for c in ("n", "bands", "parity", *SKETCH)]
    grouped = ids.groupBy("class").agg(F.min("id").alias("id"), F.min(F.struct("k1", "k2")).alias("row"), *same)
    classes = stored(grouped, "classes")
    banded = classes.select("class", "n", *SKETCH, F.explode("bands").alias("key"))
    buckets = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    met = stored(banded.join(buckets, "key"), "met")
    members = met.join(met.groupBy("class").agg(F.sum(F.col("c") - 1).alias("meets")), "class")
    leader = F.max(F.struct("meets", F.xxhash64("class").alias("h"), "class", "n", *SKETCH)).alias("leader")
    members = stored(members, "members")
    wanted = members.select("class").distinct().join(classes.select("class", "row.*"), "class")
    texts = stored(rows.drop("id").join(wanted, ["k1", "k2"]).select("class", "text").dropDuplicates(["class"]), "texts")

    # One comparison per class: with the leader of its buckets that meets most others.
    led = members.join(members.groupBy("key").agg(leader), "key").where("class <> leader.class")
    best = led.where(_alike("", "leader.", percent)).groupBy("class").agg(F.max("leader").alias("leader"))
    tested = stored(best.select(F.col("class").alias("u"), F.col("leader.class").alias("v")), "pairs")
    links = stored(confirm(tested, texts, size, percent), "links")
    parts = stored(components(links), "components")
    for leaders in LEADERS:
        fresh = _across(_mixed(members, parts, classes), tested, leaders, percent)
        tested = tested.union(fresh)
        more = stored(confirm(fresh, texts, size, percent), "links")
        if not more.isEmpty():
            links = links.union(more)
            parts = stored(components(links), "components")

    joined = classes.select("class", "id").join(parts.withColumnRenamed("node", "class"), "class", "left")
    joined = joined.withColumn("component", F.coalesce("component", "class"))
    smallest = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(joined.join(smallest, "component").select("class", F.col("component").alias("group"), "component_id"), "names")
    found = sets.select("k1", "k2", "n", "class", F.expr(f"nullif(k1, {-(1 << 63)})").alias("id")).join(named, "class", "left")
    component = F.expr("if(class IS NULL, id, component_id)")
    return found.select(
        "k1", "k2", "group", "id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )
