"""Operators on documents against plain versions, with every defined case."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from adloom.llm import (
    bloom_lm,
    fingerprints,
    language_id,
    lattice_sampling,
    license_scan,
    minmax_dedup,
    packing,
    phrase_dedup,
    suffix_dedup,
)



def total():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])


@pytest.mark.parametrize("split_at", [1, 1000])
def test_phrases(docs, texts, same, split_at):
    found = phrase_dedup.remove_recurring(docs, split_at=split_at, carry=("k1", "span"))
    assert found.columns == ["id", "kept", "n_words", "spans", "k1", "span"]
    same(found.select("id", "n_words", total(), F.sha2("kept", 256)).collect(), brute.phrases(texts))


def test_phrases_split(spark, same):
    """Three documents share a passage in different surroundings; the anchor has two parts, and they stand 2:1 in most."""
    rng = random.Random(11)
    word = lambda: f"v{rng.randrange(10**6)}"
    rows = []
    for i in range(40):
        shared = [word() for _ in range(36)]
        rows += [(3 * i + k, " ".join([*(word() for _ in range(20)), *shared, *(word() for _ in range(20))])) for k in range(3)]
    # Parts in different tasks, as those of a frequent anchor are.
    apart = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in apart}
    try:
        for k, v in apart.items():
            spark.conf.set(k, v)
        found = phrase_dedup.remove_recurring(spark.createDataFrame(rows, "doc_id long, text string"), split_at=2)
        same(found.select("id", "n_words", total(), F.sha2("kept", 256)).collect(), brute.phrases(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("split_at", [1, 1000])
def test_substrings(docs, texts, same, split_at):
    found = suffix_dedup.remove_repeats(docs, split_at=split_at)
    got = found.select("id", "n_bytes", total(), F.size("spans"), F.sha2("kept", 256)).collect()
    same(got, brute.substrings(texts))


def test_suffix_order():
    import numpy as np

    data = b"banana\x00banana\x00bananabananab"
    size = [7, 7, 13]
    ends = np.repeat(np.cumsum(size), size)
    order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), ends)
    shared = suffix_dedup.common_prefixes(np.frombuffer(data, np.uint8), ends, order)
    suffix = [data[i : ends[i]] for i in order]
    assert suffix == sorted(suffix)
    for a, b, i in zip(suffix, suffix[1:], order[1:], strict=False):
        assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_near(docs, texts, same):
    unique = {i: t for i, t in texts if i is not None and (i, t) != (36, None)}
    rows = docs.where("doc_id IS NOT NULL AND NOT (doc_id = 36 AND text IS NULL)").dropDuplicates(["doc_id"])
    found = minmax_dedup.near_duplicates(rows, size=2)
    same(found.select("id", "n_shingles", "component_id", "kept").collect(), brute.near(list(unique.items())))


def test_near_all_rows(docs):
    found = minmax_dedup.near_duplicates(docs)
    assert found.count() == docs.count()
    assert {r["component_id"] for r in found.where("id IN (1, 2, 3)").collect()} == {1}
    assert found.where("n_shingles = 0 AND group IS NOT NULL").isEmpty()


def test_near_without_leader(spark):
    """A chain whose ends are unlike each other, and two groups that meet in the same buckets."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(20)]
    found = minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2)
    got = sorted(tuple(r) for r in found.select("id", "n_shingles", "component_id", "kept").collect())
    assert got == brute.near(rows)


def test_fingerprints(docs, texts):
    unique = {i: t for i, t in texts if i is not None and (i, t) != (36, None)}
    rows = docs.where("doc_id IS NOT NULL AND NOT (doc_id = 36 AND text IS NULL)").dropDuplicates(["doc_id"])
    found = fingerprints.edited_fingerprints(rows).collect()
    got = sorted((r.id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found)
    assert got == brute.edits(list(unique.items()))
    by_id = {r.id: r for r in found}
    assert by_id[1].fingerprint == by_id[2].fingerprint != by_id[3].fingerprint


def test_fingerprints_retry(docs, monkeypatch):
    """With too few cells peeling fails at first, and larger sketches succeed."""
    want = {r.id: r.near_next for r in fingerprints.edited_fingerprints(docs.where("doc_id < 32")).collect()}
    monkeypatch.setitem(fingerprints.EXPECTED, fingerprints.NEXT, 0.05)
    got = {r.id: r.near_next for r in fingerprints.edited_fingerprints(docs.where("doc_id < 32")).collect()}
    assert got == want


def test_fingerprints_all_rows(docs):
    assert fingerprints.edited_fingerprints(docs).count() == docs.count()


def test_licenses(docs, texts, same):
    same(license_scan.labelled(docs).collect(), brute.licenses(texts))


def test_licenses_suppressed(spark):
    text = "spdx-license-identifier: GPL-3.0 ... licensed under the CC BY-NC-SA 4.0 license, the BSD 3-clause license"
    row = license_scan.labelled(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "bsd-3-clause,cc-by-nc,cc-by-nc-sa,gpl-3"


def test_scores(docs, texts):
    rows = [(i, t) for i, t in texts if i is not None]
    found = bloom_lm.score_documents(docs.where("doc_id IS NOT NULL"), max_words=50)
    got = sorted((*r[:5], round(r["base_score"], 6)) for r in found.collect())
    for g, w in zip(got, sorted(brute.word_model(rows)), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], abs=2e-6)
    assert all(r["score"] < 0 for r in bloom_lm.score_documents(docs).collect())


@pytest.mark.parametrize("sizes", [{}, {"max_words": 5, "bits_per_item": 1 << 22}], ids=["broadcast", "joined"])
def test_scores_use_all_counts(spark, sizes):
    """Pairs of every fold but the held-out one and pairs seen once count, whatever is broadcast and whatever joined."""
    rng = random.Random(5)
    rows = []
    for i in range(120):
        w = [rng.randrange(60)]
        for _ in range(rng.randrange(60)):
            w.append((7 * w[-1] + 1) % 60 if rng.random() < 0.7 else rng.randrange(90))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    rows += [(500, ""), (501, None), (502, "zz zz zz zz unseen zz zz")]
    weight, want = brute.pair_model(rows, bloom_lm.WEIGHTS)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bloom_lm.score_documents(table, **sizes).collect()}
    assert {r.weight for r in got.values()} == {weight} and weight > 0
    assert {i: r.score for i, r in got.items()} == pytest.approx(want, abs=1e-6)


def test_counted_rows_need_no_join(spark, monkeypatch):
    """Where only words and pairs that stand once are not broadcast, rows of the training part leave nothing open."""
    rng = random.Random(31)
    rows = [(i, " ".join(f"w{rng.randrange(300) if rng.random() < 0.7 else rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scores, store = [], bloom_lm.stored

    def kept(df, label):
        out = store(df, label)
        if label == "scores":
            scores.append(out)
        return out

    full = {r.doc_id: r for r in bloom_lm.score_documents(docs).collect()}
    monkeypatch.setattr(bloom_lm, "stored", kept)
    # Words that stand twice fit, and so do pairs, but not all of either.
    got = bloom_lm.score_documents(docs, max_words=600, bits_per_item=(1 << 28) // 1200).collect()
    assert len(scores) == 2
    left = {r.fold == bloom_lm.HELD_OUT: r.n for r in scores[1].groupBy("fold").agg(F.sum(F.size("open")).alias("n")).collect() if r.n}
    assert set(left) == {True}
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (full[r.doc_id].n_tokens, full[r.doc_id].n_known, full[r.doc_id].train_tokens)
        assert r.base_score == pytest.approx(full[r.doc_id].base_score) and r.score == pytest.approx(full[r.doc_id].score, rel=1e-6)


def test_filter_leaves_out_what_all_have(spark, monkeypatch):
    """Pairs that stand twice need one item each where those that stand once are left out, so twice as many of them fit."""
    rng = random.Random(41)
    # Most pairs stand twice: texts of the training part with a copy, and some of their own.
    train = [i for i in range(200) if i % 7 != 0][:120]
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(25))) for i in train]
    rows = [(3 * i + k, text) for i, text in rows for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counted = bloom_lm.stored(docs.select(bloom_lm._fold("doc_id").alias("fold"), "text"), "rows")
    pairs = bloom_lm.stored(bloom_lm.pair_counts(counted), "pairs")
    seen = {t: pairs.where(f"c >= {t}").agg(F.count(F.lit(1)), F.sum(F.length(F.bin("c")))).first() for t in (1, 2)}
    fit = (seen[2][1] + seen[2][1] - seen[2][0]) // 2
    assert seen[2][1] - seen[2][0] < fit < seen[2][1]
    scores, store = [], bloom_lm.stored
    full = {r.doc_id: r for r in bloom_lm.score_documents(docs).collect()}
    monkeypatch.setattr(bloom_lm, "stored", lambda df, label: scores.append((label, store(df, label))) or scores[-1][1])
    got = bloom_lm.score_documents(docs, bits_per_item=(1 << 28) // fit).collect()
    last = [df for label, df in scores if label == "scores"][1]
    assert last.where(F.col("fold") != bloom_lm.HELD_OUT).agg(F.sum(F.size("open"))).first()[0] == 0
    assert len(got) == len(full)
    for r in got:
        assert r.base_score == pytest.approx(full[r.doc_id].base_score) and r.score == pytest.approx(full[r.doc_id].score, rel=1e-6)


def test_asked_rows_grow_with_the_input(spark, monkeypatch):
    """Five times the rows ask for about five times the words and pairs, also where all pairs of the smaller table had room in the filter."""
    rng = random.Random(53)
    rows = []
    for i in range(600):
        w = [rng.randrange(60)]
        for _ in range(40):
            w.append((7 * w[-1] + 1) % 60 if rng.random() < 0.6 else rng.randrange(300))
        rows.append((i, " ".join(f"w{x}" for x in w)))
    tables = [spark.createDataFrame(rows[:n], "doc_id long, text string").repartition(3) for n in (120, 600)]
    pairs = [bloom_lm.stored(bloom_lm.pair_counts(t.select(bloom_lm._fold("doc_id").alias("fold"), "text")), "pairs") for t in tables]
    need = [p.agg(F.sum(F.length(F.bin("c")))).first()[0] for p in pairs]
    fit = 2 * need[0]
    assert fit < need[1]
    store, build, scores, least = bloom_lm.stored, bloom_lm.build_filter, [], []
    monkeypatch.setattr(bloom_lm, "stored", lambda df, label: scores.append((label, store(df, label))) or scores[-1][1])
    monkeypatch.setattr(bloom_lm, "build_filter", lambda p, *args: least.append(p.agg(F.min("c")).first()[0]) or build(p, *args))
    asked = []
    for table, n in zip(tables, (120, 600), strict=True):
        scores.clear()
        weight, want = brute.pair_model(rows[:n], bloom_lm.WEIGHTS)
        got = bloom_lm.score_documents(table, bits_per_item=(1 << 28) // fit).collect()
        assert {r.weight for r in got} == {weight} and weight > 0
        assert {r.doc_id: r.score for r in got} == pytest.approx(want, abs=1e-6)
        asked.append(sum(df.agg(F.sum(F.size("open"))).first()[0] for label, df in scores if label == "scores"))
    assert least == [2] * 4
    assert 0 < asked[1] < 6 * asked[0]


def test_pair_alone_is_scored_as_absent():
    """A held-out token of which only the pair is unknown has its score without the pair at once; what is found is added by the join."""
    import numpy as np

    tokens = bloom_lm._tokens(b"a b")
    words, total = np.sort(tokens), 10.0
    table = np.zeros(bloom_lm.SLICES * bloom_lm.BLOCK_BITS // 8, np.uint8)
    shared = (words, np.array([3, 3, 3]), bloom_lm._groups(words), table)
    size, known, base, model, rest = bloom_lm._score_chunk(tokens, np.array([3]), np.array([False]), *shared, 2, 2, total, [0.3])
    assert (size[0].as_py(), known[0].as_py(), len(rest[0])) == (3, 3, 3)
    assert base[0].as_py() == pytest.approx(3 * np.log10(0.4)) and model[0].as_py() == pytest.approx([3 * np.log10(0.7 * 0.4)])
    assert all((o["t"], o["h"], o["p"]) == (None, None, 0) and o["x"] is not None for o in rest[0].as_py())


def test_tokens_of_many_texts(monkeypatch):
    """Texts worked on together have the tokens each has alone, wherever the slices end."""
    rng = random.Random(42)
    texts = [b"", b"  ", *(b" ".join(rng.choice([b"A", b"bc", "\u00e9".encode(), b"\tLong" * 9]) for _ in range(rng.randrange(30))) for _ in range(60)), b"", b"x" * 700, b""]
    for size in (40, 300, 1 << 20):
        monkeypatch.setattr(bloom_lm.grams, "SLICE", size)
        parts = list(bloom_lm._together(texts))
        assert np.concatenate([n for _, n in parts]).tolist() == [bloom_lm._tokens(t).size for t in texts]
        assert (np.concatenate([x for x, _ in parts]) == np.concatenate([bloom_lm._tokens(t) for t in texts])).all()


def test_counts_of_words():
    """Every word is found among others of its group, words that are none have count 0."""
    few = np.sort(np.array([5, 6, 7, bloom_lm.END, (1 << 63) + 1, (1 << 64) - 1], np.uint64))
    asked = np.array([7, 8, (1 << 64) - 1, 0, 5, bloom_lm.END, (1 << 63) + 1, 1 << 63], np.uint64)
    assert bloom_lm._count_of(asked, few, np.arange(1, 7), bloom_lm._groups(few)).tolist() == [3, 0, 6, 0, 1, 4, 5, 0]
    assert bloom_lm._count_of(asked, few[:0], few[:0].view(np.int64), bloom_lm._groups(few[:0])).tolist() == [0] * 8


def test_filter_counts():
    import numpy as np

    items = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    table = np.zeros(bloom_lm.SLICES * bloom_lm.BLOCK_BITS // 8, np.uint8)
    assert (bloom_lm.lookup(table, items) == 0).all()


def test_filter_round_trip(spark):
    import numpy as np

    counts = [(int(h) >> 52, int(np.uint64(h).view(np.int64)), 1 + i % 300) for i, h in enumerate(np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    pairs = spark.createDataFrame(counts, "slice long, item long, c long")
    table = bloom_lm.build_filter(pairs, bloom_lm.SLICES * bloom_lm.BLOCK_BITS)
    found = bloom_lm.lookup(table, np.array([c[1] for c in counts]).view(np.uint64))
    want = [1 << (c[2].bit_length() - 1) for c in counts]
    assert (found >= want).all() and (found != want).mean() < 0.02


def test_languages(spark, docs):
    english, german = "the cat and the dog of that house went there", "der hund und die katze gehen nicht nach hause"
    rows = [(i, (english if i % 2 else german) + f" {i}", "en" if i % 2 else "de", "h" if i % 2 else "g", 0) for i in range(60)]
    rows += [(100, english, None, None, 0), (101, german, "en", "g", 0), (102, None, "de", "g", 0), (103, "123 !!", "de", "g", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = language_id.identify(language_id.from_documents(table, F.col("doc_id")), *language_id.fit_text_model(table))
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == 64
    assert all(got[i].lang == ("en" if i % 2 else "de") and got[i].kept for i in range(60))
    assert got[100].lang == "en" and got[101].lang == "de"
    assert [(got[i].lang, got[i].kept) for i in (102, 103)] == [("und", False)] * 2
    assert language_id.identify(language_id.from_documents(docs, F.col("doc_id")), *language_id.fit_text_model(docs)).count() == docs.count()


def test_pages(spark):
    html = '<!DOCTYPE html><html lang="de-AT"><head><title>no</title></head><body><nav>the and</nav><article>der &amp; <b>hund</b></article></body></html>'
    rows = [(1, "https://www.Example.at:80/x", html), (2, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, two = language_id.from_pages(pages, F.col("page_id")).orderBy("page_id").collect()
    assert (one.declared, one.host, one.domain, one.suffix, one.text.split()) == ("de", "www.example.at", "example.at", "at", ["der", "hund"])
    assert two.text is None


def test_packing(docs, texts):
    found = packing.pack(docs, lengths=(64, 256, 1024), shard_pieces=8).collect()
    sizes = sorted(len((t or "").encode().split()) + bool((t or "").encode().split()) for _, t in texts)
    by_row: dict = {}
    bins: dict = {}
    for r in found:
        if r.bin_id is None:
            assert r.length == 0
        else:
            bins.setdefault(r.bin_id, []).append(r)
    assert sum(r.length for r in found) == sum(sizes)
    for rows in bins.values():
        rows.sort(key=lambda r: r["at"])
        assert [r["at"] for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        filled, size = sum(r.length for r in rows), rows[0].capacity
        assert size == min(c for c in (64, 256, 1024) if c >= filled)
    for r in found:
        by_row.setdefault(r.id, []).append(r)
    long = sorted((r for r in by_row[31]), key=lambda r: r.piece)
    assert [r.start for r in long] == [1024 * i for i in range(len(long))] and sum(r.length for r in long) == 30001


def test_packing_is_no_dearer_than_one_size():
    import random

    rng = random.Random(1)
    sizes = sorted((rng.randrange(1, 1024) for _ in range(500)), reverse=True)
    _, final = packing.pack_shard(sizes, (128, 512, 1024))
    single = packing.best_fit(sizes, (1024,), 1.0)
    assert sum(map(packing.cost, final)) <= packing.cost(1024) * (max(single) + 1)


def test_samples(docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=lattice_sampling.MODEL)
    found: dict = {}
    for r in lattice_sampling.sample_segmentations(docs, k=3).collect():
        found.setdefault(r.id, []).append(r)
    assert set(found) == {i for i, _ in texts}
    for i, text in texts:
        if i not in (None, 36):
            rows = sorted((r for r in found[i] if model.decode(r.ids) == (text or "")), key=lambda r: r["sample"])
            assert len(rows) == len(found[i])
            assert all(a.perturbed >= b.perturbed for a, b in zip(rows, rows[1:], strict=False) if a["sample"] < b["sample"])
    assert len({tuple(r.ids) for r in found[1]}) == 3 and [list(r.ids) for r in found[9]] == [[]]


def test_sample_frequencies():
    """Over many seeds, samples occur as often as drawing without replacement gives."""
    from collections import Counter
    from math import exp

    vocabulary = lattice_sampling.load_vocabulary()
    n = 8000
    first, any_of, share = Counter(), Counter(), {}
    for samples in lattice_sampling.sample_batch(["the cat"] * n, list(range(n)), vocabulary, 2):
        first[tuple(samples[0][0].tolist())] += 1
        for ids, score, *_ in samples:
            any_of[tuple(ids.tolist())] += 1
            share[tuple(ids.tolist())] = exp(score)
    for key, p in share.items():
        assert first[key] / n == pytest.approx(p, abs=0.02)
        later = sum(q * p / (1 - q) for other, q in share.items() if other != key)
        assert any_of[key] / n == pytest.approx(p + later, abs=0.02)


def test_lattice_has_every_piece():
    """The edges of a lattice are the pieces of the vocabulary that stand in the units, also where many share the first bits of their key."""
    vocabulary = lattice_sampling.load_vocabulary()
    rng = random.Random(51)
    text = " ".join("".join(rng.choice("thecationsrund\u00e9\u6f22") for _ in range(rng.randrange(1, 30))) for _ in range(200)) + " the nation's understanding"
    points, starts, ends, _ = lattice_sampling.units_of([text, "a", ""])
    want = set()
    known = {length: {x: i for i, x in zip(ids.tolist(), keys.tolist(), strict=True)} for length, (keys, ids, *_) in vocabulary["pieces"].items()}
    for n, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for length, pieces in known.items():
            for at in range(lo, hi - length + 1):
                part = points[at : at + length]
                key = lattice_sampling._keys(lattice_sampling.grams.prefix(part), lattice_sampling._turned(length), length)[0]
                if int(key) in pieces:
                    want.add((n, at - lo, length, pieces[int(key)]))
    assert len({w[2] for w in want}) > 5
    lattice = lattice_sampling.Lattice(points, starts, ends, vocabulary)
    node = np.repeat(np.arange(lattice.first.size - 1), np.diff(lattice.first))
    unit = np.searchsorted(lattice.start, node, side="right") - 1
    singles = {w[:2] for w in want if w[2] == 1}
    got = set(zip(unit.tolist(), (node - lattice.start[unit]).tolist(), (lattice.to - node).tolist(), lattice.ids.tolist(), strict=True))
    assert {g for g in got if g[2] > 1 or g[:2] in singles} == want
    keys = np.array([1, 2, 3, 1 << 63, (1 << 63) + 9], np.uint64)
    first = lattice_sampling._first_of(keys)
    assert first[0] == 1 and first[1 << (lattice_sampling.KEY_BITS - 1)] == 4 and np.count_nonzero(first) == 2


def test_lattices_are_kept(monkeypatch):
    """A unit that an earlier batch had is not built again; samples are the same with and without, and after forgetting."""
    vocabulary = lattice_sampling.load_vocabulary()
    rng = random.Random(61)
    word = lambda: "".join(rng.choice("thecationsr\u00e9\u6f22\U0001f600") for _ in range(rng.randrange(1, 12)))
    frequent = [word() for _ in range(80)]
    batches = [[" ".join(rng.choice(frequent) if rng.random() < 0.8 else word() for _ in range(120)) for _ in range(6)] + [""] for _ in range(4)]
    alone = [lattice_sampling.sample_batch(b, list(range(len(b))), vocabulary, 3) for b in batches]
    build, built = lattice_sampling.Lattice, []

    def counted(points, starts, ends, *rest):
        built.extend(points[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        return build(points, starts, ends, *rest)

    monkeypatch.setattr(lattice_sampling, "Lattice", counted)
    for kept, again in ((10**7, False), (0, True)):
        built.clear()
        known = lattice_sampling.Known(vocabulary, kept)
        for b, want in zip(batches, alone, strict=True):
            found = lattice_sampling.sample_batch(b, list(range(len(b))), vocabulary, 3, known)
            for x, y in zip(found, want, strict=True):
                assert [ids.tolist() for ids, *_ in x] == [ids.tolist() for ids, *_ in y]
                assert [n for _, *numbers in x for n in numbers] == pytest.approx([n for _, *numbers in y for n in numbers])
        assert (len(built) > len(set(built))) == again


def test_alternatives_at_any_width():
    """How many choices are looked at first does not change the best nodes beside a path."""
    vocabulary = lattice_sampling.load_vocabulary()
    rng = random.Random(62)
    texts = [" ".join(rng.choice(["the", "nation", "understanding", "of", "cats", "xqzt"]) for _ in range(n)) for n in (1, 5, 90, 400)] + [""]
    points, starts, ends, owner = lattice_sampling.units_of(texts)
    lattice = lattice_sampling.Known(vocabulary)
    kind = lattice.kinds(points, starts, ends)
    search = lattice_sampling._Search(np.arange(len(texts)), owner)
    paths = lattice_sampling._Paths(lattice, kind, owner, search.seed[owner] + np.arange(owner.size).astype(np.uint64), 0, None)
    all_at_once = lattice_sampling._alternatives(lattice, paths, kind, search, 0, 3, 10**6)
    assert [len(all_at_once.get(i, ())) for i in range(5)] == [3, 3, 3, 3, 0]
    for width in (1, 7, 128):
        found = lattice_sampling._alternatives(lattice, paths, kind, search, 0, 3, width)
        for i in range(5):
            assert [node[1:4] for node in found.get(i, ())] == [node[1:4] for node in all_at_once.get(i, ())]
            assert [node[0] for node in found.get(i, ())] == pytest.approx([node[0] for node in all_at_once.get(i, ())])


def test_sums_of_far_logarithms():
    """Stretches whose logarithms are far below the largest of all have their own sums."""
    rng = random.Random(63)
    logs = np.array([-rng.random() * 9 - (2000 if i % 30 < 10 else 0) for i in range(300)])
    head = np.arange(0, 300, 10)
    assert lattice_sampling._log_sums(logs, head) == pytest.approx(np.logaddexp.reduceat(logs, head), rel=1e-13)


def test_long_units():
    """A unit of any length is one lattice: pieces stand across every place, and the probabilities are those of the whole unit."""
    import sentencepiece

    vocabulary = lattice_sampling.load_vocabulary()
    model = sentencepiece.SentencePieceProcessor(model_file=lattice_sampling.MODEL)
    logs = {}
    for _, ids, scores, _ in vocabulary["pieces"].values():
        logs.update({model.id_to_piece(i): (i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)})
    text = "thecatison" * 30
    marked = chr(lattice_sampling.BLANK) + text
    ways = [0.0]
    for end in range(1, len(marked) + 1):
        ends = [ways[a] + logs[marked[a:end]][1] for a in range(max(0, end - 16), end) if marked[a:end] in logs]
        ways.append(float(np.logaddexp.reduce(ends)))
    crossed = 0
    others = ["a cat", "", "thecatison" * 9]
    for found in lattice_sampling.sample_batch([text, *others] * 20, list(range(80)), vocabulary, 3)[::4]:
        assert len({tuple(ids.tolist()) for ids, *_ in found}) == 3
        for ids, score, *_ in found:
            pieces = [model.id_to_piece(i) for i in ids.tolist()]
            assert "".join(pieces) == marked
            assert score == pytest.approx(sum(logs[p][1] for p in pieces) - ways[-1])
            crossed += 64 not in np.cumsum([len(p) for p in pieces])
    assert crossed > 0


def test_sample_pairs_inside_a_unit():
    """Samples without replacement of one unit: which two are drawn is as likely as drawing one after the other makes it."""
    from collections import Counter
    from math import exp

    vocabulary = lattice_sampling.load_vocabulary()
    n, pairs, share = 20000, Counter(), {}
    for samples in lattice_sampling.sample_batch(["thecat"] * n, list(range(n)), vocabulary, 2):
        pairs[tuple(tuple(ids.tolist()) for ids, *_ in samples)] += 1
        share.update({tuple(ids.tolist()): exp(score) for ids, score, *_ in samples})
    for (a, b), seen in pairs.most_common(12):
        assert seen / n == pytest.approx(share[a] * share[b] / (1 - share[a]), abs=0.012)


@pytest.mark.parametrize(
    "apply",
    [
        phrase_dedup.remove_recurring,
        suffix_dedup.remove_repeats,
        minmax_dedup.near_duplicates,
        fingerprints.edited_fingerprints,
        license_scan.labelled,
        bloom_lm.score_documents,
        packing.pack,
        lattice_sampling.sample_segmentations,
        lambda d: language_id.identify(language_id.from_documents(d, F.col("doc_id")), *language_id.fit_text_model(d)),
    ],
)
def test_empty_table(none, apply):
    assert apply(none).count() == 0


def test_near_copies_of_an_original(spark, same):
    """Many edited copies of one text, most of them too far from each other, and unlike texts that share most of their words' pairs."""
    rng = random.Random(21)
    base = [f"n{rng.randrange(900)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = base.copy()
        for k in rng.sample(range(200), rng.randrange(1, 16)):
            copy[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, " ".join(base[: 120 + i] + [f"z{rng.randrange(10**6)}" for _ in range(60)])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = minmax_dedup.near_duplicates(docs, size=2)
    got = found.select("id", "n_shingles", "component_id", "kept").collect()
    same(got, brute.near(rows, 2))


def test_what_is_ruled_out(spark):
    """The tests by sketch and by parity keep every similar pair and drop the unlike ones."""
    rng = random.Random(22)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        other = words.copy()
        for k in rng.sample(range(300), 12 if i % 2 else 120):
            other[k] = "x" + other[k]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = minmax_dedup.document_sets(minmax_dedup.keyed(docs, "doc_id", "text"), 2)
    a = sets.where("k1 % 2 = 0").select((F.col("k1") + 1).alias("pair"), *[F.col(c).alias(f"a_{c}") for c in ("n", "parity", *minmax_dedup.SKETCH)])
    met = sets.withColumnsRenamed({c: f"b_{c}" for c in ("n", "parity", *minmax_dedup.SKETCH)}).join(a, F.col("k1") == F.col("pair"))
    told = met.select("k1", minmax_dedup._alike("a_", "b_", 80).alias("sketch"), minmax_dedup._close("a_", "b_", 80).alias("parity")).collect()
    assert len(told) == 60
    assert all(r.sketch and r.parity for r in told if (r.k1 // 2) % 2) and not any(r.parity for r in told if not (r.k1 // 2) % 2)


def test_rare_languages_and_tags(spark):
    """A language with few rows beside a hundred times as many others is known; tags count by their primary part."""
    rng = random.Random(2)
    english = [" ".join(rng.choice("the of and house river light water people under morning".split()) for _ in range(40)) for _ in range(3000)]
    swedish = [" ".join(rng.choice("och att det är inte från människor vatten ljus på morgonen".split()) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "en-US", "EN_gb"]), "a") for i, t in enumerate(english)] + [(9000 + i, t, "sv", "a") for i, t in enumerate(swedish)]
    table = spark.createDataFrame([*rows, (1, "x", "not a tag", "a")], "doc_id long, text string, lang string, source string")
    languages, model = language_id.fit_text_model(table)
    assert languages == ["en", "sv"]
    found = language_id.identify(language_id.from_documents(table, F.col("doc_id")), languages, model)
    assert {r.lang for r in found.where("doc_id >= 9000").collect()} == {"sv"}
    assert found.where("doc_id < 3000 AND doc_id <> 1 AND lang = 'en' AND kept").count() == 2999


def test_all_articles_of_a_page(spark):
    html = '<html lang="sv-SE"><body><article>one</article><nav>menu</nav><article>two <b>three</b></article></body></html>'
    pages = spark.createDataFrame([(1, "https://www.example.se/a", html)], "page_id long, url string, html string")
    row = language_id.from_pages(pages, F.col("page_id")).first()
    assert row.text.split() == ["one", "two", "three"] and row.declared == "sv"
