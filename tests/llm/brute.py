"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import hashlib


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def phrases(docs: list[tuple], window: int = 35) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256) from (doc_id, text) rows; rows equal in both are one document."""
    places: dict = {}
    split = {}
    for key in set(docs):
        words = split[key] = (key[1] or "").encode().split()
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((key, i))
    drop = {key: set() for key in split}
    for at in places.values():
        if len(at) > 1:
            for key, i in at:
                drop[key].update(range(i, i + window))
    out = []
    for key in docs:
        kept = [w for i, w in enumerate(split[key]) if i not in drop[key]]
        out.append((key[0], len(split[key]), len(drop[key]), sha(b" ".join(kept))))
    return out


def substrings(docs: list[tuple], window: int = 100) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) from (doc_id, text) rows."""
    seen: set = set()
    drop = {}
    for key in sorted(set(docs), key=lambda k: (k[0] is not None, k[0] or 0)):
        data = (key[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            piece = data[i : i + window]
            if piece in seen:
                gone[i : i + window] = b"\x01" * window
            seen.add(piece)
        drop[key] = gone
    out = []
    for key in docs:
        data, gone = (key[1] or "").encode(), drop[key]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key[0], len(data), sum(gone), spans, sha(kept)))
    return out


def _roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs: list[tuple], size: int = 2, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) from (doc_id, text) rows with distinct ids."""
    sets = {}
    for doc_id, text in docs:
        words = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    ids = sorted(sets)
    edges = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    edges.append((a, b))
    roots = _roots(ids, edges)
    return [(i, len(sets[i]), roots[i], roots[i] == i) for i in ids]


def vectors(rows: list[tuple], least: float = 0.93) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) from (vec_id, embedding, label) rows with distinct ids."""
    import math

    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, v, math.sqrt(math.fsum(x * x for x in v)), label) for i, v, label in rows if usable(v, label)]
    links: dict = {r[0]: 0 for r in rows}
    edges = []
    for k, (i, v, a, label) in enumerate(good):
        for j, w, b, other in good[k + 1 :]:
            if label == other and len(v) == len(w) and sum(x * y for x, y in zip(v, w, strict=True)) / (a * b) >= least:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    roots = _roots(links, edges)
    return sorted((i, links[i], roots[i], roots[i] == i) for i in links)


def word_model(docs: list[tuple]) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) from (doc_id, text) rows."""
    import math
    import zlib
    from collections import Counter

    split = [(i, zlib.crc32(str(i).encode()) % 7 == 2, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    counts = Counter(w for _, held, words in split if not held for w in words)
    total = sum(counts.values())
    bottom = math.log10(total + len(counts) + 1)
    return [
        (i, held, len(words), sum(w in counts for w in words), total, round(sum(math.log10(counts[w] + 1) - bottom for w in words), 6))
        for i, held, words in split
    ]


def pair_model(docs: list[tuple], weights: list[float]) -> tuple[float, dict]:
    """The weight fitted on fold 3 and the score per doc_id, from (doc_id, text) rows with distinct ids."""
    import math
    import zlib
    from collections import Counter

    fold = {i: zlib.crc32(str(i).encode()) % 7 for i, _ in docs}
    split = {i: [None, *(t or "").encode().lower().split(), None] for i, t in docs}

    def scores(learnt: list, scored: list, w: float) -> dict:
        words = Counter(x for i in learnt for x in split[i][1:])
        pairs = Counter(x for i in learnt for x in zip(split[i], split[i][1:]))
        total = sum(words.values()) + len(words) + 1
        out = {}
        for i in scored:
            out[i] = 0.0
            for a, b in zip(split[i], split[i][1:]):
                c, plain = pairs[a, b], (words[b] + 1) / total
                share = min(1 << (c.bit_length() - 1), words[a]) / words[a] if c else 0.0
                out[i] += math.log10(w * share + (1 - w) * plain if words[a] else plain)
        return out

    tuning = [i for i in split if fold[i] == 3]
    rest = [i for i in split if fold[i] not in (2, 3)]
    best = max(weights, key=lambda w: sum(scores(rest, tuning, w).values()))
    return best, scores([i for i in split if fold[i] != 2], list(split), best)


def pieces(text: str, size: int = 128) -> set[str]:
    return {line[i : i + size] for line in text.split("\n") for i in range(0, len(line), size)}


def edits(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256, near_edited, near_next) from (doc_id, text) rows with distinct ids."""

    def near(x: str, y: str) -> float:
        a, b = pieces(x), pieces(y)
        return round(len(a & b) / len(a | b), 9) if a | b else 1.0

    rows = sorted((i, t or "") for i, t in docs)
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        out.append((i, len(text), sha(edited.encode()), near(text, edited), near(text, following)))
    return out


def licenses(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) from (doc_id, text) rows."""
    import re

    from adloom.llm import license_rules

    rules = [(r, re.compile(r.regex)) for r in license_rules.rules()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        base = [
            (label, i)
            for label, phrase in license_rules.BASE.items()
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        spaced = "".join(f" {w} " for w in words)
        found = [
            (spaced[: m.start()].count(" ") // 2, spaced[: m.end()].count(" ") // 2, r) for r, x in rules for m in x.finditer(spaced)
        ]
        kept = [
            r
            for lo, hi, r in found
            if not any(
                a <= lo and hi <= b and q.tier <= r.tier and ((a, b) != (lo, hi) or q.order < r.order) for a, b, q in found
            )
        ]
        starts = [i for _, i in base]
        labels = sorted({label for label, _ in base})
        every = sorted({*labels, *(r.label for r in kept)})
        score = max([r.weight for r in kept] + [0.9] * bool(base), default=0.0)
        span = (min(starts), max(starts)) if starts else (None, None)
        out.append((doc_id, len(words), len(base), *span, ",".join(labels), ",".join(every), score))
    return out


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def runs(w: list[str], shortest: int = 24, exponent: int = 3) -> list[tuple]:
    """(start, length, period) of every run, from comparing each word with the one a period later, for every period."""
    import numpy as np

    number: dict[str, int] = {}
    x = np.array([number.setdefault(v, len(number)) for v in w], np.int64)
    found: dict[tuple, int] = {}
    for q in range(1, len(w) // exponent + 1):
        step = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(np.int8), [0])))
        for i, j in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if j + q - i >= max(shortest, exponent * q):
                found.setdefault((i, j + q - i), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(w: list[str], found: list[tuple]) -> str:
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(doc_id: int | None, text: str | None) -> tuple:
    """The row of the periodic query."""
    import zlib
    from fractions import Fraction

    w = words(text)
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    milli = best[1] * 1000 // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha(lines.encode()), sha(collapse(w, found).encode()))


def shards(rows: list[tuple], n: int) -> list[tuple]:
    """(doc_id, text, size, crc32, shard, slot): rows in the order of their digests, cut at the row nearest to equal bytes."""
    import hashlib
    import zlib

    def digest(*values) -> int:
        return int(hashlib.md5("\n".join("-" if v is None else f"={v}" for v in values).encode()).hexdigest()[:15], 16)

    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (digest(r[1]), digest(*r)))
    below = [0]
    for _, t in ordered:
        below.append(below[-1] + len(t.encode()) + 1)
    cuts = [min(range(len(below)), key=lambda k: (abs(below[k] - i * below[-1] / n), k)) for i in range(1, n)]
    out = []
    for at, (i, t) in enumerate(ordered):
        before = [c for c in cuts if c <= at]
        out.append((i, t, len(t.encode()) + 1, zlib.crc32(t.encode()), len(before), at - max(before, default=0)))
    return out


def conversations(rows: list[tuple]) -> dict[int, list[tuple]]:
    """Turns (role, text) of each conversation in order, from (conv_id, turn, role, text) rows."""
    import hashlib

    def digest(role: str, text: str) -> str:
        return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()

    out: dict[int, list[tuple]] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role, text))
    return {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(all_turns: dict[int, list[tuple]]) -> dict[int, list[tuple]]:
    import zlib

    out = {}
    for c, own in all_turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = all_turns.get(base, [])[:h] + own[h:]
    return out


def trie(all_turns: dict[int, list[tuple]]) -> list[tuple]:
    """One row per node, from all prefixes of all conversations."""
    inside: dict[tuple, list[int]] = {}
    for c, turns in all_turns.items():
        for d in range(len(turns) + 1):
            inside.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for node in inside:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    leaves, saved = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0)
    for node, cs in inside.items():
        gain = (len(cs) - 1) * len(words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += gain
    out = []
    for node, cs in inside.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(all_turns[c]) == len(node))
        parent = min(inside[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), children.get(node, 0), leaves[node], saved[node], sha(ends.encode())))
    return out
