"""Distinct sampled segmentations of texts by perturbed search over the lattice of pieces.

Every path through the lattice (every segmentation) gets its log-probability plus independent Gumbel noise; the k paths
with the largest sums are k samples without replacement. They are found best first without listing paths: a node of the search
stands for all paths with a common beginning and carries the maximum of their sums. The best node is followed to its best
path by sampling one choice after the other; at each choice the alternatives become nodes of their own, with noise bounded
by that of their parent. What the best node left over would have reached is the threshold that inclusion scores need.

The vocabulary is that of a SentencePiece model; its merge ranks give the pieces Zipf probabilities. A text is cut into units
before every blank and around every line break; no piece crosses such a cut, so the lattice of a text is the chain of
its units' lattices. A task builds one lattice per distinct unit, whatever its length, and keeps them from batch to batch until they have more than
``KEPT`` edges. Random numbers depend on the row's key only. A batch of documents is worked out at once, up to ``BATCH`` characters; memory follows the longest document.

Defined cases: a null or empty text has one sample without pieces; texts with fewer than k segmentations give all of them;
characters outside the vocabulary become byte pieces; rows with equal id and text get equal samples; a null id is a key of its own; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adloom.llm import grams

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK, BREAK = 0x2581, 0x0A
ZIPF = 2.7
BYTE_LOG = -25.0
# Characters worked out at once, unless one document is longer.
BATCH = 1 << 19
KEY_BITS = 18
# Edges of lattices that a task keeps from one batch to the next; 24 bytes each.
KEPT = 4 << 20
_NEGLIGIBLE = 30.0  # a noise this large has a probability of 1e-13
SAMPLES = "id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"


def load_vocabulary(path: str = MODEL) -> dict:
    """Hashes, ids and log-probabilities of the pieces by length, which first bits begin longer ones, and the ids of the byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    by_length: dict[int, list] = {}
    bytes_at = {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_at[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)) and chr(BLANK) not in piece[1:]:
            by_length.setdefault(len(piece), []).append((i, -math.log(ZIPF - model.get_score(i))))
    total = math.log(sum(math.exp(s) for group in by_length.values() for _, s in group))
    tables, longer = {}, {length: np.zeros(1 << KEY_BITS, bool) for length in range(1, max(by_length))}
    for length, group in by_length.items():
        points = np.concatenate([_points(model.id_to_piece(i)) for i, _ in group])
        sums, turned = grams.prefix(points), _turned(points.size)
        for part in range(1, length):
            longer[part][_bits(_keys(sums, turned, part)[::length])] = True
        keys = _keys(sums, turned, length)[::length]
        order = np.argsort(keys)
        keys, ids, scores = keys[order], np.array([i for i, _ in group])[order], np.array([s for _, s in group])[order] - total
        tables[length] = keys, ids, scores, _first_of(keys)
    return {"pieces": tables, "longer": longer, "bytes": np.array([bytes_at[b] for b in range(256)])}


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _turned(n: int) -> np.ndarray:
    """Factors that make the hash of a span independent of its place, and spread it to the first bits."""
    return grams._Tables.get(n + 1)[1][:n] * np.uint64(0xD6E8FEB86659FD93)


def _keys(sums: np.ndarray, turned: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` code points from every place on; ``sums`` are the prefix sums of the code points."""
    return (sums[length:] - sums[:-length]) * turned[: max(turned.size - length + 1, 0)]


def _bits(keys: np.ndarray) -> np.ndarray:
    """The first bits of the keys."""
    return (keys >> np.uint64(64 - KEY_BITS)).view(np.int64)


def _first_of(keys: np.ndarray) -> np.ndarray:
    """Number from 1 of the first of the sorted ``keys`` with each value of the first bits, 0 where there is none."""
    first = np.zeros(1 << KEY_BITS, np.uint16 if keys.size < 1 << 16 else np.uint32)
    first[_bits(keys)[::-1]] = np.arange(keys.size, 0, -1)
    return first


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with blanks marked, start and end of every unit, and the text it belongs to."""
    marked = [chr(BLANK) + t.replace(" ", chr(BLANK)) if t else "" for t in texts]
    points = _points("".join(marked))
    size = np.array([len(t) for t in marked], np.int64)
    begin = np.cumsum(size) - size
    cut = (points == BLANK) | (points == BREAK)
    cut[1:] |= points[:-1] == BREAK
    cut[begin[size > 0]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], points.size)
    owner = np.searchsorted(begin + size, starts, side="right")
    return points, starts, ends, owner


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in one byte or two where they fit: those are sorted by counting."""
    most = x.max(initial=0)
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16) if most < 1 << 16 else x


def _log_sums(logs: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of what each stretch from one ``head`` to the next holds as logarithms."""
    if logs.size < 64:
        return np.logaddexp.reduceat(logs, head)
    top = logs.max()
    sums = np.add.reduceat(np.exp(logs - top), head)
    if sums.min() > 1e-280:
        return top + np.log(sums)
    # Some stretches are too far below the largest logarithm of all, so each is measured by its own.
    most = np.maximum.reduceat(logs, head)
    return most + np.log(np.add.reduceat(np.exp(logs - np.repeat(most, np.diff(head, append=logs.size))), head))


class Lattice:
    """Lattices of distinct units: nodes are positions, edges are pieces with their probability given the node."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: dict):
        size = ends - starts
        base = np.cumsum(size + 1) - size - 1  # node of the first position; one more node marks the end
        unit = np.repeat(np.arange(size.size), size)
        inner = np.arange(unit.size) - np.repeat(np.cumsum(size) - size, size)
        text = points[starts[unit] + inner]
        left = size[unit] - inner
        node = base[unit] + inner
        frm, to, ids, logs = [], [], [], []
        single = np.zeros(text.size, bool)
        sums = grams.prefix(text)
        # Places where a piece of the length may stand, what is left of their units, and what their keys need.
        room, turned, before = np.arange(text.size), _turned(text.size), sums[:-1]
        open_ = np.ones(text.size, bool)
        for length, (keys, piece, score, first) in sorted(vocabulary["pieces"].items()):
            fits = np.flatnonzero(open_ & (left >= length))
            if not fits.size:
                break
            if fits.size < room.size:
                room, left, turned, before = room[fits], left[fits], turned[fits], before[fits]
            h = (sums[room + length] - before) * turned
            bits = _bits(h)
            open_ = vocabulary["longer"].get(length, np.zeros(1 << KEY_BITS, bool))[bits]
            # Most substrings have the first bits of no piece.
            spot = first[bits]
            at = np.flatnonzero(spot)
            h, spot, at = h[at], spot[at].astype(np.int64) - 1, room[at]
            behind = np.flatnonzero(keys[spot] < h)
            while behind.size:
                spot[behind] += 1
                behind = behind[spot[behind] < keys.size]
                behind = behind[keys[spot[behind]] < h[behind]]
            spot = np.minimum(spot, keys.size - 1)
            held = keys[spot] == h
            at, spot = at[held], spot[held]
            if length == 1:
                single[at] = True
            frm.append(node[at])
            to.append(node[at] + length)
            ids.append(piece[spot])
            logs.append(score[spot])
        odd = np.flatnonzero(~single)
        width = 1 + (text[odd] > 0x7F).astype(int) + (text[odd] > 0x7FF) + (text[odd] > 0xFFFF)
        frm.append(node[odd])
        to.append(node[odd] + 1)
        ids.append(np.where(text[odd] < 0x80, vocabulary["bytes"][np.minimum(text[odd], 0x7F)], -text[odd].astype(np.int64)))
        logs.append(BYTE_LOG * width)
        nodes = int((size + 1).sum())
        # Each list is sorted by node, so the edges get their places by counting.
        self.first = np.zeros(nodes + 1, np.int64)
        for part in frm:
            self.first[part + 1] += 1
        np.cumsum(self.first, out=self.first)
        free, edges = self.first[:-1].copy(), int(self.first[-1])
        self.to, self.ids, score = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        for part in zip(frm, to, ids, logs, strict=True):
            slot = free[part[0]]
            free[part[0]] += 1
            self.to[slot], self.ids[slot], score[slot] = part[1:]
        frm, logs = np.repeat(np.arange(nodes), np.diff(self.first)), score
        self.start, self.end = base, base + size
        # log of the sum over all ways to the end, from the end backwards
        rest = np.zeros(nodes)
        gap = np.repeat(self.end, size + 1) - np.arange(nodes)
        distance = _small(gap)[frm]
        by = np.argsort(distance, kind="stable")
        cuts = np.searchsorted(distance[by], np.arange(1, int(gap.max(initial=0)) + 2))
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            edges = by[lo:hi]
            whence = frm[edges]
            head = np.flatnonzero(np.concatenate(([True], whence[1:] != whence[:-1])))
            rest[whence[head]] = _log_sums(logs[edges] + rest[self.to[edges]], head)
        self.log = logs + rest[self.to] - rest[frm]
        sums = np.cumsum(np.exp(self.log))
        before = np.concatenate(([0.0], sums))[self.first[frm]]
        self.upto = sums - before
        last = self.first[1:][self.first[1:] > self.first[:-1]] - 1
        self.upto[last] = np.inf


class Known:
    """The lattices of a task's units: one that a batch before had is not built again. Beyond ``kept`` edges all are forgotten."""

    def __init__(self, vocabulary: dict, kept: int = KEPT):
        self.vocabulary, self.kept = vocabulary, kept
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.units = self.nodes = self.edges = 0
        self.first = np.zeros(1, np.int64)
        self.to, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.log, self.upto = np.zeros(0), np.zeros(0)
        self.start, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def kinds(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of every unit's lattice, which is there from then on."""
        if self.edges > self.kept:
            self._forget()
        hashes, sample, kind = np.unique(grams.span_hashes(points, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, hashes)
        old = at < self.hashes.size
        old[old] = self.hashes[at[old]] == hashes[old]
        # By first appearance, so that frequent units stand together.
        new = np.flatnonzero(~old)
        new = new[np.argsort(sample[new])]
        number = np.empty(hashes.size, np.int64)
        number[old] = self.numbers[at[old]]
        number[new] = self.units + np.arange(new.size)
        self._add(Lattice(points, starts[sample[new]], ends[sample[new]], self.vocabulary))
        self.hashes, self.numbers = (np.insert(x, at[~old], y[~old]) for x, y in ((self.hashes, hashes), (self.numbers, number)))
        return number[kind]

    def _add(self, part: Lattice) -> None:
        for name, size, more in (
            ("first", self.nodes + 1, part.first[1:] + self.edges),
            *((name, self.units, getattr(part, name) + self.nodes) for name in ("start", "end")),
            ("to", self.edges, part.to + self.nodes),
            *((name, self.edges, getattr(part, name)) for name in ("ids", "log", "upto")),
        ):
            values = getattr(self, name)
            if values.size < size + more.size:
                values = np.empty(max(2 * values.size, size + more.size), values.dtype)
                values[:size] = getattr(self, name)[:size]
                setattr(self, name, values)
            values[size : size + more.size] = more
        self.units, self.nodes, self.edges = self.units + part.start.size, self.nodes + part.first.size - 1, self.edges + part.to.size


def _uniform(seed: np.ndarray, draw: int, depth: int) -> np.ndarray:
    """Numbers in [0, 1) from the seed of each unit, the round and the depth."""
    h = grams.mix(seed + np.uint64(draw * 0x9E3779B97F4A7C15 + depth * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Paths:
    """One path per text: its choices as (unit, node, edge), depth after depth, those of one depth by unit.

    ``cuts`` are the places where the depths begin; ``order`` sorts the choices by text and leaves a text's in this order.
    """

    def __init__(self, lattice: Known, kind: np.ndarray, owner: np.ndarray, seed: np.ndarray, draw: int, fixed: dict | None):
        most = int((lattice.end[kind] - lattice.start[kind]).sum())
        self.unit, self.node, self.edge = (np.empty(most, np.int64) for _ in range(3))
        self.cuts = [0]
        unit = np.arange(kind.size)
        node, end = lattice.start[kind], lattice.end[kind]
        deepest = int(fixed["level"].max(initial=-1)) if fixed else -1
        depth = 0
        while unit.size:
            edge = lattice.first[node]
            u = _uniform(seed, draw, depth)
            open_ = np.flatnonzero(u >= lattice.upto[edge])
            while open_.size:
                edge[open_] += 1
                open_ = open_[u[open_] >= lattice.upto[edge[open_]]]
            if depth <= deepest:
                level, at, by_text = fixed["level"], fixed["unit"], owner[unit]
                kept = np.flatnonzero((depth < level[by_text]) | ((depth == level[by_text]) & (unit < at[by_text])))
                if kept.size:
                    edge[kept] = fixed["old"](depth, unit[kept])
                swapped = (depth == level[by_text]) & (unit == at[by_text])
                edge[swapped] = fixed["edge"][by_text[swapped]]
            lo, hi = self.cuts[-1], self.cuts[-1] + unit.size
            self.unit[lo:hi], self.node[lo:hi], self.edge[lo:hi] = unit, node, edge
            self.cuts.append(hi)
            node = lattice.to[edge]
            more = np.flatnonzero(node < end)
            unit, node, end, seed = unit[more], node[more], end[more], seed[more]
            depth += 1
        self.unit, self.node, self.edge = (x[: self.cuts[-1]].copy() for x in (self.unit, self.node, self.edge))
        self.depth = np.repeat(np.arange(depth), np.diff(self.cuts))
        self.log = lattice.log[self.edge]
        self.text = owner[self.unit]
        self.order = np.argsort(_small(self.text), kind="stable")
        self.begin = np.searchsorted(self.text[self.order], np.arange(int(owner.max(initial=-1)) + 2))


class _Search:
    """State of the search of all texts of a batch: the last fixed choice, its log-probability and perturbed value."""

    def __init__(self, seeds: np.ndarray, owner: np.ndarray):
        self.n = seeds.size
        self.seed = grams.mix(seeds.view(np.uint64).copy())
        self.best = -np.log(-np.log1p(-_uniform(self.seed, 999, 0)) + 1e-300)
        self.depth, self.unit = np.zeros(self.n, np.int64), np.full(self.n, -1)
        self.known, self.alive = np.zeros(self.n), np.ones(self.n, bool)
        self.first_unit = np.searchsorted(owner, np.arange(self.n))


def _alternatives(lattice: Known, paths: _Paths, kind: np.ndarray, search: _Search, draw: int, keep: int, width: int) -> dict[int, list]:
    """The best ``keep`` nodes beside the path of every text: (perturbed, depth, unit, edge, log-probability with the edge).

    Nodes far down a path have lost so much probability that their noise cannot make up for it, so the first ``width`` choices
    that are free are looked at, and more only for texts where that does not settle the best ones: as far as the best ones'
    values are within reach.
    """
    n = search.n
    # Free are the choices after the last fixed one; no fixed one is deeper than the deepest of these.
    early = slice(paths.cuts[min(int(search.depth.max(initial=0)) + 1, len(paths.cuts) - 1)])
    by, depth = paths.text[early], paths.depth[early]
    fixed = (depth < search.depth[by]) | ((depth == search.depth[by]) & (paths.unit[early] <= search.unit[by]))
    begin = np.concatenate((paths.begin, np.full(n + 1 - paths.begin.size, paths.text.size)))
    lo, hi = begin[:-1] + np.bincount(by[fixed], minlength=n), begin[1:]
    spent = np.concatenate(([0.0], np.cumsum(paths.log[paths.order])))
    known = search.known - spent[lo]
    size = np.where(search.alive, np.minimum(hi - lo, width), 0)
    found = _beside(lattice, paths, kind, search, draw, keep, lo, size, known + spent[lo], np.full(n, -np.inf))
    least = np.full(n, -np.inf)
    for i, nodes in found.items():
        if len(nodes) == keep:
            least[i] = nodes[-1][0] - _NEGLIGIBLE
    lo = lo + size
    unsure = search.alive & (lo < hi) & (known + spent[np.minimum(lo, hi)] > least)
    if unsure.any():
        size = np.where(unsure, hi - lo, 0)
        reach = np.repeat(np.arange(n), size)
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(reach.size)
        size = np.bincount(reach[spent[at] + known[reach] > least[reach]], minlength=n)
        for i, nodes in _beside(lattice, paths, kind, search, draw, keep, lo, size, known + spent[lo], least).items():
            found[i] = sorted(found.get(i, []) + nodes, key=lambda node: -node[0])[:keep]
    return found


def _beside(lattice: Known, paths: _Paths, kind: np.ndarray, search: _Search, draw: int, keep: int, lo: np.ndarray, size: np.ndarray, known: np.ndarray, least: np.ndarray) -> dict[int, list]:
    """The best ``keep`` nodes beside ``size`` choices of every text's path from place ``lo`` on, of which log-probability is ``known``.

    Nodes with a log-probability below ``least`` are left out.
    """
    n = search.n
    text = np.repeat(np.arange(n), size)
    begin = np.cumsum(size) - size
    at = paths.order[np.repeat(lo - begin, size) + np.arange(text.size)]
    depth, unit, node, edge = (x[at] for x in (paths.depth, paths.unit, paths.node, paths.edge))
    spent = np.concatenate(([0.0], np.cumsum(paths.log[at])))
    before = spent[:-1] - spent[begin[text]] + known[text]

    first = lattice.first[node]
    degree = lattice.first[node + 1] - first
    choice = np.repeat(np.arange(text.size), degree)
    other = np.repeat(first - np.cumsum(degree) + degree, degree) + np.arange(choice.size)
    phi = before[choice] + lattice.log[other]
    beside = np.flatnonzero((other != edge[choice]) & (phi > least[text][choice]))
    choice, other, phi = choice[beside], other[beside], phi[beside]
    whose = text[choice]
    # The place of the edge: unit of the text, position in the unit, number among the edges there.
    place = grams.mix((unit - search.first_unit[text]).astype(np.uint64)) + ((node - lattice.start[kind[unit]]).astype(np.uint64) << np.uint64(12))
    spot = grams.mix(place[choice] + (other - first[choice]).astype(np.uint64))
    noise = -np.log1p(-_uniform(search.seed[whose] + spot, draw + 1000, 0) * (1 - 2.0**-53))
    noise = np.maximum(noise, 1e-300)
    value = phi - np.log(np.exp(np.minimum(phi - search.best[whose], 700.0)) + noise)
    near = value > search.best[whose] - 8
    near |= (np.bincount(whose[near], minlength=n) < keep)[whose]
    pick = np.flatnonzero(near)
    pick = pick[np.lexsort((-value[pick], whose[pick]))]
    rank = np.arange(pick.size) - np.searchsorted(whose[pick], whose[pick])
    pick = pick[rank < keep]
    found: dict[int, list] = {}
    for i, *item in zip(whose[pick].tolist(), value[pick].tolist(), depth[choice[pick]].tolist(), unit[choice[pick]].tolist(), other[pick].tolist(), phi[pick].tolist(), strict=True):
        found.setdefault(i, []).append(tuple(item))
    return found


def sample_batch(texts: list[str], seeds: list[int], vocabulary: dict, k: int, known: Known | None = None) -> list[list[tuple]]:
    """Per text its samples (ids, log_prob, perturbed, inclusion), best first; ``known`` has the lattices of batches before."""
    points, starts, ends, owner = units_of(texts)
    lattice = known or Known(vocabulary)
    kind = lattice.kinds(points, starts, ends)
    n = len(texts)
    search = _Search(np.array(seeds, np.int64), owner)
    seed = search.seed[owner] + grams.mix((np.arange(owner.size) - search.first_unit[owner]).astype(np.uint64))
    heaps: list[list] = [[] for _ in range(n)]
    rounds: list[_Paths] = []
    done: list[list] = [[] for _ in range(n)]
    fixed = None
    for draw in range(k):
        paths = _Paths(lattice, kind, owner, seed, draw, fixed)
        rounds.append(paths)
        score = np.bincount(paths.text, paths.log, n)
        ids = _ids(lattice, paths, owner, n, vocabulary)
        beside = _alternatives(lattice, paths, kind, search, draw, k + 1 - draw, 128)
        level, at, swap, source = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in np.flatnonzero(search.alive).tolist():
            done[i].append((ids[i], float(score[i]), float(search.best[i])))
            for node in beside.get(i, ()):
                heapq.heappush(heaps[i], (-node[0], *node[1:], draw))
            if not heaps[i]:
                search.alive[i] = False
            elif draw + 1 < k:
                value, depth, unit, edge, phi, parent = heapq.heappop(heaps[i])
                search.best[i], search.depth[i], search.unit[i], search.known[i] = -value, depth, unit, phi
                level[i], at[i], swap[i], source[i] = depth, unit, edge, parent
        if draw + 1 < k:
            fixed = {"level": level, "unit": at, "edge": swap, "old": _recall(rounds, source, owner)}
    out = []
    for i in range(n):
        limit = -heaps[i][0][0] if heaps[i] else -math.inf
        out.append([(ids, score, top, -math.expm1(-math.exp(min(score - limit, 700.0)))) for ids, score, top in done[i]])
    return out


def _recall(rounds: list[_Paths], source: np.ndarray, owner: np.ndarray):
    """Edges that the units' texts chose in the rounds they descend from; those rounds had the choice."""

    def old(depth: int, unit: np.ndarray) -> np.ndarray:
        edge = np.zeros(unit.size, np.int64)
        whence = source[owner[unit]]
        for number, paths in enumerate(rounds):
            wanted = np.flatnonzero(whence == number)
            if wanted.size:
                lo, hi = paths.cuts[depth], paths.cuts[depth + 1]
                edge[wanted] = paths.edge[lo + np.searchsorted(paths.unit[lo:hi], unit[wanted])]
        return edge

    return old


def _ids(lattice: Known, paths: _Paths, owner: np.ndarray, n: int, vocabulary: dict) -> list[np.ndarray]:
    length = np.bincount(paths.unit, minlength=owner.size)
    slot = (np.cumsum(length) - length)[paths.unit] + paths.depth
    unit, ids = np.repeat(np.arange(owner.size), length), np.empty(slot.size, np.int64)
    ids[slot] = lattice.ids[paths.edge]
    odd = np.flatnonzero(ids < 0)
    if odd.size:
        raw = [chr(-x).encode("utf-8", "surrogatepass") for x in ids[odd].tolist()]
        times = np.ones(ids.size, np.int64)
        times[odd] = [len(b) for b in raw]
        place = (np.cumsum(times) - times)[odd]
        unit, ids = np.repeat(unit, times), np.repeat(ids, times)
        for lo, b in zip(place.tolist(), raw, strict=True):
            ids[lo : lo + len(b)] = vocabulary["bytes"][list(b)]
    return np.split(ids.astype(np.int32), np.searchsorted(owner[unit], np.arange(1, n)))


def sample_segmentations(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, model: str = MODEL
) -> DataFrame:
    """Up to ``k`` rows (id, sample, ids, log_prob, perturbed, inclusion) per document, best perturbed score first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("seed"), text.alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def emit(ids: list, texts: list, seeds: list, known: Known) -> pa.RecordBatch:
        found = sample_batch(texts, seeds, shared.value, k, known)
        flat = [(i, number, *s) for i, samples in zip(ids, found, strict=True) for number, s in enumerate(samples)]
        columns = list(zip(*flat, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), *[pa.float64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SAMPLES.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) + 1)
            at = 0
            while at < batch.num_rows:
                done = size[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(size, done + BATCH, side="right")))
                ids, seeds, texts = (c.to_pylist() for c in batch.slice(at, end - at).columns)
                yield emit(ids, texts, seeds, known)
                at = end

    return rows.mapInArrow(work, SAMPLES)
