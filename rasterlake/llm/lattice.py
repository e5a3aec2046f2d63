"""SentencePiece encoding and decoding by sampling segmentations without replacement from the piece lattice.

A text's lattice has an edge for every piece of the vocabulary at every place (and byte pieces for characters without one); a
segmentation's probability is in proportion to the product of its pieces' weights. No piece crosses the start of a word, so the
lattice is a chain of word lattices, whose backward sums are worked out once for each different word of a slice of texts.

Samples come from Gumbel top-k: an A* search over prefixes, ordered by perturbed log-probabilities. The root has the largest
perturbation; the child on its best path inherits it, the other children get perturbations truncated below it and wait in a
queue; taking the largest from the queue and completing it gives the next sample, distinct from all before. Each sample comes with
its log-probability, its perturbed value and its log inclusion score, against the largest value left in the queue. Nodes whose
prefix is so unlikely that no perturbation (of 32-bit numbers) can bring it before the k-th candidate are not expanded.

All draws are seeded by the row's key: equal keys and texts give equal samples. Defined cases: null and empty texts have the one
empty segmentation; texts with fewer segmentations than asked for give all of them; an empty table gives no rows; extra columns
are ignored; rows are independent.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, table

SAMPLES = 2
#: Weight of a byte piece, as a logarithm.
BYTE_WEIGHT = -12.0
#: Evens out weights of long words: a power of this for each character, the same on all paths.
LIFT = 5.0
#: Longest word in characters that is worked out in linear weights; longer ones in logarithms.
LONG_WORD = 100
#: -log(-log(u)) of the largest number drawn, 1 - 2**-33, is less than this.
NOISE = 22.9
#: Edges of a path whose siblings are looked at together.
WINDOW = 192
#: Characters of the texts whose lattices are held at once (one longer text is held alone).
SLICE_CHARS = 1_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(seed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), of 32 bits, for seeds and counters."""
    h = _mix(seed + at.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return ((h >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32


class Pieces:
    """A vocabulary: its pieces, their log weights, and a trie in hash-table form."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        plain = []
        for i, t in enumerate(self.text):
            if model.is_byte(i):
                self.byte_id[int(t[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        # weights fall with the rank, as word frequencies do
        ranks = np.array([1.0 - model.get_score(i) if model.get_score(i) > -1e8 else 1.0 for i in plain])
        logs = -np.log(np.maximum(ranks, 1) + 2)
        logs -= math.log(np.exp(logs).sum())
        self.decoded = [b""] * n
        for i in plain:
            self.decoded[i] = self.text[i].replace("▁", " ").encode()
        for b, i in enumerate(self.byte_id):
            self.decoded[i] = bytes([b])
        self.decoded_column = pa.array(self.decoded, pa.binary())
        letters = sorted({c for i in plain for c in self.text[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        nodes: dict[tuple[int, int], int] = {}
        self.node_id, self.node_log = [-1], [0.0]
        for i, w in zip(plain, logs):
            at = 0
            for c in self.text[i]:
                to = nodes.get((at, self.code[ord(c)]))
                if to is None:
                    to = nodes[at, self.code[ord(c)]] = len(self.node_id)
                    self.node_id.append(-1)
                    self.node_log.append(0.0)
                at = to
            self.node_id[at], self.node_log[at] = i, float(w)
        self.node_id, self.node_log = np.array(self.node_id, np.int32), np.array(self.node_log)
        keys = np.array([a * self.width + int(c) for a, c in nodes], np.int64)
        values = np.fromiter(nodes.values(), np.int32, len(nodes))
        self.slots = 1 << (len(keys) * 4).bit_length()
        self.key, self.value = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.key[at[todo]] < 0]
            self.key[at[free]] = keys[free]
            self.value[at[free]] = values[free]
            todo = todo[self.key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & (self.slots - 1)
        self.longest = max(len(self.text[i]) for i in plain)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        shift = 64 - (self.slots.bit_length() - 1)
        return ((keys.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(shift)).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of trie nodes by letter; 0 where there is none."""
        keys = nodes.astype(np.int64) * self.width + codes
        at, out, open_ = self._slot(keys), np.zeros(len(keys), np.int32), np.flatnonzero(codes > 0)
        while len(open_):
            found = self.key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            at[open_] = (at[open_] + 1) & (self.slots - 1)
        return out

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes of many ids in a row, and where each id's bytes begin (and the end)."""
        got = self.decoded_column.take(pa.array(ids))
        _, ends, raw = got.buffers()
        ends = np.frombuffer(ends, np.int32)[got.offset : got.offset + len(got) + 1]
        return np.frombuffer(raw or b"", np.uint8), ends

    def decode(self, ids) -> str:
        """The text of a segmentation (without the blank put before the text)."""
        raw = b"".join(map(self.decoded.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> Pieces:
    """The vocabulary of a file, kept by a worker for its next tasks."""
    return Pieces(path)


def words_of(text: str) -> list[str]:
    """The lattice's words: runs of blanks with the characters after them, of the text with a blank before it. The first blank of
    each is left out here (``Lattice`` puts it back), the others are written as pieces have them."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, blanks = [], ""
    for p in parts:
        if p:
            out.append(blanks + p)
            blanks = ""
        else:
            blanks += "▁"
    if blanks:
        out.append(blanks[1:])
    return out


class Lattice:
    """Lattices of distinct words: nodes are places (word after word, each with an end), edges sorted by node."""

    def __init__(self, pieces: Pieces, words: list[str]):
        self.pieces = pieces
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        flat = np.frombuffer(("▁" + "\0▁".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.start = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        self.end = self.start + sizes
        n = len(flat)
        self.n = n
        # distance to the word's end (0 at the end itself, where the separator is)
        left = np.repeat(self.end, sizes + 1) - np.arange(n)
        self.left = left
        codes = pieces.code[flat]
        codes[self.end] = 0
        at = np.flatnonzero(left > 0).astype(np.int32)
        levels = []  # of pieces of one more character each: node, piece, log weight
        node, here = pieces.step(np.zeros(len(at), np.int64), codes[at]), at
        ways = np.zeros(n + 1, np.int32)
        single = np.zeros(n, bool)
        size = 1
        while len(here):
            ok = node > 0
            node, here = node[ok], here[ok]
            good = pieces.node_id[node] >= 0
            found = here[good]
            levels.append((found, size, pieces.node_id[node[good]], pieces.node_log[node[good]]))
            ways[found] += 1
            if size == 1:
                single[found] = True
            go = left[here] > size
            node, here = node[go], here[go]
            node = pieces.step(node, codes[here + size])
            size += 1
        lone = at[~single[at]]  # characters without a piece: their bytes
        value = flat[lone].astype(np.int32)
        bytes_ = 1 + (value > 0x7F).astype(int) + (value > 0x7FF) + (value > 0xFFFF)
        self.lone = bool((value > 0x7F).any())
        # one byte: its piece; more: the character, as a negative number
        ident = np.where(value > 0x7F, -1 - value, pieces.byte_id[np.minimum(value, 0x7F)])
        levels.append((lone, 1, ident, bytes_ * BYTE_WEIGHT))
        ways[lone] += 1
        self.first = np.cumsum(ways, dtype=np.int64) - ways  # a node's edges: first[i] to first[i + 1]
        total, fill = int(ways.sum()), self.first.copy()
        self.src, self.dst, self.ident, self.log = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        for found, size, ident, log in reversed(levels):  # long pieces, mostly the likeliest, come first
            spot = fill[found]
            fill[found] += 1
            self.src[spot], self.dst[spot], self.ident[spot], self.log[spot] = found, found + size, ident, log
        self._backward(sizes)

    def _backward(self, sizes: np.ndarray) -> None:
        """Chances of edges at their nodes, from backward sums over the words."""
        beta = np.zeros(self.n)
        beta[self.end] = 1.0
        long_ = np.flatnonzero(sizes > LONG_WORD)
        weight = np.exp(self.log + LIFT * (self.dst - self.src))
        away = np.minimum(self.left, LONG_WORD + 1).astype(np.uint8)[self.src]
        if len(long_):
            away[(sizes > LONG_WORD)[np.repeat(np.arange(len(sizes)), sizes + 1)][self.src]] = LONG_WORD + 1
        edges = np.argsort(away, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(away, minlength=LONG_WORD + 2))))[1 : LONG_WORD + 2]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            some = edges[a:b]
            got = weight[some] * beta[self.dst[some]]
            s = self.src[some]
            first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
            beta[s[first]] = np.add.reduceat(got, first)
        # sums that left the range of doubles (many byte pieces) are worked out in logarithms too
        long_ = np.union1d(long_, np.flatnonzero((beta[self.start] < 1e-280) & (sizes > 0)))
        scale = beta[self.src]
        if len(long_):
            scale[scale == 0] = 1.0
        self.chance = weight * beta[self.dst] / scale
        for w in long_:
            self._long(int(self.start[w]), int(self.end[w]))
        # cumulative chances within a node
        total = np.concatenate(([0.0], np.cumsum(self.chance)))
        self.until = total[1:] - total[self.first][self.src]
        last = self.first[1:][self.first[1:] > self.first[:-1]] - 1
        self.until[last] = 1.0
        with np.errstate(divide="ignore"):
            self.log_chance = np.log(self.chance)

    def _long(self, start: int, end: int) -> None:
        beta = np.full(end - start + 1, -np.inf)
        beta[-1] = 0.0
        for at in range(end - 1, start - 1, -1):
            a, b = self.first[at], self.first[at + 1]
            v = self.log[a:b] + beta[self.dst[a:b] - start]
            top = v.max()
            e = np.exp(v - top)
            beta[at - start] = top + math.log(e.sum())
            self.chance[a:b] = e / e.sum()

    def draw(self, starts: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled edges of words, one seed a word: (edges in order, number of edges of each word)."""
        n = len(starts)
        place, live = starts.copy(), np.arange(n)
        steps, rows = [], []
        counter = np.zeros(1, np.uint64)
        while len(live):
            u = _uniform(seeds[live], counter)
            counter += _U(1)
            e = self.first[place[live]].copy()
            open_ = np.flatnonzero(self.until[e] < u)
            while len(open_):
                e[open_] += 1
                open_ = open_[self.until[e[open_]] < u[open_]]
            steps.append(e)
            rows.append(live)
            place[live] = self.dst[e]
            live = live[self.left[place[live]] > 0]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        counts = np.zeros(n, np.int64)
        for live in rows:
            counts[live] += 1
        spot = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for live, e in zip(rows, steps):
            at = spot[live]
            out[at] = e
            spot[live] = at + 1
        return out, counts


class Growing(Lattice):
    """Lattices of all words met so far, up to a bound (then it starts anew): words that come again are not worked out again."""

    NODES, EDGES, BLOCK = 2_600_000, 5_600_000, 8192
    KINDS = {"src": np.int32, "dst": np.int32, "ident": np.int32, "chance": np.float32, "until": np.float32, "log_chance": np.float32}

    def __init__(self, pieces: Pieces, room: float = 1.0):
        self.pieces = pieces
        self.NODES, self.EDGES = int(self.NODES * room), int(self.EDGES * room)
        self._room(self.NODES, self.EDGES)

    def _room(self, nodes: int, edges: int) -> None:
        self.number: dict[str, int] = {}
        self.n, self.edges, self.lone = 0, 0, False
        self.left, self.first = np.empty(nodes, np.int32), np.zeros(nodes + 1, np.int64)
        self.start = np.empty(nodes, np.int64)
        for name, kind in self.KINDS.items():
            setattr(self, name, np.empty(edges, kind))

    def learn(self, words: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the words of some texts; words that are new are worked out, block by block."""
        new = set().union(*words).difference(self.number)
        nodes = sum(map(len, new)) + 2 * len(new)
        if self.n + nodes > len(self.left) or self.edges + 5 * nodes // 2 > len(self.src):
            new = set().union(*words)
            nodes = sum(map(len, new)) + 2 * len(new)
            self._room(max(self.NODES, nodes), max(self.EDGES, 5 * nodes // 2))
        fresh = list(new)
        for at in range(0, len(fresh), self.BLOCK):
            self._add(fresh[at : at + self.BLOCK])
        number = self.number.__getitem__
        return [np.fromiter(map(number, ws), np.int64, len(ws)) for ws in words]

    def _add(self, words: list[str]) -> None:
        block = Lattice(self.pieces, words)
        k, m = len(self.number), len(block.src)
        self.number.update(zip(words, range(k, k + len(words))))
        if self.edges + m > len(self.src):  # pieces are denser than foreseen
            for name in self.KINDS:
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old[: self.edges], np.empty(max(m, self.edges), old.dtype)]))
        self.start[k : k + len(words)] = block.start + self.n
        self.left[self.n : self.n + block.n] = block.left
        self.first[self.n : self.n + block.n + 1] = block.first + self.edges
        for name in self.KINDS:
            getattr(self, name)[self.edges : self.edges + m] = getattr(block, name) + (self.n if name in ("src", "dst") else 0)
        self.n, self.edges, self.lone = self.n + block.n, self.edges + m, self.lone or block.lone


def _truncated(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel values of locations ``phi`` given that they are at most ``top``, from uniform numbers."""
    return phi - np.log(np.exp(np.minimum(phi - top, 700.0)) - np.log(u))


class Sampler:
    """Samples of whole texts."""

    def __init__(self, pieces: Pieces, samples: int = SAMPLES, room: float = 1.0):
        self.pieces, self.samples = pieces, samples
        self.lattice = Growing(pieces, room)

    def many(self, keys: list, texts: list[str | None]) -> list[list[tuple[np.ndarray, float, float, float]]]:
        """For each text its samples: ids, log-probability, perturbed value, log inclusion score; largest value first."""
        from xxhash import xxh64_intdigest

        spots = self.lattice.learn([words_of(t or "") for t in texts])
        lattice = self.lattice
        seeds = np.array([xxh64_intdigest(repr(k).encode()) for k in keys], np.uint64)
        sizes = np.array([len(s) for s in spots], np.int64)
        if not sizes.sum():
            return [[(np.zeros(0, np.int32), 0.0, float(-math.log(-math.log(_uniform(s, np.array([0]))[0]))), 0.0)] for s in seeds[:, None]]
        flat = np.concatenate(spots)
        owner = np.repeat(np.arange(len(texts)), sizes)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        firsts = np.cumsum(sizes) - sizes

        def draw(k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The ``k``-th draw of the words at ``at``: edges, where those of each word begin (and the end), sums of logarithms."""
            seed = _mix(_mix(seeds + _U(k + 1))[owner[at]] + within[at].astype(np.uint64))
            edges, steps = lattice.draw(lattice.start[flat[at]], seed)
            ends = np.concatenate(([0], np.cumsum(steps)))
            return edges, ends, np.concatenate(([0], np.cumsum(lattice.log_chance[edges], dtype=np.float64)))

        first = draw(0, np.arange(len(flat)))
        own = _mix(seeds ^ _U(0xA5A5A5A5A5A5A5A5))
        values = -np.log(-np.log(_uniform(own, np.zeros(len(own), np.int64))))
        begun = self._first_siblings(lattice, first, firsts, sizes, own, values)
        searches = [self._search(lattice, first, int(firsts[i]), int(sizes[i]), own[i : i + 1], float(values[i]), begun[i]) for i in range(len(texts))]
        out: list = [None] * len(texts)
        replies: dict = dict.fromkeys(range(len(texts)))
        for k in range(1, self.samples + 1):  # all texts' next samples at once, drawn from where they leave known paths
            asked, words = [], []
            for i, reply in replies.items():
                try:
                    words.append(searches[i].send(reply))
                    asked.append(i)
                except StopIteration as end:
                    out[i] = end.value
            if not asked:
                break
            left = sizes[asked] - np.array(words)
            cuts = np.concatenate(([0], np.cumsum(left)))
            at = np.arange(cuts[-1]) + np.repeat((firsts[asked] + np.array(words)) - cuts[:-1], left)
            edges, ends, logs = draw(k, at)
            bounds = ends[cuts].tolist()
            replies = {i: (edges[a:b], float(logs[b] - logs[a])) for i, a, b in zip(asked, bounds[:-1], bounds[1:])}
        return out

    @staticmethod
    def _siblings(lattice: Lattice, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The other edges at the nodes of some edges: where in ``some``, and which."""
        low = lattice.first[lattice.src[some]]
        ways = lattice.first[lattice.src[some] + 1] - low
        spot = np.repeat(np.arange(len(some)), ways)
        other = np.arange(len(spot)) + np.repeat(low - (np.cumsum(ways) - ways), ways)
        good = (other != some[spot]) & (lattice.chance[other] > 0)
        return spot[good], other[good]

    def _first_siblings(self, lattice: Lattice, draw: tuple, firsts: np.ndarray, sizes: np.ndarray, own: np.ndarray, values: np.ndarray) -> list:
        """The siblings of all texts' first samples over their first ``WINDOW`` edges, at once: per text the best of them
        (value, place in the path, edge, location), and how many numbers were drawn."""
        edges, ends, logs = draw
        start, stop = ends[firsts], ends[firsts + sizes]
        taken = np.minimum(stop - start, WINDOW)
        text = np.repeat(np.arange(len(sizes)), taken)
        within = np.arange(len(text)) - np.repeat(np.cumsum(taken) - taken, taken)
        at = start[text] + within
        spot, other = self._siblings(lattice, edges[at])
        owner = text[spot]
        count = np.bincount(owner, minlength=len(sizes))
        turn = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        phi = logs[at[spot]] - logs[start[owner]] + lattice.log_chance[other]
        v = _truncated(phi, values[owner], _uniform(own[owner], turn + 1))
        order = np.lexsort((-v, owner))
        rank = np.arange(len(order)) - (np.cumsum(count) - count)[owner[order]]
        out: list = [([], int(c)) for c in count]
        for j in order[rank < self.samples].tolist():
            out[owner[j]][0].append((-float(v[j]), int(within[spot[j]]), int(other[j]), float(phi[j])))
        return out

    def _search(self, lattice: Lattice, drawn: tuple, first: int, n: int, own: np.ndarray, value: float, begun: tuple):
        """A* over one text: the best completion of the best open prefix is the next sample. Yields the word from which on the
        next sample is to be drawn, is sent its edges and their logarithm, and returns the samples."""
        best, used = begun
        used += 1
        queue: list = []
        done: list = []

        def uniforms(n: int) -> np.ndarray:
            nonlocal used
            used += n
            return _uniform(own, np.arange(used - n, used))

        def expand(path: np.ndarray, at: int, log: float, value: float) -> None:
            """Queue the siblings along a path from ``at`` on, window by window; only the best can be needed."""
            need = self.samples + 1 - len(done)
            size = WINDOW // 2
            while at < len(path):
                kth = -heapq.nsmallest(need, queue)[-1][0] if len(queue) >= need else -math.inf
                if log + NOISE < kth:
                    break
                some = path[at : at + size]
                sure = lattice.log_chance[some]
                here = log + np.cumsum(sure, dtype=np.float64) - sure
                spot, other = self._siblings(lattice, some)
                if len(other):
                    phi = here[spot] + lattice.log_chance[other]
                    v = _truncated(phi, value, uniforms(len(phi)))
                    for j in np.argsort(-v)[:need].tolist():
                        heapq.heappush(queue, (-float(v[j]), len(queue), path, at + int(spot[j]), int(other[j]), float(phi[j])))
                log = float(here[-1] + sure[-1])
                at += size
                size *= 2

        edges, ends, logs = drawn
        a, b = int(ends[first]), int(ends[first + n])
        path = edges[a:b]
        done.append((path, float(logs[b] - logs[a]), value))
        for k, (v, i, other, phi) in enumerate(best):
            heapq.heappush(queue, (v, k, path, i, other, phi))
        at = min(WINDOW, b - a)
        expand(path, at, float(logs[a + at] - logs[a]), value)
        while queue and len(done) < self.samples:
            v, _, path, i, other, phi = heapq.heappop(queue)
            head = [*path[:i].tolist(), other]
            word = int((lattice.left[lattice.dst[path[:i]]] == 0).sum())
            place = int(lattice.dst[other])
            while lattice.left[place] > 0:  # the rest of the word that the prefix ends in
                low, high = lattice.first[place], lattice.first[place + 1]
                e = int(low + np.searchsorted(lattice.until[low:high], float(uniforms(1)[0])))
                head.append(e)
                place = int(lattice.dst[e])
            word += 1
            rest, sure = yield word
            new = np.concatenate([np.array(head, np.int64), rest])
            done.append((new, float(lattice.log_chance[head].sum(dtype=np.float64)) + sure, -v))
            expand(new, i + 1, phi, -v)
        kappa = -queue[0][0] if queue else -math.inf
        out = []
        for path, total, value in done:
            over = total - kappa
            inclusion = math.log(-math.expm1(-math.exp(min(over, 700)))) if over > -30 else over
            out.append((self._ids(lattice, path), total, value, inclusion))
        return out

    def _ids(self, lattice: Lattice, path: np.ndarray) -> np.ndarray:
        ids = lattice.ident[path]
        if not lattice.lone:
            return ids
        odd = np.flatnonzero(ids < 0)
        parts, at = [], 0
        for i in odd.tolist():
            parts += [ids[at:i], self.pieces.byte_id[np.frombuffer(chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass"), np.uint8)]]
            at = i + 1
        return np.concatenate([*parts, ids[at:]]).astype(np.int32)


def sampled(docs: DataFrame, path: str, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text", room: float = 1.0) -> DataFrame:
    """``room`` scales what a worker holds (words known, text at once): less memory, more work, the same samples.

    A row a sample: ``sample`` (0 on), ``ids``, ``n_pieces``, ``log_prob``, ``value``, ``log_inclusion``, ``decodes`` (to the text)."""
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        sampler = Sampler(loaded(path), samples, room)
        for batch in batches:
            total = np.cumsum([len(x or b"") for x in as_bytes(batch.column(1))])
            cuts = [0, *(np.flatnonzero(np.diff(total // max(1, int(SLICE_CHARS * room)))) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                keys, texts, raws = part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(1))
                got = sampler.many(keys, texts)
                rows = [(i, k, *s) for i, ss in enumerate(got) for k, s in enumerate(ss)]
                index, rank, ids, logs, values, inclusions = zip(*rows)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids)
                raw, bounds = sampler.pieces.decode_all(flat)
                raw = raw.tobytes()
                same = [raw[x:y] == (b" " + raws[i] if raws[i] else b"") for i, x, y in zip(index, bounds[ends[:-1]].tolist(), bounds[ends[1:]].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(index)), pa.array(rank, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                        pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(inclusions, pa.float64()), pa.array(same),
                    ],
                    names=[id_col, "sample", "ids", "n_pieces", "log_prob", "value", "log_inclusion", "decodes"],
                )

    schema = f"`{id_col}` {id_type}, sample int, ids array<int>, n_pieces long, log_prob double, value double, log_inclusion double, decodes boolean"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decoded(samples: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``samples`` with the ids decoded in ``text`` (null ids: null)."""

    @F.pandas_udf("string")
    def text_of(column):
        pieces = loaded(path)
        return column.map(lambda x: None if x is None else pieces.decode(x))

    return samples.withColumn("text", text_of(F.col(ids_col)))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with the 32k vocabulary."""
    import public_tokenizers

    return sampled(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
