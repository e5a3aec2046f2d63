"""Toxicity: a subsequence string kernel with Nyström landmarks under a linear support vector machine.

Two words are alike if they share letter subsequences of length three, inner gaps discounted (``DECAY`` a skipped place, spans of
at most ``SPAN`` places): inserted characters, dropped marks and inflected endings cost a little, not all. A word
that is no more than ``FLOOR`` like any landmark counts as unlike all; likenesses are sharpened (``SHARP``). The kernel of two texts is the sum over all pairs of their distinct
words, over the root of both texts' sizes, so that one insult in a long text weighs less than many in a short one. Landmarks are
words that tell labelled toxic sentences from clean ones, with common words as a counterweight; the inverse root of their own
kernel matrix makes a text's sums over landmarks the Nyström map of that kernel, on which a squared-hinge machine is trained and
then calibrated to probabilities.

The kernel between a word and all landmarks is worked out through the landmarks' subsequences: a table of codes, summed over the
places of a word, in numpy over all distinct words of a slice of texts. Runs of single letters are one word more.

Labels and ids never enter a score; learning takes at most ``FIT_ROWS`` labelled ids, picked by hash, with one text each (the
least, where an id has several). Defined cases: null and
empty texts score as texts without words; words of under three letters have no likeness; null and conflicting labels are ignored;
without both labels every score is 0; rows are independent, equal ids included; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, per_text, table

DECAY = 0.6
SPAN = 5
SHARP = 3
FLOOR = 0.4
LANDMARKS = 64
COMMON = 4
#: Words that a text's size has besides its own, and the penalty of the machine's weights.
SIZE = 20
RIDGE = 0.02
#: Bounds of labelled rows that are learned from: toxic and clean.
FIT_ROWS = (2000, 3500)
CUT = 0.3
#: Hashes from 0 to this are compared with a threshold.
_HASHES = 1 << 40
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Stand-ins for letters, put back before comparing.
_STAND_IN = dict(zip("013457@$", "oieastas"))
MARKS = ".,;:!?\"'()[]{}<>|"
#: Between words in a batch: a word's end, places that nothing matches, a word's start.
_GAP = "\x03" + "\0" * (SPAN - 1) + "\x02"


def _letter_table() -> np.ndarray:
    """1 to 26 for a-z (upper case and stand-ins too), 27 to 61 for other letters, 62 and 63 for a word's start and end, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for k in range(0x20, 0x3000):
        c = chr(k).lower()[0]
        c = _STAND_IN.get(c, c)
        out[k] = ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 35 if c.isalpha() else 0
    rest = np.arange(0x3000, 0x110000)
    out[0x3000:] = 27 + rest % 35
    out[2], out[3] = 62, 63
    return out


_LETTERS = _letter_table()


def normal(token: str) -> str:
    """A token as it is compared: marks at its ends dropped, lower case, usual stand-ins for letters put back."""
    return "".join(_STAND_IN.get(c, c) for c in token.strip(MARKS).lower())


def tokens_of(text: str | None) -> set[str]:
    """Distinct tokens of a text; runs of three and more single letters are joined into one more token each."""
    parts = (text or "").split()
    out = set(parts)
    lone = "".join([p if len(p) == 1 else " " for p in parts])
    out.update(p for p in lone.split(" ") if len(p) > 2 and p.isalpha())
    return out


class Likeness:
    """The normalised kernel between words and landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        flat, first = self._laid(landmarks)
        owner = np.searchsorted(first, np.arange(len(flat)), side="right") - 1
        norms = self._norms(flat, first)
        codes, own, weight = [], [], []
        for (a, b), c in self._codes(flat):
            n = len(c)
            at = np.nonzero((flat[:n] > 0) & (flat[a : a + n] > 0) & (flat[b : b + n] > 0))[0]
            codes.append(c[at])
            own.append(owner[at])
            weight.append(np.full(len(at), DECAY ** (b - 2), np.float32))
        distinct, row = np.unique(np.concatenate(codes), return_inverse=True)
        table = np.zeros((len(distinct) + 1, len(landmarks)), np.float32)
        np.add.at(table, (row + 1, np.concatenate(own)), np.concatenate(weight))
        self.table = table / np.maximum(norms, 1e-9)[None, :]
        self.top = self.table.max(axis=1)
        self.rows = np.zeros(64**3, np.int32)
        self.rows[distinct] = np.arange(1, len(distinct) + 1)

    @staticmethod
    def _laid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of all words, with gaps between them, and where each word starts."""
        text = "\x02" + _GAP.join(words) + "\x03" + "\0" * SPAN
        flat = _LETTERS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return flat, np.concatenate(([0], np.cumsum(sizes + len(_GAP))))[:-1]

    @staticmethod
    def _codes(flat: np.ndarray):
        """For each pair of offsets the code of the three letters at each place (letters that are no letters have code 0)."""
        n = len(flat) - SPAN
        last = flat.astype(np.int32)
        mid, top = last << 6, last[:n] << 12
        for a, b in _OFFSETS:
            yield (a, b), top + mid[a : a + n] + last[b : b + n]

    @staticmethod
    def _norms(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Norms of words, of the weights of their subsequences place by place."""
        n = len(flat) - SPAN
        real = (flat > 0).view(np.uint8)
        total = np.zeros(n, np.float32)
        for b in range(2, SPAN):
            ways = real[1 : 1 + n].copy()
            for a in range(2, b):
                ways += real[a : a + n]
            total += (ways * (real[:n] & real[b : b + n])) * np.float32(DECAY ** (2 * (b - 2)))
        return np.sqrt(np.add.reduceat(total, first))

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that are like any landmark (over the floor), and their sharpened likeness to all."""
        hits, out = [], []
        for start in range(0, len(words), 16384):
            flat, first = self._laid(words[start : start + 16384])
            norms = self._norms(flat, first)
            places, rows, weights = [], [], []
            for (_, b), c in self._codes(flat):
                row = self.rows.take(c)
                at = np.flatnonzero(row)
                places.append(at)
                rows.append(row[at])
                weights.append(np.full(len(at), DECAY ** (b - 2), np.float32))
            place, row, weight = np.concatenate(places), np.concatenate(rows), np.concatenate(weights)
            if not len(place):
                continue
            owner = np.searchsorted(first, place, side="right") - 1
            # the greatest weight of each place over all landmarks bounds the sums below (with room for rounding)
            near = np.bincount(owner, weight * self.top.take(row), len(first)) >= 0.9999 * FLOOR * np.maximum(norms, 1e-9)
            keep = near[owner]
            owner, row, weight = owner[keep], row[keep], weight[keep]
            if not len(owner):
                continue
            order = np.argsort(owner, kind="stable")
            owner, row, weight = owner[order], row[order], weight[order]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            for at in range(0, len(cuts), 2048):  # bounds the gathered rows
                some = cuts[at : at + 2048]
                a, b = some[0], cuts[at + 2048] if at + 2048 < len(cuts) else len(owner)
                own = owner[some]
                like = np.add.reduceat(self.table[row[a:b]] * weight[a:b, None], some - a, axis=0) / norms[own][:, None]
                top = like.max(axis=1) > FLOOR
                hits.append(own[top] + start)
                out.append(np.clip(like[top], 0, 1) ** SHARP)
        if not hits:
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        return np.concatenate(hits), np.concatenate(out)

    def summed(self, texts: list[str | None]) -> np.ndarray:
        """Each text's likeness to each landmark: the sum over its distinct words, over the root of its size."""
        number: dict[str, int] = {}
        raw: dict[str, int] = {}
        spots = []
        for t in texts:
            own = tokens_of(t)
            for w in own.difference(raw):
                raw[w] = number.setdefault(w.strip(MARKS), len(number))
            spots.append(np.fromiter(map(raw.__getitem__, own), np.int64, len(own)))
        words = list(number)
        at, like = self.of(words)
        where = np.full(len(words), -1, np.int64)
        where[at] = np.arange(len(at))
        out = np.zeros((len(texts), len(self.landmarks)))
        for k, own in enumerate(spots):
            hit = where[own]
            hit = np.unique(hit[hit >= 0])
            if len(hit):
                out[k] = like[hit].sum(axis=0, dtype=float) / np.sqrt(len(own) + SIZE)
        return out


def stems(words: set[str]) -> set[str]:
    """Words and the beginnings (four and five letters) of longer ones, under which inflected forms meet."""
    return words.union(w[:n] for w in words if len(w) > 6 for n in (4, 5))


def pick_landmarks(toxic: list[set[str]], clean: list[set[str]], n: int = LANDMARKS, common: int = COMMON) -> list[str]:
    """Words and stems by how far their share of toxic texts exceeds that of clean ones, unlike each other; then common words."""
    t, c = Counter(w for s in toxic for w in stems(s)), Counter(w for s in clean for w in stems(s))
    worth = {w: k * np.log(((k + 0.1) / len(toxic)) / ((c[w] + 0.1) / len(clean))) for w, k in t.items() if k >= 3 and len(w) > 2 and k / len(toxic) > 4 * c[w] / len(clean)}
    out: list[str] = []
    ranked = sorted(worth, key=lambda w: (-worth[w], w))[: 4 * n]
    if ranked:
        full = Likeness(ranked)
        gram = np.zeros((len(ranked), len(ranked)))
        at, like = full.of(ranked)
        gram[at] = like ** (1 / SHARP)
        taken: list[int] = []
        for i in range(len(ranked)):
            if len(taken) < n and all(gram[i, j] < 0.9 for j in taken):
                taken.append(i)
        out = [ranked[i] for i in taken]
    out += [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0])) if len(w) > 3 and w not in out][:common]
    return out


class Machine:
    """Nyström map, squared-hinge weights and calibration."""

    def __init__(self, texts: list[str | None], toxic: np.ndarray, weight: np.ndarray):
        words = [{normal(w) for w in tokens_of(t)} for t in texts]
        self.like = Likeness(pick_landmarks([w for w, y in zip(words, toxic) if y], [w for w, y in zip(words, toxic) if not y]))
        marks = self.like.landmarks
        gram = np.zeros((len(marks), len(marks)))
        at, rows = self.like.of(marks)
        gram[at] = rows
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
        x = self._map(texts)
        y = np.where(toxic, 1.0, -1.0)
        balance = np.where(toxic, 0.5 / max(toxic.mean(), 1e-9), 0.5 / max(1 - toxic.mean(), 1e-9))
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), RIDGE)
        ridge[0] = 1e-3
        for _ in range(50):  # Newton steps of the squared hinge
            on = y * (x @ w) < 1
            h = (x[on] * balance[on][:, None]).T @ x[on] + np.diag(ridge)
            new = np.linalg.solve(h, (x[on] * balance[on][:, None]).T @ y[on])
            if np.abs(new - w).max() < 1e-8:
                break
            w = new
        self.weights = w
        # calibration with the rows' true weights, so that scores are shares
        margin = x @ w
        a, b = 1.0, 0.0
        f = np.stack([margin, np.ones_like(margin)], axis=1)
        v = np.array([a, b])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(f @ v, -30, 30)))
            g = f.T @ (weight * (p - toxic)) + 1e-2 * v
            h = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-2 * np.eye(2)
            v = v - np.clip(np.linalg.solve(h, g), -2, 2)
        self.scale = v

    def _map(self, texts: list[str | None]) -> np.ndarray:
        z = self.like.summed(texts) @ self.root
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        margin = self._map(texts) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * margin + self.scale[1], -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, rows: tuple[int, int] = FIT_ROWS) -> Machine | None:
    """A machine from labelled documents (``doc_id``, ``text``; ``doc_id``, ``toxic``); None without both labels."""
    said = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    counts = {r.toxic: r["count"] for r in said.groupBy("toxic").count().collect()}
    picked = None
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(_HASHES))
    for label, n in ((1, rows[0]), (0, rows[1])):
        # tasks send ids below a threshold only, so that all of them send about n
        share = min(1.0, 1.1 * n / max(counts.get(label, 0), 1) + 100 / max(counts.get(label, 0), 1))
        part = said.where((F.col("toxic") == label) & (mark < int(share * _HASHES))).orderBy(mark, "doc_id").limit(n).select("doc_id", "toxic")
        picked = part if picked is None else picked.unionByName(part)
    # at most FIT_ROWS ids, so the broadcast is bounded, and one text each
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted(found.collect(), key=lambda r: r.doc_id)
    toxic = np.array([r.toxic == 1 for r in got], bool)
    if not len(got) or toxic.all() or not toxic.any():
        return None
    weight = np.where(toxic, counts[1] / toxic.sum(), counts[0] / (~toxic).sum())
    return Machine([r.text for r in got], toxic, weight / weight.mean())


def scored(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text its score and prediction."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    id_type = dict(docs.dtypes)[id_col]

    def make():
        model = held.value

        def work(texts):
            s = model.score(texts) if model else np.zeros(len(texts))
            return {"score": s.tolist(), "predicted": (s >= CUT).astype(int).tolist()}

        return work

    return per_text(docs, f"`{id_col}` {id_type}, score double, predicted int", make, id_col, text_col, decode=True)


def held_out(column: Column) -> Column:
    return F.coalesce(crc_mod(column, 4) == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from the labelled ones outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = trained(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    return scored(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
