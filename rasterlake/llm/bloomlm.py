"""Language-model scores from a log-frequency Bloom filter of word pairs, smoothed by exact word counts.

Texts are cut into chunks of about ``CHUNK_TOKENS`` tokens, held as numbers into the chunk's sorted word keys (64-bit hashes).
Two exchanges follow, both of packed arrays by ranges of keys: each chunk asks for the corpus counts of its words and gets them
back, and each chunk asks for its pairs' levels, telling how often it has them in training. Pairs seen ``MIN_COUNT`` times (once)
or more go into a Bloom filter, a segment a range: a pair whose count has the quantised logarithm q is entered as (pair, 1) to
(pair, q), so that probing levels until one is missing recovers q. Each segment is as large as its range's entries need
(``ENTRY_BITS`` each) and is probed where it is made, for all chunks' pairs of the range, so that the filter grows with the corpus
and no process holds more of it than a segment. Ranges grow with the input, and partitions with the ranges; a chunk sends a row
only for ranges in which it has keys, so that rows never exceed the chunks' distinct words and pairs.
A word's probability mixes the pair's share, from the filter, with the word's own.

Words are told apart by 64-bit hashes: two of V words share one with a chance of about V * V / 2**65 (V of a thousand millions:
3 %). Pairs are told apart by 40 bits of a hash within their range of keys: as a range has about a million pairs at every size of
input, one pair in a million counts with another, far fewer than the filter's own false answers.

Lower-cased (A-Z) words, then one end token a text. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))).

Defined cases: null and empty texts are one end token; null ids are training rows; rows are independent, equal ids included; with
no training rows N and V are zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, stored, table, tidy

CHUNK_TOKENS = 500_000
#: Characters of input for each range of keys.
RANGE_CHARS = 8_000_000
#: Ranges that one task has on average, where there are more of them than the session's shuffle partitions have.
TASK_RANGES = 16
MIN_COUNT = 1
ENTRY_BITS = 15
PROBES = 4
PAIR_WEIGHT = 0.5
_END = b" "  # no word holds a blank
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range (0 to n - 1) of each key; rises with the key."""
    return ((keys >> _U(32)) * _U(n)) >> _U(32)  # up to 2**32 ranges


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a + _U(0x9E3779B97F4A7C15)) + b)


def _pack5(keys: np.ndarray) -> bytes:
    """The low 40 bits of keys."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack5(raw: bytes) -> np.ndarray:
    low = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :5] = low
    return out.view("<u8").ravel()


def _planes(x: np.ndarray) -> list[bytes]:
    """Numbers as squeezed planes of their bytes."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    octets = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    return [squeeze(np.ascontiguousarray(octets[:, k])) for k in range(x.itemsize)]


def _from_planes(parts: list[bytes], kind) -> np.ndarray:
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    return np.stack([np.frombuffer(loose(p), np.uint8) for p in parts], axis=1).view(kind).ravel()


def _by_count(counts: np.ndarray) -> np.ndarray:
    """Numbers of words, the most common first."""
    return np.argsort(-counts.astype(np.int64), kind="stable").astype(np.uint32)


class Chunk:
    """Texts as numbers into sorted word keys."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, training: np.ndarray):
        self.keys, self.numbers, self.sizes, self.training = keys, numbers, sizes, training

    def packed(self) -> bytes:
        # common words get small numbers; their order follows from the counts
        counts = np.bincount(self.numbers, minlength=len(self.keys))
        place = np.empty(len(self.keys), np.uint32)
        place[_by_count(counts)] = np.arange(len(self.keys), dtype=np.uint32)
        parts = [*_planes(self.keys), *_planes(counts.astype(np.uint32)), *_planes(place[self.numbers]), *_planes(self.sizes.astype(np.uint64)), self.training.astype(np.uint8).tobytes()]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpacked(cls, raw: bytes) -> Chunk:
        n = 8 + 4 + 4 + 8 + 1
        ends = 8 * n + np.cumsum(np.frombuffer(raw[: 8 * n], np.int64))
        parts = [raw[a:b] for a, b in zip([8 * n, *ends[:-1]], ends)]
        counts = _from_planes(parts[8:12], np.uint32)
        numbers = _by_count(counts)[_from_planes(parts[12:16], np.uint32)]
        return cls(_from_planes(parts[:8], np.uint64), numbers, _from_planes(parts[16:24], np.uint64).astype(np.int64), np.frombuffer(parts[24], np.uint8).astype(bool))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words before and at each token, and whether there is one before (not at a text's start)."""
        first = np.zeros(len(self.numbers), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        before = np.roll(self.numbers, 1)
        return before, self.numbers, ~first


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of the texts: ``chunk`` (number), ``ids`` and ``held`` (arrays), ``body`` (packed)."""
    id_type = dict(docs.dtypes)[id_col]
    held = F.coalesce(crc_mod(F.col(id_col), 5) == 1, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        part, made = TaskContext.get().partitionId(), 0

        def fresh():
            numbers = defaultdict(count().__next__)
            numbers[_END]
            return numbers, [], [], [], 0

        def flush(id_arrow):
            nonlocal made
            words = list(numbers)
            keys = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
            order = np.argsort(keys)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            body = Chunk(keys[order], place[np.concatenate(texts)], np.array([len(t) for t in texts], np.int64), ~np.array(helds, bool)).packed()
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([ids], pa.list_(id_arrow)), pa.array([helds], pa.list_(pa.bool_())), pa.array([body], pa.binary())], names=["chunk", "ids", "held", "body"]
            )

        numbers, texts, ids, helds, size = fresh()
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for key, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                words = (raw or b"").lower().split()
                words.append(_END)
                texts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(key)
                helds.append(out)
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield flush(kind)
                    numbers, texts, ids, helds, size = fresh()
        if ids:
            yield flush(kind)

    return docs.select(F.col(id_col), held.alias("held"), F.col(text_col)).mapInArrow(run, f"chunk long, ids array<{id_type}>, held array<boolean>, body binary")


def _by_range(df: DataFrame, run, schema: str, ranges: int) -> DataFrame:
    """``run`` over the rows of each range, which lie together: it gets (range, list of rows' other columns) one at a time."""
    parts = ranges // TASK_RANGES
    dealt = df.repartition(parts, "range") if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition("range")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for r in zip(*columns):
                if r[0] != last and rows:
                    yield run(last, rows)
                    rows = []
                last = r[0]
                rows.append(r[1:])
        if rows:
            yield run(last, rows)

    return dealt.sortWithinPartitions("range").mapInArrow(over, schema)


def word_counts(chunks: DataFrame, ranges: int) -> DataFrame:
    """Answers to the chunks: ``chunk``, ``range``, ``counts`` (of its keys in that range); and totals in rows of chunk -1."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = Chunk.unpacked(body)
                train = np.bincount(c.numbers[np.repeat(c.training, c.sizes)], minlength=len(c.keys)).astype(np.uint32)
                of = _ranges_of(c.keys, ranges)
                cuts = np.searchsorted(of, np.arange(ranges + 1).astype(np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), number)), pa.array([c.keys[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary()), pa.array([train[cuts[r] : cuts[r + 1]].tobytes() for r in full], pa.binary())],
                    names=["range", "chunk", "keys", "counts"],
                )

    def answer(r: int, rows: list) -> pa.RecordBatch:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for _, k, _ in rows])
        n = np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in rows]).astype(float)
        _, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, n).astype(np.uint64)
        back, ends = total[where], np.cumsum([len(k) // 8 for _, k, _ in rows])
        counts = [back[e - len(k) // 8 : e].tobytes() for e, (_, k, _) in zip(ends, rows)]
        return pa.RecordBatch.from_arrays(
            [pa.array([*[c for c, _, _ in rows], -1]), pa.array(np.full(len(rows) + 1, r)), pa.array([*counts, np.array([total.sum(), (total > 0).sum()], np.uint64).tobytes()], pa.binary())], names=["chunk", "range", "counts"]
        )

    asked = chunks.select("chunk", "body").mapInArrow(ask, "range long, chunk long, keys binary, counts binary")
    return _by_range(asked, answer, "chunk long, range long, counts binary", ranges)


def pair_levels(chunks: DataFrame, ranges: int, min_count: int = MIN_COUNT) -> DataFrame:
    """Answers to the chunks: ``chunk``, ``range``, ``levels`` (of its pairs in that range by key, as the filter has them)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = Chunk.unpacked(body)
                a, b, inner = c.pairs()
                held = ~np.repeat(c.training, c.sizes)[inner]
                both, n = np.unique((a[inner].astype(np.int64) * len(c.keys) + b[inner]) << 1 | held, return_counts=True)
                n[both & 1 == 1] = 0
                both >>= 1
                first = np.flatnonzero(np.diff(both, prepend=-1))
                both, n = both[first], np.add.reduceat(n, first) if len(n) else n
                keys = pair_keys(c.keys[both // len(c.keys)], c.keys[both % len(c.keys)])
                order = np.argsort(keys)
                keys, n = keys[order], n[order].astype(np.uint32)
                cuts = np.searchsorted(_ranges_of(keys, ranges), np.arange(ranges + 1).astype(np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                packed, small, large = [], [], []
                for r in full:
                    k, m = keys[cuts[r] : cuts[r + 1]], n[cuts[r] : cuts[r + 1]]
                    packed.append(_pack5(k))
                    small.append(np.minimum(m, 255).astype(np.uint8).tobytes())
                    large.append(m[m >= 255].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array(np.full(len(full), number)), pa.array(packed, pa.binary()), pa.array(small, pa.binary()), pa.array(large, pa.binary())], names=["range", "chunk", "keys", "small", "large"]
                )

    def answer(r: int, rows: list) -> pa.RecordBatch:
        import zstandard

        n = np.frombuffer(b"".join(x for _, _, x, _ in rows), np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(b"".join(x for _, _, _, x in rows), np.uint32)
        keys, where = np.unique(_unpack5(b"".join(k for _, k, _, _ in rows)), return_inverse=True)
        back = LogFilter.of(keys, np.bincount(where, n), min_count, ENTRY_BITS).levels(keys)[where]
        ends = np.cumsum([len(x) for _, _, x, _ in rows])
        squeeze = zstandard.ZstdCompressor(level=1).compress
        levels = [squeeze(back[e - len(x) : e].tobytes()) for e, (_, _, x, _) in zip(ends, rows)]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _, _, _ in rows]), pa.array(np.full(len(rows), r)), pa.array(levels, pa.binary())], names=["chunk", "range", "levels"])

    asked = chunks.select("chunk", "body").mapInArrow(ask, "range long, chunk long, keys binary, small binary, large binary")
    return _by_range(asked, answer, "chunk long, range long, levels binary", ranges)


class LogFilter:
    """A segment of the filter; an entry of level q answers at levels ``floor`` to q."""

    def __init__(self, bits: np.ndarray, segment: int, floor: int, min_count: int):
        self.bits, self.segment, self.floor, self.min_count = bits, segment, floor, min_count

    @classmethod
    def of(cls, entries: np.ndarray, n: np.ndarray, min_count: int, entry_bits: int = ENTRY_BITS) -> LogFilter:
        """The segment of entries seen ``n`` times, all that are seen ``min_count`` times or more at all their levels."""
        keep = n >= min_count
        entries, q = entries[keep], (np.floor(np.log2(n[keep] / min_count)) + 1).astype(np.int64)
        segment = (max(int(q.sum()) * entry_bits, 64) + 7) // 8 * 8
        bits = np.zeros(segment, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            for at in cls.places(entries[q >= level], level, segment):
                bits[at.astype(np.int64)] = 1
        return cls(np.packbits(bits, bitorder="little"), segment, 1, min_count)

    @staticmethod
    def places(entries: np.ndarray, level: int, segment: int) -> Iterator[np.ndarray]:
        """Bit places of entries at a level; one array a probe."""
        h = _mix(entries + _U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
        step = (h >> _U(32)) | _U(1)
        for k in range(PROBES):
            yield (h + _U(k) * step) % _U(segment)

    def levels(self, entries: np.ndarray) -> np.ndarray:
        """Quantised levels by repeated probes: 0 where the lowest entered level is missing."""
        out = np.zeros(len(entries), np.uint8)
        open_ = np.arange(len(entries))
        level = self.floor
        while len(open_) and level < 64:
            some = entries[open_]
            alive = np.arange(len(some))
            for at in self.places(some, level, self.segment):
                at = at[alive]
                alive = alive[(self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1]
                if not len(alive):
                    break
            open_ = open_[alive]
            out[open_] = level
            level += 1
        return out


def level_counts(levels: np.ndarray, min_count: int = MIN_COUNT) -> np.ndarray:
    """Estimated counts: the middle (geometric) of the least and the largest count of a level; 0 for level 0."""
    least = min_count * 2.0 ** (levels.astype(float) - 1)
    return np.where(levels > 0, np.sqrt(least * (2 * least - 1)), 0.0)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    id_type = dict(docs.dtypes)[id_col]
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    ranges = int(max(chars // RANGE_CHARS, 32))
    chunks = stored(encoded(docs, id_col, text_col), "lm-chunks")
    answers = stored(word_counts(chunks, ranges), "lm-counts")
    totals = np.zeros(2)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                out += np.frombuffer(x, np.uint64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out[0]]), pa.array([out[1]])], names=["n", "v"])

    n, v = answers.where("chunk = -1").select("counts").mapInArrow(add, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0
    tidy(docs.sparkSession)
    levels = stored(pair_levels(chunks, ranges), "lm-levels")
    tidy(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's answers come in order of their ranges, its texts after them."""
        import zstandard

        loose = zstandard.ZstdDecompressor().decompress
        counts: list[bytes] = []
        marks: list[bytes] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for number, r, answer, mark, ids, out, body in zip(*columns):
                if body is None:
                    if answer is not None:
                        counts.append(answer)
                    else:
                        marks.append(loose(mark))
                    continue
                c = Chunk.unpacked(body)
                known = np.frombuffer(b"".join(counts), np.uint64).astype(float)
                counts = []
                assert len(known) == len(c.keys), "a chunk's answers are not complete"
                own = (known + 0.5) / (n + 0.5 * (v + 1))
                a, b, inner = c.pairs()
                p = own[b]
                both, where = np.unique(a[inner].astype(np.int64) * len(c.keys) + b[inner], return_inverse=True)
                x, y = both // len(c.keys), both % len(c.keys)
                level = np.frombuffer(b"".join(marks), np.uint8)
                marks = []
                assert len(level) == len(both), "a chunk's levels are not complete"
                share = np.zeros(len(both))
                share[np.argsort(pair_keys(c.keys[x], c.keys[y]))] = level_counts(level)
                share = np.where((known[x] > 0) & (known[y] > 0), np.minimum(share / np.maximum(known[x], 1), 1.0), 0.0)
                mixed = p.copy()
                mixed[inner & (known[a] > 0)] *= 1 - PAIR_WEIGHT
                mixed[inner] += PAIR_WEIGHT * share[where]
                first = np.cumsum(c.sizes) - c.sizes
                sums = [np.add.reduceat(z, first) for z in (np.log10(own)[b], np.log10(mixed), (known > 0)[b].astype(np.int64))]
                k = len(c.sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.column(4).type.value_type), pa.array(out, pa.bool_()), pa.array(c.sizes), pa.array(sums[2]), pa.array(np.full(k, n, np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                    names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    last = F.lit(1 << 62)
    none = {"counts": "binary", "levels": "binary", "ids": f"array<{id_type}>", "held": "array<boolean>", "body": "binary"}

    def filled(df: DataFrame) -> DataFrame:
        return df.select("chunk", "range", *[c if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in none.items()])

    rows = filled(answers.where("chunk >= 0")).unionByName(filled(levels)).unionByName(filled(chunks.withColumn("range", last)))
    rows = rows.repartition("chunk").sortWithinPartitions("chunk", "range")
    return rows.mapInArrow(score, f"`{id_col}` {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, learned from four fifths of them."""
    return scores(table(spark, sf_dir, "documents"))

