"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits differ in at most three bytes, so
they share at least five positional bytes (the guaranteed minimum). Instead of one posting list a byte, whose lists grow with
the corpus, the index is keyed by sets of four byte positions, chosen so that any five positions contain one of the sets: 14
sets are enough. In each list the shared positional bytes of pairs are tallied, pairs with five or more are verified bit by bit.

Lists of over ``LIST_LIMIT`` different fingerprints are refined, not cut: five shared bytes leave 24 free bits with at most
three differences, so one of four groups of six bits is equal too; such a refined list fixes 46 bits and so never holds over
2**18 fingerprints, and is searched by flipping up to three of its 18 free bits. No link between different fingerprints is lost.

Defined cases: null and blank texts have fingerprint zero and link like any other. Rows with equal ids are independent rows.
Null ids take part, but are never the smallest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, stored

SEED = 42
MAX_BITS = 3
MIN_BYTES = 5
LIST_LIMIT = 512
_PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
#: Sets of four byte positions: any five of eight positions contain one. Two halves, and pairs of pairs of equal kind.
POSITIONS = ((0, 1, 2, 3), (4, 5, 6, 7)) + tuple((*p, q[0] + 4, q[1] + 4) for m in _PAIRINGS for p in m for q in m)


def fingerprint(raw: bytes | None) -> bytes:
    """64-bit SimHash, most significant byte first, over lower-cased (A-Z) 3-word shingles."""
    from xxhash import xxh64_digest

    words = (raw or b"").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) < 3:
        digests = [xxh64_digest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *[e + 1 for e in ends[:-3]]]
        digests = [xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends[2:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        part = np.frombuffer(b"".join(digests[at : at + 65536]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long)."""

    def make():
        return lambda texts: {"fp": pa.array(np.frombuffer(b"".join(map(fingerprint, texts)), ">u8").astype(np.uint64).view(np.int64))}

    id_type = dict(docs.dtypes)[id_col]
    return per_text(docs, f"`{id_col}` {id_type}, fp long", make, id_col, text_col)


def _byte(at: int):
    """The positional byte, 0 the most significant."""
    return F.shiftrightunsigned("fp", 56 - 8 * at).bitwiseAND(F.lit(255))


def _joined(parts) -> F.Column:
    out = F.lit(0).cast("long")
    for p, bits in parts:
        out = F.shiftleft(out, bits).bitwiseOR(p)
    return out


def postings(distinct: DataFrame) -> DataFrame:
    """One row for each fingerprint and set of positions: ``list_key`` (set, then its four bytes) and ``fp``."""
    keys = [_joined([(F.lit(k).cast("long"), 0), *[(_byte(p), 8) for p in ps]]) for k, ps in enumerate(POSITIONS)]
    return distinct.select(F.explode(F.array(*keys)).alias("list_key"), "fp")


def _refined(big: DataFrame) -> DataFrame:
    """Sixteen refined keys for each row of a long list: a fifth byte position, and one of four six-bit groups of the rest."""
    free = [[p for p in range(8) if p not in ps] for ps in POSITIONS]
    # by set and choice of the fifth position: that position, then the three that remain
    order = F.array(*[F.array(*[F.lit(f[k])] + [F.lit(p) for p in f if p != f[k]]) for f in free for k in range(4)])
    rows = big.select("list_key", "fp", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part"), order.alias("order"))
    at = F.get("order", (F.shiftright("list_key", 32) * 4 + F.floor(F.col("part") / 4)).cast("int"))
    rows = rows.select("list_key", "fp", "part", at.alias("at"))
    one = [F.call_function("shiftrightunsigned", F.col("fp"), 56 - 8 * F.get("at", F.lit(k))).bitwiseAND(F.lit(255)) for k in range(4)]
    rest = _joined([(x, 8) for x in one[1:]])
    group = F.call_function("shiftright", rest, (6 * (F.col("part") % 4)).cast("int")).bitwiseAND(F.lit(63))
    return rows.select(F.xxhash64("list_key", "part", one[0], group).alias("list_key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _roots(fps: np.ndarray) -> np.ndarray:
    """For each of some distinct fingerprints of one list, the smallest that it reaches inside this list."""
    fps = np.sort(fps)
    n = len(fps)
    label = np.arange(n)
    if n <= 4096:
        linked = []
        for at in range(0, n, 256):
            diff = fps[at : at + 256, None] ^ fps[None, :]
            octets = diff.view(np.uint8).reshape(*diff.shape, 8)
            shared = (octets == 0).sum(axis=2)  # the tally of shared positional bytes
            i, j = np.nonzero(shared >= MIN_BYTES)
            keep = (_popcount(diff[i, j]) <= MAX_BITS) & (i + at < j)
            linked.append(np.stack([i[keep] + at, j[keep]]))
        pairs = np.concatenate(linked, axis=1)
    else:
        differing = int(np.bitwise_or.reduce(fps ^ fps[0]))
        free = [b for b in range(64) if differing >> b & 1]  # at most 18 in a refined list
        found = []
        for r in range(1, MAX_BITS + 1):
            for flips in combinations(free, r):
                other = fps ^ np.uint64(sum(1 << b for b in flips))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                i = np.nonzero((fps[at] == other) & (other > fps))[0]
                if len(i):
                    found.append(np.stack([i, at[i]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
    while pairs.shape[1]:
        a, b = label[pairs[0]], label[pairs[1]]
        open_ = a != b
        if not open_.any():
            break
        pairs = pairs[:, open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return np.stack([fps, fps[label]])


def _links(lists: DataFrame) -> DataFrame:
    """Links (``a`` > ``b`` as unsigned order of a list's root) inside each list; each list lies whole in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(groups: list[np.ndarray]):
            out = [_roots(g) for g in groups if len(g) > 1]
            out = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.uint64)
            out = out[:, out[0] != out[1]].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.nonzero(np.diff(keys))[0] + 1
            parts = np.split(fps, cuts)
            if last is not None and keys[0] == last:
                held.append(parts.pop(0))
                if not parts:
                    continue
            done = [np.concatenate(held)] if held else []
            yield emit(done + parts[:-1])
            held, last = [parts[-1]], keys[-1]
        if held:
            yield emit([np.concatenate(held)])

    return lists.repartition("list_key").sortWithinPartitions("list_key").select("list_key", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """Spanning links between distinct fingerprints (``fp``) that differ in at most three bits, list by list."""
    rows = postings(distinct)
    sizes = rows.groupBy("list_key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(sizes, "list_key"), "simhash-lists")
    short = _links(shared.where(F.col("size") <= LIST_LIMIT))
    long_ = _links(_refined(shared.where(F.col("size") > LIST_LIMIT)))
    return short.unionByName(long_).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (``a``, ``b``): ``node`` and ``root``, the least node (signed order) that it reaches.

    Alternating large-star and small-star steps; each round is written to the shared folder. Rounds grow with the logarithm of the
    longest path, so that ``rounds`` are enough for any table; ``RuntimeError`` if they are not.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stored(small.select("e.u", "e.v").where("u != v").distinct(), "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp`` (long) and ``component_id``: the smallest id among all texts that links reach."""
    marks = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(marks.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = stored(named.join(least, "root").select("fp", "component_id"), "classes")
    return marks.join(by_fp, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with its columns: of the smallest id (a null id only where the class has no other), then of the
    least digest of the whole row, so that equal ids on different texts stand for their own classes, and every run keeps the same."""
    whole = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.to_json(F.struct("*")), 256)).alias("h"))
    order = F.struct(F.col("row.doc_id").isNull().alias("nameless"), F.col("row.doc_id").alias("id"), "h")
    found = classes(whole.select(order.alias("key"), F.col("row.text").alias("text")), "key")
    stay = found.where(F.col("key.h") == F.col("component_id.h")).select(F.col("key.h").alias("h")).distinct()
    return whole.join(stay, "h", "left_semi").dropDuplicates(["h"]).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``."""
    from .common import table

    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
