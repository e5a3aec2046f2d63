import random
from itertools import combinations

import numpy as np
import xxhash

from rasterlake.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """Component ids of (id, fingerprint) rows, by comparing all pairs."""
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    a = np.array(prints, np.uint64)
    for f in prints:
        for g in np.nonzero(np.bitwise_count(a ^ np.uint64(f)) <= 3)[0]:
            p, q = find(f), find(prints[g])
            if p != q:
                root[max(p, q)] = min(p, q)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted((str(i), format(f, "016x"), str(least.get(find(f)))) for i, f in rows)


def found(df):
    return sorted((str(r.doc_id), format(r.fp % (1 << 64), "016x"), str(r.component_id)) for r in df.collect())


def test_any_five_positions_hold_a_set():
    assert all(any(set(p) <= set(c) for p in simhash.POSITIONS) for c in combinations(range(8), 5))


def test_documents(odd, none, sample):
    for docs in (odd, sample):
        assert found(simhash.classes(docs)) == brute([(r.doc_id, plain(r.text)) for r in docs.collect()])
    assert simhash.classes(none).count() == 0


def test_long_lists_lose_no_link(spark, monkeypatch):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for base in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(700):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(24)
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(i, c) for i, _, c in brute([(f, f) for f in prints])}
    for limit in (10**9, 32):
        monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
        roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
        groups = {}
        for x in signed:
            groups.setdefault(roots.get(x, x), []).append(x % (1 << 64))
        assert {(str(m), str(min(g))) for g in groups.values() for m in g} == want


def test_big_lists_are_probed():
    rng = random.Random(5)
    base = rng.getrandbits(64) & ~((1 << 18) - 1)
    prints = np.array(sorted({base | rng.getrandbits(18) for _ in range(6000)}), np.uint64)
    fast = simhash._roots(prints)
    want = {(i, c) for i, _, c in brute([(int(f), int(f)) for f in prints])}
    assert {(str(a), str(b)) for a, b in fast.T} == want


def test_one_of_each_class_stays(odd, none, sample):
    for docs in (odd, sample):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        classes = brute([(r.doc_id, plain(r.text)) for r in docs.collect()])
        assert sorted(str(r.doc_id) for r in kept.collect() if r.doc_id is not None) == sorted({c for _, _, c in classes if c != "None"})
    assert sum(r.doc_id is None for r in simhash.keep_one(odd).collect()) == 1
    assert simhash.keep_one(none).count() == 0


def test_equal_ids_in_different_classes_all_stay(spark):
    """An id that stands on rows of several classes keeps one row in each of them, the same one in every order of the rows."""
    texts = ["one two three four five six seven", "wholly other words that share nothing here", "a third text of yet more different things"]
    rows = [(5, texts[0], "a"), (5, texts[1], "b"), (5, texts[1], "c"), (6, texts[1], "d"), (None, texts[2], "e"), (None, texts[2], "f"), (None, texts[0], "g")]
    kept = []
    for at in range(3):
        docs = spark.createDataFrame([*rows[at:], *rows[:at]], "doc_id long, text string, row string").repartition(at + 1)
        kept.append(sorted(map(str, simhash.keep_one(docs).collect())))
        got = simhash.keep_one(docs).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("5", texts[0]), ("5", texts[1]), ("None", texts[2])])
    assert kept[0] == kept[1] == kept[2]
