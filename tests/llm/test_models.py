"""Quality, toxicity and language model: held-out accuracy, exact counts, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import bloomlm, quality_model, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, docs, labels):
    got = toxicity.query(spark, SF).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    right = sum((r.score >= 0.3) == (r.toxic == 1) for r in got)
    assert right >= 0.9 * len(got) and all(r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.query(spark, SF).where("held_out").count() == sum(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.select("doc_id").collect())


def test_toxicity_gaps_and_insertions(docs, labels):
    machine = toxicity.trained(docs, labels)
    plain, gapped, clean = machine.score(["you are so stupid and pathetic", "you are so stu-pid and pa.thetic", "the ation of the onthe is with"])
    assert plain > 0.3 and gapped > 0.3 and clean < 0.1


def test_kernel_by_hand():
    like = toxicity.Likeness(["abcdefgh"])

    def phi(word):
        codes, out = [62, *[ord(c) - 96 for c in word], 63], Counter()
        for i in range(len(codes)):
            for j in range(i + 1, len(codes)):
                for k in range(j + 1, min(len(codes), i + toxicity.SPAN)):
                    out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    a, b = phi("abcdefgh"), phi("abcdxefgh")
    want = sum(a[u] * b[u] for u in a) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    at, got = like.of(["abcdxefgh", "zzzz"])
    assert at.tolist() == [0] and got[0, 0] == pytest.approx(want**toxicity.SHARP, rel=1e-4)


def brute_phi(word):
    """Subsequences of three letters of a word with its ends, with their weights; and the norm of the weights place by place."""
    codes = [62, *[int(toxicity._LETTERS[ord(c)]) for c in word], 63]
    out, square = Counter(), 0.0
    for i in range(len(codes)):
        for k in range(i + 2, min(len(codes), i + toxicity.SPAN)):
            for j in range(i + 1, k):
                if codes[i] and codes[j] and codes[k]:
                    out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i - 2)
                    square += toxicity.DECAY ** (2 * (k - i - 2))
    return out, math.sqrt(square)


def brute_likes(word, marks):
    out = []
    for mark in marks:
        (a, n), (b, m) = brute_phi(word), brute_phi(mark)
        out.append(sum(w * b[u] for u, w in a.items()) / max(n * m, 1e-9))
    return np.clip(out, 0, 1) ** toxicity.SHARP if max(out) > toxicity.FLOOR else np.zeros(len(marks))


def test_no_word_over_the_floor_is_left_out():
    """Repeated subsequences lift a sum over any norm; the bound before it has to let them through."""
    rng = np.random.default_rng(4)
    marks = ["hahahaha", "lololo", "stupid", "aaaa"]
    words = list({"".join(rng.choice(list("ahlosk"), rng.integers(3, 14))) for _ in range(1500)} | {"aahackbeiefekfck", "stu-pid", "s.t.u.p.i.d"})
    like = toxicity.Likeness(marks)
    at, got = like.of(words)
    rows = {words[i]: r for i, r in zip(at.tolist(), got)}
    for w in words:
        want = brute_likes(w, marks)
        assert np.abs(rows.get(w, np.zeros(len(marks))) - want).max() < 1e-4, w


def test_scores_by_hand(spark, docs, labels):
    """Scores of whole texts from the kernel's definition and the machine's weights."""
    machine = toxicity.trained(docs, labels)
    marks = machine.like.landmarks
    texts = ["you are so stupid and pathetic", "S.T.U.P.I.D people, i d i o t !", "", None, "the ation of the onthe is with", "trash trash trash, trash"] + [r.text for r in docs.orderBy("n_chars").limit(8).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scored(rows, machine).collect()}
    for k, t in enumerate(texts):
        parts = (t or "").split()
        lone = "".join(p if len(p) == 1 else " " for p in parts).split(" ")
        own = set(parts) | {p for p in lone if len(p) > 2 and p.isalpha()}
        x = sum([brute_likes(w, marks) for w in {w.strip(toxicity.MARKS) for w in own}], np.zeros(len(marks))) / math.sqrt(len(own) + toxicity.SIZE)
        margin = machine.weights[0] + x @ machine.root @ machine.weights[1:]
        want = 1 / (1 + math.exp(-max(-30, min(30, machine.scale[0] * margin + machine.scale[1]))))
        assert got[k] == pytest.approx(want, abs=2e-3)


def test_toxicity_odd_rows(odd, none, labels, docs):
    machine = toxicity.trained(docs, labels)
    assert toxicity.scored(odd, machine).count() == odd.count()
    assert toxicity.scored(none, machine).count() == 0
    assert toxicity.trained(none, labels) is None
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}


def test_quality_held_out(spark, docs, labels):
    odd_half = F.col("doc_id") % 2 == 1
    learn = labels.where(~odd_half)
    got = quality_model.scores(docs, learn, F.col("source"), F.concat_ws("/", "source", "lang")).join(labels.where(odd_half).select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.keep == (r.quality == 1) for r in got) >= 0.95 * len(got)


def test_quality_shrinks_sparse_sites(spark):
    bad, good = "### $$$ *** %%% " * 5, "a sentence of words that reads well enough to be kept by all "
    rows = [(i, bad if i % 2 else good, "big" if i < 200 else "tiny") for i in range(201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.scores(docs, labels, F.col("host"), F.col("host")).collect()}
    assert abs(got[200].path_rate - 0.5) < abs(1.0 - 0.5) and got[0].host_docs == 200
    assert got[0].doc_score > 0.5 > got[1].doc_score


def test_quality_posteriors_by_hand(spark, sample):
    """The whole chain of posteriors over given evidence, each document left out of its own groups."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    said = {r.doc_id: float(r.quality) for r in labels.collect()}
    got = quality_model.scores(sample, labels, F.col("source"), F.concat_ws("/", "source", "lang")).collect()
    place = {r.doc_id: (r.source, f"{r.source}/{r.lang}") for r in sample.collect()}
    e = {r.doc_id: said.get(r.doc_id, r.doc_score) for r in got}
    paths, hosts = {}, {}
    for i, v in e.items():
        for sums, key in ((paths, place[i]), (hosts, place[i][0])):
            n, s = sums.get(key, (0, 0.0))
            sums[key] = (n + 1, s + v)
    rate = sum(e.values()) / len(e)

    def strength(groups):  # (n, s, mean) of each group
        n, nn = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
        within = rate * (1 - rate)
        between = max((sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - (len(groups) - 1) * within) / (n - nn / n), 0.0)
        return min(max(within / between - 1, 1.0), 1e6) if between > 1e-9 else 1e6

    strong = strength([(n, s, rate) for n, s in hosts.values()])
    posterior = {h: (strong * rate + s) / (strong + n) for h, (n, s) in hosts.items()}
    tied = strength([(n, s, posterior[k[0]]) for k, (n, s) in paths.items()])
    for r in got:
        host, path = place[r.doc_id]
        (n, s), (hn, hs) = paths[host, path], hosts[host]
        by_host = (strong * rate + hs - e[r.doc_id]) / (strong + hn - 1)
        by_path = (tied * by_host + s - e[r.doc_id]) / (tied + n - 1)
        logit = lambda p: math.log(p / (1 - p))
        final = max(-12.0, min(12.0, logit(r.doc_score))) + logit(min(max(by_path, 1e-4), 1 - 1e-4)) - logit(rate)
        assert (r.path_docs, r.host_docs) == (n, hn)
        assert r.host_rate == pytest.approx(by_host, rel=1e-9) and r.path_rate == pytest.approx(by_path, rel=1e-9)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-final)), rel=1e-6) and r.keep == (r.quality_score >= 0.5)


def test_a_label_does_not_count_for_itself(spark):
    """Turning one document's label changes its neighbours' rates, not its own."""
    words = "a sentence of words that reads well enough "
    docs = spark.createDataFrame([(i, words * (1 + i % 3), "h", f"p{i % 2}") for i in range(30)], "doc_id long, text string, host string, path string")
    rows = [(i, int(i % 4 > 0)) for i in range(30)]
    got = []
    for mine in (0, 1):
        labels = spark.createDataFrame([(i, mine if i == 6 else q) for i, q in rows], "doc_id long, quality int")
        got.append({r.doc_id: r.path_rate for r in quality_model.scores(docs, labels, F.col("host"), F.col("path")).collect()})
    assert abs(got[0][6] - got[1][6]) < abs(got[0][8] - got[1][8])


def test_sample_is_bounded(spark):
    rows = [(k, [float(k % 50)] * 2, 1.0) for k in range(3000)] + [(7, [0.5, 0.5], 0.0)] * 3000
    labelled = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(4)
    got = quality_model._sample(labelled, 500)
    assert 200 <= len(got) <= 500 and got == quality_model._sample(labelled.repartition(3), 500)
    assert len(quality_model._sample(labelled, 100_000)) == 3001


def test_quality_odd_rows(spark, odd, none):
    said = spark.createDataFrame([(1, 1), (1, 0), (2, None), (99, 1), (None, 0)], "doc_id long, quality int")
    for labels in (said, said.limit(0)):
        assert quality_model.scores(odd, labels, F.col("source"), F.col("lang")).count() == odd.count()
        assert quality_model.scores(none, labels, F.col("source"), F.col("lang")).count() == 0
        assert quality_rules.rules(odd, labels).count() == odd.count()
        assert quality_rules.rules(none, labels).count() == 0
        kept = quality_rules.keep(odd, labels)
        want = {str(r.doc_id) for r in quality_rules.rules(odd, labels).where("kept").collect()}
        assert kept.columns == odd.columns and {str(r.doc_id) for r in kept.collect()} == want


def test_rules_base_counts(odd, labels):
    def brute(text):
        import re

        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        rep = {k + d for k, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep), len(ws) < 50 or 100 * len(rep) > 50 * len(ws)

    want = sorted((str(r.doc_id), *brute(r.text)) for r in odd.collect())
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.rules(odd, labels).collect())
    assert got == want


def test_binomial_tail(spark):
    cases = [(50, 3, 0.1), (1000, 0, 0.01), (20000, 100, 0.01), (10, 9, 0.05), (0, 0, 0.1)]
    df = spark.createDataFrame([(n, k) for n, k, _ in cases], "n long, k long")
    for n, k, p in cases:
        got = df.where((F.col("n") == n) & (F.col("k") == k)).select(quality_rules.binomial_tail(F.col("n"), F.col("k"), p).alias("t")).first().t
        want = 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_rules_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.sql(quality_rules.ORACLE_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = quality_rules.query(spark, "/root/testdata/sf0.001").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])


def brute_lm(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*(t or "").encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), b" "]
        out.append((str(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 3)))
    return sorted(out)


def test_language_model(odd, none, sample):
    for docs in (odd, sample):
        got = bloomlm.scores(docs).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == brute_lm([(r.doc_id, r.text) for r in docs.collect()])
    assert bloomlm.scores(none).count() == 0


def test_small_chunks_give_the_same(sample, monkeypatch):
    whole = {r.doc_id: r for r in bloomlm.scores(sample).collect()}
    monkeypatch.setattr(bloomlm, "CHUNK_TOKENS", 700)
    for r in bloomlm.scores(sample).collect():
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=1e-9)


def test_scores_of_pairs_by_hand(odd, sample, monkeypatch):
    """Smoothed probabilities from exact counts, where the filter has so much room that no pair answers by chance."""
    monkeypatch.setattr(bloomlm, "ENTRY_BITS", 400)
    for docs in (odd, sample):
        rows = [(str(r.doc_id), r.doc_id, [*(r.text or "").encode().lower().split(), b" "]) for r in docs.collect()]
        words, pairs = Counter(), Counter()
        for _, i, ws in rows:
            if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
                words.update(ws)
                pairs.update(zip(ws, ws[1:]))
        n, v = sum(words.values()), len(words)
        want = []
        for name, _, ws in rows:
            total = 0.0
            for before, w in zip([None, *ws], ws):
                p = (words[w] + 0.5) / (n + 0.5 * (v + 1))
                if before is not None and words[before]:
                    least = 2.0 ** (pairs[before, w].bit_length() - 1)
                    count = math.sqrt(least * (2 * least - 1)) if pairs[before, w] else 0.0
                    p = 0.5 * p + 0.5 * min(count / words[before], 1.0)
                total += math.log10(p)
            want.append((name, total))
        got = sorted((str(r.doc_id), r.score) for r in bloomlm.scores(docs).collect())
        assert [g[0] for g in got] == [w[0] for w in sorted(want)]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], rel=1e-6)


def test_ranges_follow_the_input(sample, monkeypatch):
    """More ranges and partitions than a session has by default change nothing but the filter's false answers."""
    monkeypatch.setattr(bloomlm, "ENTRY_BITS", 400)
    few = {r.doc_id: r for r in bloomlm.scores(sample).collect()}
    monkeypatch.setattr(bloomlm, "RANGE_CHARS", 400)
    for r in bloomlm.scores(sample).collect():
        assert r.score == pytest.approx(few[r.doc_id].score, rel=1e-6) and r.base_score == pytest.approx(few[r.doc_id].base_score)


def test_chunks_of_more_words_than_three_bytes_number():
    keys = np.arange(1 << 25, dtype=np.uint64)
    numbers = np.array([5, 1 << 24, (1 << 25) - 1, 5], np.uint32)
    c = bloomlm.Chunk.unpacked(bloomlm.Chunk(keys, numbers, np.array([4]), np.array([True])).packed())
    assert c.numbers.tolist() == numbers.tolist() and c.sizes.tolist() == [4]


def test_pairs_help_held_out_texts(spark):
    got = bloomlm.scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_filter_recovers_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 4000).astype(np.uint64)
    levels = rng.integers(1, 6, 4000).astype(np.uint8)
    segment = 1 << 20
    bits = np.zeros(segment, np.uint8)
    for level in range(1, 6):
        for at in bloomlm.LogFilter.places(keys[levels >= level], level, segment):
            bits[at.astype(np.int64)] = 1
    filter_ = bloomlm.LogFilter(np.packbits(bits, bitorder="little"), segment, 1, 2)
    got = filter_.levels(keys)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    assert (filter_.levels(rng.integers(0, 1 << 40, 4000).astype(np.uint64)) == 0).mean() > 0.95


def test_filter_grows_with_the_pairs():
    """Pairs at their lowest level are found however many there are; no level is left out to save room."""
    rng = np.random.default_rng(2)
    for n in (1000, 1_000_000):
        keys = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        seen = np.full(len(keys), 2)
        filter_ = bloomlm.LogFilter.of(keys, seen, 2)
        assert filter_.floor == 1 and filter_.segment >= 15 * len(keys)
        assert (filter_.levels(keys) >= 1).all() and (filter_.levels(keys) == 1).mean() > 0.95


def test_pair_levels_are_the_corpus_levels(spark, monkeypatch):
    """Each chunk gets the levels of its pairs, from training rows of all chunks, in order of their keys."""
    texts = ["a b c a b", "a b d", "x y z x", "b c b c b c b c", "", "q"]
    docs = spark.createDataFrame([(k, texts[k % 6]) for k in range(60)], "doc_id long, text string")
    monkeypatch.setattr(bloomlm, "CHUNK_TOKENS", 20)
    counts = Counter()
    for k in range(60):
        ws = [*texts[k % 6].split(), " "]
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(zip(ws, ws[1:]))
    import xxhash

    chunks = bloomlm.encoded(docs.coalesce(2)).cache()
    key = {xxhash.xxh3_64_intdigest(w.encode()): w for w in "abcdxyzq "}
    import zstandard

    answers = {}
    for r in bloomlm.pair_levels(chunks, 4, 2).orderBy("chunk", "range").collect():
        answers.setdefault(r.chunk, b"")
        answers[r.chunk] += zstandard.ZstdDecompressor().decompress(bytes(r.levels))
    assert chunks.count() > 4
    for r in chunks.collect():
        c = bloomlm.Chunk.unpacked(bytes(r.body))
        a, b, inner = c.pairs()
        pairs = sorted({(x, y) for x, y in zip(c.keys[a[inner]].tolist(), c.keys[b[inner]].tolist())}, key=lambda p: int(bloomlm.pair_keys(np.array([p[0]], np.uint64), np.array([p[1]], np.uint64))[0]))
        want = [counts[key[x], key[y]] for x, y in pairs]
        got = [*answers.get(r.chunk, b"")]
        assert len(got) == len(want) and all(g >= w.bit_length() - 1 for g, w in zip(got, want))
        assert sum(g == w.bit_length() - 1 for g, w in zip(got, want) if w) >= 0.8 * sum(w > 0 for w in want)


def test_pairs_seen_once_count(spark):
    """A held-out text of pairs that training has once scores above one of the same words in pairs that it never has."""
    ids = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    learn = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5 != 1][:1]
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(learn[0], " ".join(words)), (ids[0], " ".join(words[:20])), (ids[1], " ".join(words[:20][::-1]))], "doc_id long, text string")
    got = {r.doc_id: r for r in bloomlm.scores(docs).collect()}
    assert got[ids[0]].held_out and got[ids[0]].base_score == pytest.approx(got[ids[1]].base_score)
    assert got[ids[0]].score > got[ids[1]].score + 5
    assert bloomlm.level_counts(np.array([0, 1]), 1).tolist() == [0, 1]


@pytest.mark.parametrize("bits", [3, 24, 61])
def test_repeats_where_packing_has_no_room(spark, monkeypatch, bits):
    """Positions beyond the packed bits, and windows alike in the packed part of their hashes, change nothing."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(quality_rules, "POSITION_BITS", bits)
    texts = [" ".join(map(str, rng.integers(0, span, n))) for span in (2, 5, 9, 40) for n in (1, 4, 8, 11, 60, 300)]

    def brute(t):
        ws = t.split()
        grams = Counter(zip(ws, ws[1:], ws[2:]))
        return len({k + d for k, g in enumerate(zip(ws, ws[1:], ws[2:])) if grams[g] > 1 for d in range(3)})

    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.n for r in df.select("text", quality_rules.repeat_words(quality_rules.words(F.col("text"))).alias("n")).collect()}
    assert got == {t: brute(t) for t in texts}
