import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.llm import decontam
from rasterlake.llm.decontam import Automaton, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(words, items, window):
    hit, names = set(), set()
    for name, own in items:
        n = min(len(own), window)
        if n:
            for k in range(len(own) - n + 1):
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == own[k : k + n]:
                        hit |= set(range(at, at + n))
                        names.add(name)
    return hit, names


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=30), st.integers(1, 5))
def test_automaton(items, text, window):
    named = [(str(k), ws) for k, ws in enumerate(items)]
    spans, names = Automaton(named, window).matches(text)
    hit, want = brute(text, named, window)
    assert {k for a, b in spans for k in range(a, b)} == hit and names == want
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_words():
    text = "Ab-c_D é12\x7fx·y \x00Z"
    assert [w.decode() for w in words_of(text.encode())] == plain_words(text)


def test_documents(spark, odd, none, sample):
    bench = spark.createDataFrame([(7, "quick BROWN fox"), (7, "lazy dog"), (11, "naïve café"), (2, None), (3, "..."), (None, "one two"), (5, "alpha beta gamma delta " * 4)], "item_id long, text string")
    real = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for docs, items in ((odd, bench), (sample, real), (odd, bench.limit(0))):
        own = [("" if r.item_id is None else str(r.item_id), plain_words(r.text)) for r in items.collect()]
        want = []
        for r in docs.collect():
            ws = plain_words(r.text)
            hit, names = brute(ws, own, 10) if len(ws) < 4000 else (set(range(len(ws))) if own else set(), {"5"} if own else set())
            want.append((r.doc_id, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
        got = [tuple(r)[:6] for r in decontam.contamination(docs, items).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert decontam.contamination(none, bench).count() == 0


def test_cleaning(spark):
    passage = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Before it. {passage.upper()}! After it all goes on and on."), (2, passage), (3, "clean text"), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontam.cleaned(docs, bench).collect()}
    assert got == {1: "Before it. ! After it all goes on and on.", 3: "clean text", 4: None, 5: ""}


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5), st.integers(1, 5), st.integers(1, 9))
def test_blocks_hold_all_windows(items, window, most):
    named = [(str(k), ws) for k, ws in enumerate(items)]
    cut = list(decontam.blocks(named, window, most))
    windows = lambda rows: {(i, tuple(ws[k : k + min(len(ws), window)])) for i, ws in rows if ws for k in range(len(ws) - min(len(ws), window) + 1)}
    assert windows([r for b in cut for r in b]) == windows(named)
    assert all(sum(len(ws) for _, ws in b) <= max(most, window) for b in cut)


def test_a_benchmark_of_many_blocks(spark, sample, monkeypatch):
    """Above the size of one automaton the results are the same."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = sorted(map(str, decontam.contamination(sample, bench).collect()))
    clean = sorted(map(str, decontam.cleaned(sample, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert len(decontam.automata(bench).files) > 3
    assert sorted(map(str, decontam.contamination(sample, bench).collect())) == whole
    assert sorted(map(str, decontam.cleaned(sample, bench).collect())) == clean
    assert any("True" in r for r in whole)
