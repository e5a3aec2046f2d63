import math
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from rasterlake.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = lattice.Pieces(PATH)


def all_segmentations(text):
    """Every segmentation and its probability, by walking all paths over the vocabulary."""
    words = lattice.words_of(text)
    grid = lattice.Lattice(PIECES, words)
    found = [((), 0.0)]
    for w in range(len(words)):
        paths = []

        def walk(at, ids, log):
            if grid.left[at] == 0:
                paths.append((ids, log))
                return
            for e in range(grid.first[at], grid.first[at + 1]):
                walk(grid.dst[e], (*ids, int(grid.ident[e])), log + grid.log[e])

        walk(grid.start[w], (), 0.0)
        total = math.log(sum(math.exp(x) for _, x in paths))
        found = [(a + b, x + y - total) for a, x in found for b, y in paths]
    return dict(found)


def test_samples_follow_the_lattice():
    text = "hello a"
    chances = {k: math.exp(v) for k, v in all_segmentations(text).items()}
    assert sum(chances.values()) == pytest.approx(1)
    sampler = lattice.Sampler(PIECES, 2)
    n = 12000
    got = [s for at in range(0, n, 500) for s in sampler.many(list(range(at, at + 500)), [text] * 500)]
    first = Counter(tuple(s[0][0].tolist()) for s in got)
    both = Counter(tuple(tuple(x[0].tolist()) for x in s) for s in got)
    for a, p in chances.items():
        assert abs(first[a] / n - p) < 0.02
        for b, q in chances.items():
            if a != b:
                assert abs(both[a, b] / n - p * q / (1 - p)) < 0.02
    for s in got[:200]:
        assert s[0][2] >= s[1][2]
        for ids, log, _, _ in s:
            assert log == pytest.approx(math.log(chances[tuple(ids.tolist())]), abs=1e-4)


def test_all_of_a_small_text_without_repeats():
    text = "abc"
    chances = all_segmentations(text)
    got = lattice.Sampler(PIECES, len(chances) + 5).many([1], [text])[0]
    assert {tuple(s[0].tolist()) for s in got} == set(chances) and len(got) == len(chances)
    assert all(s[3] == 0.0 for s in got)  # all are included for sure


@pytest.mark.parametrize("text", ["", "a", "  x  y ", "\n\n", "日本語😀 ᚠᚢᚦ x" * 4, "x" * 400, "ᚠ" * 300, " ", "tab\tand\x00nul"])
def test_decoding_gives_the_text_back(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for ids, *_ in lattice.Sampler(PIECES, 3).many([9], [text])[0]:
        assert PIECES.decode(ids) == text == (model.decode(ids.tolist()) if "\x00" not in text else text)


def test_words_known_before_change_nothing(monkeypatch):
    texts = [f"some words {k} and more of the same words" for k in range(30)]
    want = [[s[0].tolist() for s in x] for x in lattice.Sampler(PIECES, 2).many(list(range(30)), texts)]
    monkeypatch.setattr(lattice.Growing, "NODES", 60)
    monkeypatch.setattr(lattice.Growing, "EDGES", 240)
    small = lattice.Sampler(PIECES, 2)
    assert [[s[0].tolist() for s in small.many([k], [t])[0]] for k, t in enumerate(texts)] == want


def test_documents(odd, none, sample):
    for docs in (odd, sample):
        got = lattice.sampled(docs, PATH)
        rows = got.collect()
        assert all(r.decodes and len(r.ids) == r.n_pieces for r in rows)
        texts = Counter((r.doc_id, (r.text or "")) for r in docs.collect())
        back = Counter((r.doc_id, PIECES.decode(r.ids)) for r in rows if r.sample == 0)
        assert texts == back
        pairs = Counter((r.doc_id, tuple(r.ids)) for r in rows)
        assert max(pairs.values()) <= max(texts.values()) + sum(v > 1 for v in texts.values())
    assert lattice.sampled(none, PATH).count() == 0
    text = {(r.doc_id, r.text) for r in lattice.decoded(lattice.sampled(sample.limit(5), PATH), PATH).collect()}
    assert text == {(r.doc_id, r.text) for r in sample.limit(5).collect()}
