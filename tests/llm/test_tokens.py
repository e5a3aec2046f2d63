import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterlake.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = tokencount.PrefixCounter(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abe st'rvmld .,!\n\t  é日1#<|>")), max_size=40))
def test_counts_as_the_library(text):
    assert COUNTER.count(text) == count(text)


@pytest.mark.parametrize("text", ["", "a  b \n c", "  lead", "x<|endoftext|> y  ", "<|endoftext|><|endoftext|>", "don't we'll 's '''s", "a\n \nb", "\x1c \x85 b　c", "😀😀 é", "x" * 500])
def test_special_cases(text):
    assert COUNTER.count(text) == count(text)


def test_prefixes_and_budgets():
    text = "The end of the story, don't forget it! 12345 tokens 日本"
    table = COUNTER.table(text)
    assert table.tokens() == count(text)
    for piece in COUNTER.pieces(text):
        raw = bytes(COUNTER.letters[c] for c in piece)
        for n, c in enumerate(COUNTER.prefix_counts(raw)):
            assert c == len(COUNTER._merge(raw[:n])) if n else c == 0
    for budget in range(table.tokens() + 2):
        check_budget(text, budget)


def check_budget(text, budget):
    """Against the library on every prefix."""
    fits = [k for k in range(len(text) + 1) if count(text[:k]) <= budget]
    assert COUNTER.table(text).longest_within(budget) == text[: max(fits)]
    assert COUNTER.fit(text, budget) == len(text[: max(fits)].encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "be", " ", "  ", "\n", "\t", "don't", "'re", "we'll", "'v", "'", "é", "日本", "12", "345", "##", "!", "<|endoftext|>", "<|end", "the", " story", "😀", "\u3000"]), max_size=14).map("".join))
def test_every_prefix_counts_as_the_library(text):
    table = COUNTER.table(text)
    assert [table.at[len(text[:k].encode())] for k in range(len(text) + 1)] == [count(text[:k]) for k in range(len(text) + 1)]
    assert len(table.at) == len(text.encode()) + 1
    for budget in (0, 1, 3):
        check_budget(text, budget)


def test_stored_tables(spark, odd, none, sample):
    """Tables as a DataFrame answer for prefixes and budgets; texts are cut alike."""
    few = sample.where("n_chars < 1500").limit(12).unionByName(odd.where("doc_id <> 6 or doc_id is null").select(sample.columns))
    got = tokencount.prefix_tables(few, PATH).select("doc_id", "counts", tokencount.tokens_of(40).alias("forty"), tokencount.bytes_within(5).alias("five"), tokencount.bytes_within(10**6).alias("all"))
    want = []
    for r in few.collect():
        text = r.text or ""
        raw = text.encode()
        chars = [len(text[:k].encode()) for k in range(len(text) + 1)]
        at = {b: count(raw[:b].decode()) for b in chars if b <= 200}
        start = max(b for b in chars if b <= 40)
        within = max(b for b in chars if b <= 200 and at[b] <= 5)
        after = min([b for b in chars if b > within], default=len(raw) + 1)
        want.append((str(r.doc_id), len(raw) + 1, count(text), at[start] if len(raw) >= 40 else None, after - 1, len(raw)))
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), len(r.counts), r.counts[-1], r.forty, r.five, r["all"])) for r in got.collect())
    cut = tokencount.truncated(few, PATH, 7)
    assert cut.columns == few.columns and all(count(r.text or "") <= 7 for r in cut.collect())
    assert sorted(str(r.doc_id) for r in cut.collect()) == sorted(str(r.doc_id) for r in few.collect())
    assert tokencount.prefix_tables(none, PATH).count() == 0 and tokencount.truncated(none, PATH).count() == 0


def test_documents(odd, none, sample):
    for docs in (odd, sample):
        got = tokencount.token_counts(docs, PATH).drop("fit_bytes").collect()
        want = [(r.doc_id, len((r.text or "").encode()), count(r.text or ""), count(r.text or "") > 1024) for r in docs.collect()]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert tokencount.token_counts(none, PATH).count() == 0
    for r in tokencount.token_counts(sample, PATH, 100).where("over_limit").join(sample, "doc_id").limit(40).collect():
        cut = r.text.encode()[: r.fit_bytes].decode()
        assert count(cut) <= 100 < min(count(r.text[: len(cut) + k]) for k in range(1, 40))
