"""Exact token counts by prefix dynamic programming over a byte-pair vocabulary.

A text falls into pre-tokens (by the library's own rule), a pre-token's encoding into a dynamic program over its byte prefixes:
the last token of the encoding of a prefix is the only vocabulary entry ending there that goes together with the last token of
the prefix before it. The program so keeps the exact token count at every prefix; sums over pre-tokens give the count of the
text, and answer budgets and truncations without encoding again. ``prefix_tables`` keeps them as a DataFrame, on which
``tokens_of`` and ``bytes_within`` are plain expressions; counts are those of the library for each prefix as a text of its own.

Defined cases: null and empty texts have zero tokens; a special token's text inside a text counts as that one token (the
library's default); equal texts and ids count alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, quoted, rewrite_text, table

LIMIT = 1024
#: Bound of a worker's memory of pre-token counts and token pairs, in entries; past it the memory starts anew.
MEMORY = 600_000
_SPLIT = re.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at prefixes for a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[as_bytes(a), as_bytes(b)] = k
        special = {t["content"] for t in spec["added_tokens"]}
        made = {a + b for a, b in self.rank}
        self.tokens = {as_bytes(t) for t in spec["model"]["vocab"] if t not in special}
        self.tokens = {t for t in self.tokens if len(t) == 1 or t in made}
        self.tokens = {t for t in self.tokens if self._merge(t) == [t]}
        self.special = sorted(special)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.letters = letters
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[str, int] = {}
        self.odd: set[str] = {""}
        self.prefixes: dict[str, list[int]] = {}

    def _merge(self, raw: bytes) -> list[bytes]:
        """Plain pair merging of a short run of bytes."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, a: bytes, b: bytes) -> bool:
        """Whether encoding a+b gives just a, b: then b may follow a in an encoding."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            known = self.pairs[a, b] = self._merge(a + b) == [a, b]
        return known

    def prefix_counts(self, raw: bytes) -> list[int]:
        """Exact token counts of all byte prefixes of a pre-token, the empty one first."""
        counts: list[int] = [0]
        self._extend(raw, counts, [b""], 0)
        return counts

    def _extend(self, raw: bytes, counts: list[int], last: list[bytes], done: int) -> None:
        """Go on from the prefix of ``done`` bytes, for which ``counts`` and ``last`` are there, to all of ``raw``."""
        tokens, pairs, fits = self.tokens, self.pairs, self._fits
        for end in range(done + 1, len(raw) + 1):
            for start in range(end - 1, -1, -1):
                t = raw[start:end]
                if t in tokens:  # only one entry fits, so the order of trying does not matter
                    if not start:
                        break
                    ok = pairs.get((last[start], t))
                    if ok if ok is not None else fits(last[start], t):
                        break
            else:
                raise AssertionError("a prefix has no encoding")
            counts.append(counts[start] + 1)
            last.append(t)

    def counts_of(self, runs: set[bytes]) -> dict[bytes, int]:
        """Counts of distinct pre-tokens: in sorted order, so that each goes on from the prefix it shares with the one before."""
        out: dict[bytes, int] = {}
        counts, last, before = [0], [b""], b""
        for raw in sorted(runs):
            n = min(len(raw), len(before))
            k = 0
            while k < n and raw[k] == before[k]:
                k += 1
            del counts[k + 1 :], last[k + 1 :]
            self._extend(raw, counts, last, k)
            out[raw] = counts[-1]
            before = raw
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens as the library splits them, in its byte-level letters."""
        return [p for p, _ in self.pre.pre_tokenize_str(text)]

    def _learn(self, parts: set[str]) -> None:
        """Fill the memory with the counts of parts, each standing for itself after a blank."""
        plan, runs = [], set()
        for p in parts:
            if p.isalpha():
                own = [(" " + p).encode()]
                more = 0
            elif p[-1:] in (",", ".") and p[:-1].isalpha():
                own = [(" " + p[:-1]).encode()]
                more = 1  # the mark is a pre-token of one byte
            else:
                own = [bytes(map(self.letters.__getitem__, x)) for x in self.pieces(" " + p)]
                more = 0
            runs.update(own)
            plan.append((p, own, more))
        n = self.counts_of(runs)
        self.counts.update((p, sum(map(n.__getitem__, own)) + more) for p, own, more in plan)

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text."""
        return self.fit_all(texts, None)[0]

    def fit_all(self, texts: list[str | None], budget: int | None) -> tuple[list[int], list[int]]:
        """Tokens of each whole text, and (with a budget) bytes of its longest prefix within it."""
        if len(self.counts) > MEMORY:
            self.counts.clear()
            self.odd = {""}
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        fresh: set[str] = set()
        for k, text in enumerate(texts):
            chunks = [text] if text else []
            for s in self.special:
                if text and s in text:
                    split = [c.split(s) for c in chunks]
                    totals[k] += sum(len(c) - 1 for c in split)
                    chunks = [x for c in split for x in c]
            for chunk in filter(None, chunks):
                # a pre-token always starts at a blank before a visible character
                parts = chunk.split(" ")
                distinct = set(parts[1:])
                new = distinct.difference(self.counts)
                self.odd.update(p for p in new if not p or p[0].isspace())
                if not self.odd.isdisjoint(distinct):
                    parts = _SPLIT.split(chunk)
                    new = set(parts[1:]).difference(self.counts)
                if parts[0]:
                    totals[k] += sum(self.prefix_counts(bytes(map(self.letters.__getitem__, x)))[-1] for x in self.pieces(parts[0]))
                fresh |= new
                held.append((k, parts))
        self._learn(fresh)
        known = self.counts.__getitem__
        firsts = totals.copy() if budget is not None else []
        for k, parts in held:
            totals[k] += sum(map(known, parts[1:]))
        if budget is None:
            return totals, []
        fits = [len(t.encode()) if t else 0 for t in texts]
        of = dict(held)
        for k, n in enumerate(totals):
            if n > budget:
                special = any(s in texts[k] for s in self.special)
                fits[k] = PrefixTable(self, texts[k]).bytes_for(budget) if special else self._cut(of[k], firsts[k], budget)
        return totals, fits

    def fit(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens."""
        return self.fit_all([text], budget)[1][0]

    def _cut(self, parts: list[str], first: int, budget: int) -> int:
        """Bytes of the longest prefix within the budget, of a text in parts (``first``: tokens of the first one) that is over it.

        Sums up to blanks before visible characters never fall, so that it ends in the first part whose sum is over the budget; only
        that part's prefixes are looked at, and the one before where it ends in blanks, which a cut may change."""
        # a part has a token at least
        sums = list(accumulate(map(self.counts.__getitem__, parts[1 : budget + 2]), initial=first))
        at = bisect_right(sums, budget)
        if at and parts[at - 1][-1:].isspace():
            at, end = at - 1, at + 1
        else:
            end = at + 1
        done = sums[at - 1] if at else 0
        size = len(" ".join(parts[:at]).encode()) if at else 0
        return size + PrefixTable(self, (" " if at else "") + " ".join(parts[at:end])).bytes_for(budget - done)

    def count(self, text: str | None) -> int:
        """Tokens of one whole text."""
        return self.count_all([text])[0]

    def prefixes_of(self, name: str) -> list[int]:
        """Counts at the byte prefixes of a piece in the library's letters, kept for pieces that come again."""
        got = self.prefixes.get(name)
        if got is None:
            if len(self.prefixes) > MEMORY // 4:
                self.prefixes.clear()
            got = self.prefixes[name] = self.prefix_counts(bytes(map(self.letters.__getitem__, name)))
        return got

    def sum_of(self, text: str) -> int:
        """Tokens of a short text without special tokens."""
        return sum(self.prefixes_of(p)[-1] for p in self.pieces(text))

    def table(self, text: str) -> PrefixTable:
        """The counts at every prefix of a text, for budgets and truncations."""
        return PrefixTable(self, text)


class PrefixTable:
    """Exact token counts of every prefix of one text that ends with a character; between a character's bytes its start's count."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text.encode("utf-8", "surrogatepass")
        self.at, self.whole = [0], 0  # counts of prefixes; tokens of the pieces so far, as the whole text has them
        pattern = "|".join(map(re.escape, counter.special))
        last = ""  # the piece before a special token, which a part of that token may go on
        for chunk in re.split(f"({pattern})", text) if pattern else [text]:
            if chunk in counter.special:
                before = self.whole - counter.sum_of(last)
                self.whole += 1
                self._add(chunk, [*[before + counter.sum_of(last + chunk[:k]) for k in range(1, len(chunk))], self.whole])
                last = ""
            elif chunk:
                last = self._chunk(chunk)

    def _add(self, part: str, counts: list[int]) -> None:
        """Counts at the characters' ends of the next part."""
        for c, n in zip(part, counts):
            self.at += [self.at[-1]] * (len(c.encode("utf-8", "surrogatepass")) - 1) + [n]

    def _chunk(self, chunk: str) -> str:
        """Go through a chunk's pieces; the last one. Where a cut changes the split (in contractions, after blanks), the tail is split anew."""
        counter, before = self.counter, ""
        for name, (a, b) in counter.pre.pre_tokenize_str(chunk):
            piece, own, counts, size = chunk[a:b], counter.prefixes_of(name), [], 0
            for k, c in enumerate(piece, 1):
                size += len(c.encode("utf-8", "surrogatepass"))
                if before.isspace() and piece[:k].isspace():
                    counts.append(self.whole - counter.sum_of(before) + counter.sum_of(before + piece[:k]))
                elif 1 < k < len(piece) and piece[0] == "'":
                    counts.append(self.whole + counter.sum_of(piece[:k]))
                else:
                    counts.append(self.whole + own[size])
            self._add(piece, counts)
            self.whole += own[-1]
            before = piece
        return before

    def tokens(self, n_bytes: int | None = None) -> int:
        """Tokens of the first ``n_bytes`` (default: all)."""
        return self.at[-1 if n_bytes is None else n_bytes]

    def bytes_for(self, budget: int) -> int:
        """Bytes of the longest prefix of at most ``budget`` tokens that ends with a character."""
        n = len(self.text)
        while self.at[n] > budget or (n < len(self.text) and self.text[n] & 0xC0 == 0x80):
            n -= 1
        return n

    def longest_within(self, budget: int) -> str:
        return self.text[: self.bytes_for(budget)].decode("utf-8", "surrogatepass")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_bytes``, the bytes of its longest prefix within the limit."""
    id_type = dict(docs.dtypes)[id_col]

    def make():
        counter = PrefixCounter(path)

        def work(texts):
            tokens, fit = counter.fit_all(texts, limit)
            sizes = [len(t.encode()) if t else 0 for t in texts]
            return {"n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > limit for n in tokens], "fit_bytes": fit}

        return work

    return per_text(docs, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long", make, id_col, text_col, decode=True)


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``counts``, the exact tokens of its prefixes by their bytes (0 to all of them). To be stored once and asked often."""
    id_type = dict(docs.dtypes)[id_col]

    def make():
        counter = PrefixCounter(path)
        return lambda texts: {"counts": pa.array([counter.table(t or "").at for t in texts], pa.list_(pa.int32()))}

    return per_text(docs, f"`{id_col}` {id_type}, counts array<int>", make, id_col, text_col, decode=True, rows=32)


def tokens_of(n_bytes: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first ``n_bytes``, from a stored table; null beyond the text."""
    return F.get(quoted(counts), n_bytes if isinstance(n_bytes, Column) else F.lit(n_bytes))


def bytes_within(budget: Column | int, counts: str = "counts") -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens, from a stored table (bytes inside a character count as its start)."""
    most = budget if isinstance(budget, Column) else F.lit(budget)
    within = F.transform(F.col(quoted(counts)), lambda c, i: F.when(c <= most, i))
    return F.array_max(within)


def truncated(docs: DataFrame, path: str, budget: int = LIMIT) -> DataFrame:
    """The documents, texts cut to their longest prefixes of at most ``budget`` tokens that end with a character."""

    def make():
        counter = PrefixCounter(path)

        def work(texts):
            return [t.encode()[:size].decode() if n > budget else t for t, n, size in zip(texts, *counter.fit_all(texts, budget))]

        return work

    return rewrite_text(docs, make)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with the 50k byte-level vocabulary."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
