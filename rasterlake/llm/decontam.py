"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton holds every run of words of every item. A document's words are streamed through it; the longest matching length at
each word tells which windows end there (ten words of an item in a row, or the whole of a shorter item). Words inside any
occurring window are hit. Cleaning removes the hit spans, and drops texts of which too large a part is hit.

Texts are lower-cased (A-Z); words are runs of ASCII letters, digits and all characters beyond ASCII.

Defined cases: null, empty and blank texts have no words and no hits; items without words never occur; items with equal ids are
one item; rows of documents are independent, equal ids included; an empty table of items hits nothing. Other columns are ignored.
The automaton is broadcast. Items of over ``BLOCK_WORDS`` words together are cut into blocks, each with an automaton of its own in
the shared folder; a task loads one after the other for each batch of texts and unites their hits. Longer items are cut into
pieces that overlap by a window less a word, so that no window is lost.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_text, rewrite_text, table

WINDOW = 10
#: Words in one automaton.
BLOCK_WORDS = 500_000
_KEPT = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes to lower-cased bytes, and to a blank where no word goes on.
FOLD = bytes((c if c in _KEPT else 0x20) for c in bytes(range(256)).lower())


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows of items marked at their states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for name, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.marks: list[dict[int, set[str]] | None] = [None] * len(self.length)
        self.shortest = min((min(len(ws), window) for _, ws in coded), default=0)
        for name, ws in coded:
            n = min(len(ws), window)
            state, matched = 0, 0
            for at, w in enumerate(ws):
                state, matched = self.next[state][w], matched + 1
                while self.length[self.link[state]] >= n if self.link[state] >= 0 else False:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if at + 1 >= n:
                    held = self.marks[state] = self.marks[state] or {}
                    held.setdefault(n, set()).add(name)
        #: The nearest marked state up the suffix links, itself included; -1 for none.
        self.marked = [-1] * len(self.length)
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.marked[s] = s if self.marks[s] else (self.marked[self.link[s]] if s else -1)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (first word, last word + 1; disjoint, in order) of hit words, and the items with occurring windows."""
        items: set[str] = set()
        spans: list[list[int]] = []
        n = len(words)
        if not self.shortest or n < self.shortest:
            return [], items
        known = self.vocabulary
        codes = np.fromiter(map(known.get, words, [-1] * n), np.int64, n)
        edges = np.nonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))[0]
        runs = edges.reshape(-1, 2)
        nxt, link, length, marked, marks = self.next, self.link, self.length, self.marked, self.marks
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.shortest].tolist():
            state = matched = 0
            for at, w in enumerate(codes[a:b].tolist(), a):
                while True:
                    to = nxt[state].get(w)
                    if to is not None:
                        state = to
                        matched += 1
                        break
                    if not state:
                        matched = 0
                        break
                    state = link[state]
                    matched = length[state]
                m = marked[state]
                while m >= 0:
                    for size, names in marks[m].items():
                        if size <= matched:
                            items |= names
                            start = at + 1 - size
                            while spans and spans[-1][0] >= start:
                                spans.pop()
                            if spans and spans[-1][1] >= start:
                                spans[-1][1] = at + 1
                            else:
                                spans.append([start, at + 1])
                    m = marked[link[m]] if m else -1
        return [(a, b) for a, b in spans], items


def blocks(items: Iterable[tuple[str, list[bytes]]], window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``most`` words, longer items in overlapping pieces; one empty block if there are none."""
    most = max(most, window)
    block, size = [], 0
    for name, words in items:
        for at in range(0, max(len(words) - window, 0) + 1, most - window + 1):
            piece = words[at : at + most]
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    yield block


class Automata:
    """One automaton, or the files of several, whose hits are united."""

    def __init__(self, only: Automaton | None, folder: str = "", files: tuple[str, ...] = ()):
        self.only, self.folder, self.files = only, folder, files

    def matches(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Spans and items of each text, as ``Automaton.matches`` has them."""
        if self.only:
            return [self.only.matches(words) for words in texts]
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.folder)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        for file in self.files:
            with system.open_input_stream(f"{base}/{file}") as f:
                one = pickle.loads(f.read())
            for k, words in enumerate(texts):
                found, names = one.matches(words)
                spans[k] += found
                items[k] |= names
            del one
        return [(united(s), i) for s, i in zip(spans, items)]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> Automata:
    """Stream the items to the driver and build their automata there, one block at a time."""
    rows = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).toLocalIterator()
    parts = blocks((("" if i is None else i, words_of(bytes(t) if t is not None else None)) for i, t in rows), window, BLOCK_WORDS)
    block, after = next(parts), next(parts, None)
    if after is None:
        return Automata(Automaton(block, window))
    from pyarrow import fs

    folder = fresh(items.sparkSession, "automata")
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    files: list[str] = []
    while block is not None:
        files.append(f"{len(files)}.pickle")
        with system.open_output_stream(f"{base}/{files[-1]}") as f:
            f.write(pickle.dumps(Automaton(block, window), pickle.HIGHEST_PROTOCOL))
        block, after = after, next(parts, None)
    return Automata(None, folder, tuple(files))


def _slice_rows(found: Automata) -> int:
    """Texts that are searched at once: whole batches where automata have to be loaded for them."""
    return 512 if found.only else 1 << 30


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, hit words, items with occurring windows (number, digest of their sorted ids), and hit spans in words."""
    made = automata(items)
    held = docs.sparkSession.sparkContext.broadcast(made)
    id_type = dict(docs.dtypes)[id_col]

    def make():
        found = held.value

        def work(texts):
            out = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
            split = [words_of(raw) for raw in texts]
            for words, (spans, names) in zip(split, found.matches(split)):
                hit = sum(b - a for a, b in spans)
                for k, v in zip(out, (len(words), hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), hit > 0, ",".join(f"{a}:{b}" for a, b in spans))):
                    out[k].append(v)
            return out

        return work

    schema = f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    return per_text(docs, schema, make, id_col, text_col, rows=_slice_rows(made))


def cleaned(docs: DataFrame, items: DataFrame, min_span: int = 1, max_coverage: float = 0.8) -> DataFrame:
    """Documents without their hit spans of ``min_span`` words or more; those with over ``max_coverage`` of their words hit go."""
    made = automata(items)
    held = docs.sparkSession.sparkContext.broadcast(made)

    def make():
        found = held.value

        def one(text, words, spans):
            spans = [(a, b) for a, b in spans if b - a >= min_span]
            if not spans:
                return text
            raw = text.encode("utf-8", "surrogatepass")
            folded = raw.translate(FOLD)
            if sum(b - a for a, b in spans) > max_coverage * len(words):
                return False
            starts, at = [], 0
            for w in words:
                at = folded.index(w, at)
                starts.append(at)
                at += len(w)
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at : starts[a]])
                at = starts[b - 1] + len(words[b - 1])
            return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")

        def work(texts):
            split = [words_of(t.encode("utf-8", "surrogatepass") if t else None) for t in texts]
            return [one(t, words, spans) for t, words, (spans, _) in zip(texts, split, found.matches(split))]

        return work

    return rewrite_text(docs, make, rows=_slice_rows(made))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all of ``benchmark``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH items AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs),
runs AS (SELECT rid, i, n, array_to_string(ws[i : i + n - 1], ' ') AS w FROM pos, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(ws)),
hits AS (SELECT rid, i, n, item FROM runs JOIN win USING (n, w)),
cover AS (SELECT DISTINCT rid, unnest(range(i, i + n)) AS p FROM hits),
island AS (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM cover),
span AS (SELECT rid, min(p) - 1 AS a, max(p) AS b, count(*) AS c FROM island GROUP BY rid, g),
found AS (SELECT rid, sum(c)::BIGINT AS n_hit, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM span GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (rid) LEFT JOIN named USING (rid)
"""
