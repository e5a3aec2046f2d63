"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels words (begin/inside of a kind, or outside) from what they are made of, from the words before and after them, and
from the labels beside them. It is trained on the driver from a small labelled table (made by ``training_table``; any table of
words and labels will do), by gradient steps over padded batches, and decoded by Viterbi in numpy batches. Words that lie more
than ``REACH`` words away from any word with a digit, ``@`` or ``=`` are outside by the field's definition, so that decoding runs
over the stretches between them; all others, plain words too, have learned scores.
Spans that the field finds and that touch no pattern's span are added; the patterns' spans stay.

Spans are ``kind:start:end``, in code points, end exclusive. Defined cases: null and empty texts have no spans; rows are
independent, equal ids and texts included; an empty table gives no rows; extra columns are ignored or (redaction) carried.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import per_text, rewrite_text, table

#: Fixed patterns and limits of the base kinds.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: The contract's pattern, begun at a run of digits' start only and without giving digits back: the same matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: All bytes but those that make a word worth decoding.
DULL = bytes(b for b in range(256) if b not in b"0123456789@=")
WORD = re.compile(r"\S+")
TELLING = re.compile(r"[0-9@=]")
#: Marks that are no part of data at its ends.
SEPARATE = ".,;:!?#*$%&|<>"
#: Words around a telling word that the field labels too.
REACH = 2
#: Times that a feature has to be seen in training.
SEEN = 3


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@`` and a domain, found from each ``@``."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d)
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind, then start."""
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def shape(word: str) -> str:
    """Letters to a/A, digits to 9, runs shortened, other characters as they are; of the whole word."""
    out = []
    for c in word:
        s = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def core_of(word: str) -> str:
    return word.strip(".,;:!?\"'()[]<>|").lower()


def features(word: str) -> list[str]:
    """Names of a word's own features: for plain words the word, for others shape, its ends, sizes, and what it is made of."""
    if not TELLING.search(word):
        return ["plain", f"word={core_of(word)}", f"stop={word[-1:] in '.!?'}"]
    core = word.strip(SEPARATE)
    n = sum("0" <= c <= "9" for c in core)
    s = shape(core)
    kinds = [
        "telling", f"shape={s[:12]}", f"first={s[:1]}", f"last={s[-1:]}", f"digits={min(n, 20)}", f"length={min(len(core), 24) // 3}",
        f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 3)}", f"at={'@' in core}", f"equals={'=' in core}", f"quote={'\"' in core}",
    ]
    hexed = core.rsplit("=", 1)[-1].strip("\"'")
    kinds.append(f"hex={len(hexed) >= 12 and all(c in '0123456789abcdefABCDEF' for c in hexed) and not hexed.isdigit()}")
    kinds.append(f"alldigits={core.isdigit()}")
    bare = core.replace("-", "")
    if 16 <= len(bare) <= 19 and bare.isascii() and bare.isdigit():
        kinds.append(f"luhn={luhn(bare)}")
    if core.count(".") == 3 and all(p.isascii() and p.isdigit() and len(p) < 4 for p in core.split(".")):
        kinds.append(f"quad={all(int(p) <= 255 for p in core.split('.'))}")
    return kinds


def beside(word: str | None) -> str:
    """What a word's neighbour sees of it: the plain word, or the shape of another; a mark at a text's ends."""
    if word is None:
        return "|"
    return f"~{shape(word)[:6]}" if TELLING.search(word) else core_of(word)


def _names(words: list[str], t: int) -> list[str]:
    """All features of the word at ``t``."""
    before, after = words[t - 1] if t else None, words[t + 1] if t + 1 < len(words) else None
    return [*features(words[t]), f"prev={beside(before)}", f"next={beside(after)}"]


#: Words of the training table that go before data of a kind, and before harmless numbers.
CUES = {
    "email": ("mail", "email", "contact", "write"), "ip": ("server", "host", "ip", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("call", "tel", "phone", "fax", "mobile"), "secret": ("token", "password", "key", "secret", "api_key"), "none": ("page", "year", "order", "room", "version", "isbn", "total", "commit", "section"),
}


def training_table(n: int = 1200, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: made-up sentences with personal data of each kind, and with harmless numbers."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card(valid: bool) -> str:
        while luhn(d := digits(16)) != valid:
            pass
        return d

    def item() -> tuple[list[str], list[str]]:
        """Words and labels; a cue before them more often than not, and where nothing else tells."""
        kind = rng.choice(("email", "ip", "card", "phone", "secret", "none", "none", "none"))
        cue = rng.choice(CUES[kind]) + rng.choice(("", "", ":"))
        led = rng.random() < 0.6
        if kind == "email":
            got = [f"{letters(rng.randint(3, 9))}{rng.choice(('.', '_', '', '-'))}{digits(rng.randint(0, 3))}@{letters(5)}{digits(rng.randint(0, 1))}.{letters(6)}.{rng.choice(('com', 'org', 'de'))}"]
        elif kind == "ip":
            got = [".".join(str(rng.randint(0, 255)) for _ in range(4))]
        elif kind == "card":
            d = card(True)
            got = rng.choice(([d], [d], [d[i : i + 4] for i in range(0, 16, 4)], ["-".join(d[i : i + 4] for i in range(0, 16, 4))]))
        elif kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            got = rng.choice(([f"+{rng.randint(1, 99)}", f"({a})", f"{b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{rng.randint(1, 99)}", a, b, c], [f"{a}.{b}.{c}"], [f"{b}{c}"]))
            led = led or len(got) == 1 and "-" not in got[0]
            if rng.random() < 0.2:
                got += ["ext", digits(2)]
        elif kind == "secret":
            key = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 18, 24, 32, 40))))
            key = key.upper() if rng.random() < 0.2 else key
            form = rng.choice(("joined", "apart", "apart", "named", "bare"))
            if form == "joined":
                got = [f"{rng.choice(CUES['secret'])}={key}"]
            elif form == "named":
                got = [f"{letters(5)}={key}"]
            elif form == "apart":
                return [cue.rstrip(":"), rng.choice("=:"), f'"{key}"'], ["O", "O", "B-secret"]
            else:
                got, led = [key], True
        else:
            hexed = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((16, 32, 40))))
            got = rng.choice((
                [digits(rng.randint(1, 6))], [f"{rng.randint(1900, 2100)}"], [f"{digits(1)}.{digits(1)}"], [f"{digits(2)}:{digits(2)}"], [f"{digits(2)}-{digits(2)}-{rng.randint(1900, 2100)}"], [f"{letters(3)}{digits(2)}"], [f"{digits(3)}%"], [f"(c){rng.randint(1900, 2100)}"], ["="], [f"{letters(3)}=5"],
                [f"{digits(2)}.{digits(2)}"], [f"{digits(1)},{digits(3)},{digits(3)}"], [f"x={letters(4)}"], [f"@{letters(5)}"], [f"v{digits(1)}.{digits(1)}.{digits(1)}"], [f"{digits(2)}", f"{digits(2)}", f"{digits(3)}"], [card(False)], [digits(rng.randint(7, 15))], [hexed], ["=", f'"{letters(6)}"'],
            ))
            if got[0] == hexed:
                led, cue = True, "commit"
        labels = ["O"] * len(got) if kind == "none" else [f"{'I' if k else 'B'}-{kind}" for k in range(len(got))]
        return ([cue, *got], ["O", *labels]) if led else (got, labels)

    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(1, 3)):
            filler = [rng.choice(sum(CUES.values(), ())) if rng.random() < 0.1 else letters(rng.randint(2, 9)) for _ in range(rng.choice((0, 1, 1, 2, 3, 5)))]
            filler = [w + rng.choice(".,") if rng.random() < 0.2 else w for w in filler]
            if filler and core_of(filler[-1]) in sum(CUES.values(), ()):
                filler.append(letters(5))  # a cue belongs to its own data
            words += filler
            labels += ["O"] * len(filler)
            got, own = item()
            if rng.random() < 0.25:
                got = [*got[:-1], got[-1] + rng.choice((".", ",", ";", "###", "!!", "$$$"))]
            words += got
            labels += own
        rows.append((words, labels))
    return rows


class Field:
    """A linear-chain conditional random field over word features."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.2, shrink: float = 1e-3):
        label_of = {x: i for i, x in enumerate(LABELS)}
        named = [[_names(ws, t) for t in range(len(ws))] for ws, _ in rows]
        seen = Counter(f for ws in named for fs in ws for f in fs)
        self.index: dict[str, int] = {f: k for k, f in enumerate(f for f, c in seen.items() if c >= SEEN)}
        coded = [[[self.index[f] for f in fs if f in self.index] for fs in ws] for ws in named]
        n, longest, k, m = len(rows), max(len(ws) for ws, _ in rows), len(LABELS), len(self.index)
        gold = np.zeros((n, longest), int)
        real = np.zeros((n, longest), bool)
        for i, (_, labels) in enumerate(rows):
            gold[i, : len(labels)], real[i, : len(labels)] = [label_of[x] for x in labels], True
        # the words' features one after the other, and the word of each
        flat = np.array([f for ws in coded for fs in ws for f in fs])
        sizes = np.array([len(fs) for ws in coded for fs in ws])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        emit, step = np.zeros((m, k)), np.zeros((k, k))
        is_gold = np.eye(k)[gold] * real[..., None]
        both = real[:, 1:] & real[:, :-1]
        pairs = np.einsum("nta,ntb->ab", is_gold[:, :-1] * both[..., None], is_gold[:, 1:])
        state = [(np.zeros_like(x), np.zeros_like(x)) for x in (emit, step)]
        for turn in range(1, steps + 1):
            score = np.zeros((n, longest, k))
            score[real] = np.stack([np.bincount(owner, emit[flat, j], len(sizes)) for j in range(k)], axis=1)
            # forward and backward, each place scaled to one
            local, move = np.exp(score - score.max(axis=2, keepdims=True)), np.exp(step - step.max())
            ahead, back, scale = np.empty_like(local), np.ones_like(local), np.ones((n, longest, 1))
            for t in range(longest):
                go = local[:, t] if t == 0 else (ahead[:, t - 1] @ move) * local[:, t]
                total = go.sum(axis=1, keepdims=True)
                ahead[:, t] = np.where(real[:, t, None], go / total, ahead[:, t - 1])
                scale[:, t] = np.where(real[:, t, None], total, 1.0)
            for t in range(longest - 2, -1, -1):
                back[:, t] = np.where(real[:, t + 1, None], (back[:, t + 1] * local[:, t + 1]) @ move.T / scale[:, t + 1], 1.0)
            node = ahead * back * real[..., None]
            later = back[:, 1:] * local[:, 1:] / scale[:, 1:] * both[..., None]
            edge = np.einsum("nta,ntb->ab", ahead[:, :-1], later, optimize=True) * move
            miss = (is_gold - node)[real]
            grads = (np.stack([np.bincount(flat, miss[owner, j], m) for j in range(k)], axis=1) / n - shrink * emit, (pairs - edge) / n - shrink * step)
            for x, g, (a, b) in zip((emit, step), grads, state):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x += rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.99**turn)) + 1e-8)
        # an inside label only goes on with its own kind
        for i, a in enumerate(LABELS):
            for j, b in enumerate(LABELS):
                if b[0] == "I" and a[2:] != b[2:]:
                    step[i, j] = -1e4
        self.emit, self.step = emit, step
        self._forget()

    def _forget(self) -> None:
        self.memory: dict[str | None, int] = {}
        self.parts: list[np.ndarray] = []

    def _part(self, word: str | None) -> int:
        """The number of a word's scores: its own, and those that it gives to the word after and before it."""
        k = self.memory.get(word)
        if k is None:
            k = self.memory[word] = len(self.parts)
            names = (features(word) if word is not None else [], [f"prev={beside(word)}"], [f"next={beside(word)}"])
            self.parts.append(np.stack([self.emit[[self.index[f] for f in fs if f in self.index]].sum(axis=0) for fs in names]))
        return k

    def scores(self, words: list[str], before: str | None = None, after: str | None = None) -> np.ndarray:
        """Label scores of words in a row, between the words ``before`` and ``after`` (None: a text's end)."""
        ids = [self._part(w) for w in (before, *words, after)]
        got = np.stack([self.parts[k] for k in ids])
        return got[1:-1, 0] + got[:-2, 1] + got[2:, 2]

    def decode(self, runs: list[list[str]], ends: list[tuple[str | None, str | None]] | None = None) -> list[np.ndarray]:
        """Best labels of each run of words (outside words stand before and after it: ``ends``), by Viterbi over padded batches."""
        ends = ends or [(None, None)] * len(runs)
        if len(self.memory) > 50_000:
            self._forget()
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        order = sorted((i for i in range(len(runs)) if runs[i]), key=lambda i: len(runs[i]))
        at = 0
        while at < len(order):
            to, longest = at + 1, len(runs[order[at]])
            while to < len(order) and len(runs[order[to]]) <= max(8, 2 * longest) and (to - at) * len(runs[order[to]]) < 200_000:
                to += 1
            some = order[at:to]
            at = to
            n, longest, k = len(some), len(runs[some[-1]]), len(LABELS)
            score = np.full((n, longest, k), -1e6)
            score[:, :, 0] = 0  # past a run's end all is outside
            for r, i in enumerate(some):
                score[r, : len(runs[i])] = self.scores(runs[i], *ends[i])
            best = score[:, 0] + self.step[0]
            came = np.zeros((n, longest, k), np.int8)
            for t in range(1, longest):
                go = best[:, :, None] + self.step
                came[:, t] = go.argmax(axis=1)
                best = go.max(axis=1) + score[:, t]
            path = np.zeros((n, longest), int)
            path[:, -1] = (best + self.step[:, 0]).argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                path[:, t - 1] = came[np.arange(n), t, path[:, t]]
            for r, i in enumerate(some):
                out[i] = path[r, : len(runs[i])]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """The field's spans in each whole text, outer marks of punctuation left out."""
        runs, ends, places = [], [], []
        for k, text in enumerate(texts):
            if not text or not text.encode("utf-8", "surrogatepass").translate(None, DULL):
                continue
            at = np.array([m.span() for m in WORD.finditer(text)])
            telling = np.unique(np.searchsorted(at[:, 0], [m.start() for m in TELLING.finditer(text)], side="right") - 1)
            near = np.zeros(len(at) + 2 * REACH + 1, np.int8)
            np.add.at(near, telling, 1)
            np.add.at(near, telling + 2 * REACH + 1, -1)
            near = np.cumsum(near)[REACH : REACH + len(at)] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0])))).reshape(-1, 2)
            word = lambda i: text[at[i, 0] : at[i, 1]] if 0 <= i < len(at) else None  # noqa: B023, E731
            for a, b in edges.tolist():
                place = at[a:b].tolist()
                runs.append([text[x:y] for x, y in place])
                ends.append((word(a - 1), word(b)))
                places.append((k, place))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for (k, place), path in zip(places, self.decode(runs, ends)):
            open_ = None
            for (start, end), code in [*zip(place, path.tolist()), ((0, 0), 0)]:
                label = LABELS[code]
                if open_ and not (label[0] == "I" and label[2:] == open_[0]):
                    kind, a, b = open_
                    text = texts[k]
                    while a < b and text[a] in "\"'([" + SEPARATE:
                        if text[a] == "(" and kind == "phone":
                            break
                        a += 1
                    while a < b and text[b - 1] in "\"')]" + SEPARATE:
                        b -= 1
                    if a < b:
                        out[k].append((kind, a, b))
                    open_ = None
                if label[0] == "B" or (label[0] == "I" and not open_):
                    open_ = (label[2:], start, end)
                elif label[0] == "I":
                    open_ = (open_[0], open_[1], end)
        return out


def trained(rows: list[tuple[list[str], list[str]]] | None = None) -> Field:
    return Field(rows or training_table())


def _all_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    free = [s for s in more if all(s[2] <= b[1] or b[2] <= s[1] for b in base)] if base else more
    return sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def _digest_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per text: counts of base kinds, digest of base spans, and all spans."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())
    id_type = dict(docs.dtypes)[id_col]

    def make():
        model = held.value

        def work(texts):
            out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
            for text, more in zip(texts, model.spans(texts)):
                base = base_spans(text or "")
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_digest_of(base).encode()).hexdigest())
                out["spans"].append(_digest_of(_all_spans(base, more)))
            return out

        return work

    schema = f"`{id_col}` {id_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return per_text(docs, schema, make, id_col, text_col, decode=True)


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    held = docs.sparkSession.sparkContext.broadcast(field or trained())

    def make():
        model = held.value

        def work(texts):
            out = []
            for text, more in zip(texts, model.spans(texts)):
                spans = sorted(_all_spans(base_spans(text or ""), more), key=lambda s: (s[1], -s[2]))
                parts, at = [], 0
                for kind, a, b in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = max(at, b)
                out.append("".join([*parts, text[at:]]) if spans else text)
            return out

        return work

    return rewrite_text(docs, make)


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
