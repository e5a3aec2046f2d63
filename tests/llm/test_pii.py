import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rasterlake.llm import pii

FIELD = pii.trained()
#: The contract's patterns as they are written there.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checks(kind, text):
    """The contract's conditions on a match."""
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def oracle(text):
    """Base spans from the patterns alone."""
    return [(kind, *m.span()) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if checks(kind, m.group())]


def merged(text, more):
    """All spans of a text: the field's that touch no base span are added; by kind, then start."""
    base = oracle(text)
    taken = {i for _, a, b in base for i in range(a, b)}
    return sorted(base + [s for s in more if taken.isdisjoint(range(s[1], s[2]))], key=lambda s: (["email", "ip", "card", "phone", "secret"].index(s[0]), s[1]))


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab1@.-+ _é")), max_size=30))
def test_emails_are_the_patterns_matches(text):
    assert pii.emails(text) == [("email", *m.span()) for m in re.finditer(PATTERNS["email"], text)]


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(st.sampled_from(list("0123456789..+ -()@a٣")), max_size=60), st.lists(st.sampled_from(["4111111111111111", "4111-1111 1111 1111", "1.2.3.4", ".", "255.0.0.1", "+", "+49 ", "(30)", " ", "-", "12345678", "a@b.co", "256", "0", "é"]), max_size=9).map("".join)))
def test_base_spans_are_the_patterns_matches(text):
    assert pii.base_spans(text) == oracle(text)


def test_long_runs_are_linear():
    import time

    for text in ("9" * 1_000_000, "9." * 300_000, "+" * 300_000, "1 " * 300_000, "a." * 300_000, "a@" * 200_000, "@" * 300_000, "x" * 1_000_000 + "1"):
        start = time.time()
        pii.base_spans(text)
        FIELD.spans([text])
        assert time.time() - start < 30


def test_base_spans():
    text = "mail a.b@c.org, 10.0.0.255 not 1.2.3.256, card 4111 1111 1111 1111 not 4111 1111 1111 1112, call +1 (619) 555-0053."
    assert [(k, text[a:b]) for k, a, b in pii.base_spans(text)] == [("email", "a.b@c.org"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (619) 555-0053")]
    assert pii.base_spans("9" * 6000 + ".1.1.1") == []


def test_held_out_words():
    wrong = total = 0
    for words, labels in pii.training_table(400, seed=99):
        got = [pii.LABELS[k] for k in FIELD.decode([words])[0]]
        total += len(words)
        wrong += sum(a != b for a, b in zip(got, labels))
    assert wrong <= 0.01 * total


def brute_features(words, t):
    before, after = words[t - 1] if t else None, words[t + 1] if t + 1 < len(words) else None
    return [*pii.features(words[t]), f"prev={pii.beside(before)}", f"next={pii.beside(after)}"]


def best_path(words):
    """The best labels of a whole text, by the field's definition: far words are outside, all paths of the others are tried."""
    n, k = len(words), len(pii.LABELS)
    near = [any(pii.TELLING.search(w) for w in words[max(0, t - pii.REACH) : t + pii.REACH + 1]) for t in range(n)]
    best = {0: (0.0, ())}  # by label of the word before
    for t in range(n):
        score = FIELD.emit[[FIELD.index[f] for f in brute_features(words, t) if f in FIELD.index]].sum(axis=0)
        now = {}
        for j in range(k if near[t] else 1):
            worth, path = max((w + (FIELD.step[i, j] if near[t] or near[t - 1] and t else 0.0), p) for i, (w, p) in best.items())
            now[j] = (worth + (score[j] if near[t] else 0.0), (*path, j))
        best = now
    return max((w + (FIELD.step[j, 0] if n and near[-1] else 0.0), p) for j, (w, p) in best.items())[1]


def test_stretches_decode_as_whole_texts():
    """Spans come from the best path over each whole text."""
    for words, _ in pii.training_table(80, seed=5):
        text = " ".join(words)
        path = [pii.LABELS[j] for j in best_path(words)]
        runs = []
        for t, x in enumerate(path):
            if x[0] == "B" or x[0] == "I" and not (t and path[t - 1] != "O" and path[t - 1][2:] == x[2:]):
                runs.append([x[2:], words[t]])
            elif x[0] == "I":
                runs[-1].append(words[t])
        got = FIELD.spans([text])[0]
        assert [k for k, _, _ in got] == [r[0] for r in runs]
        assert all(text[a:b] in " ".join(r[1:]) for (_, a, b), r in zip(got, runs))


def test_viterbi_is_the_best_path():
    from itertools import product

    words = ["call", "+1", "(619)", "555-0053"]
    score = FIELD.scores(words, "please", None)
    step = FIELD.step

    def worth(p):
        return step[0, p[0]] + sum(s[k] for s, k in zip(score, p)) + sum(step[a, b] for a, b in zip(p, p[1:])) + step[p[-1], 0]

    best = max(product(range(len(pii.LABELS)), repeat=4), key=worth)
    assert tuple(FIELD.decode([words], [("please", None)])[0]) == best


def test_the_words_around_decide():
    found = lambda text: [(k, text[a:b]) for k, a, b in FIELD.spans([text])[0]]
    assert found("please call 5557713 today") == [("phone", "5557713")] and found("see order 5557713 today") == []
    assert found("the key 8f3a9cbb12ffaa00 is") == [("secret", "8f3a9cbb12ffaa00")] and found("the commit 8f3a9cbb12ffaa00 is") == []
    assert found('a token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"### b') == [("secret", "9233a8ecf7c5b09fe5949719b6b82bc439e9329b")]
    assert found("call (619) 555-0053 ext 12 please") == [("phone", "(619) 555-0053 ext 12")]
    assert found("pay 4111111111111111 or 4111111111111112 now") == [("card", "4111111111111111")]


def test_documents(odd, none, sample):
    got = {(r.doc_id, r.base_sha256): r for r in pii.personal_data(odd, field=FIELD).collect()}
    assert len(got) >= 11 and all(not r.spans for r in got.values())
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in pii.personal_data(sample, field=FIELD).join(sample, "doc_id").collect():
        base = oracle(r.text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        assert r.spans == text(merged(r.text, FIELD.spans([r.text])[0]))
    assert pii.personal_data(none, field=FIELD).count() == 0


def test_redacted_documents(odd, sample):
    """Texts without their spans, rebuilt character by character."""
    for docs in (odd, sample):
        texts = {}
        for r in docs.collect():
            names = {}
            for kind, a, b in sorted(merged(r.text or "", FIELD.spans([r.text])[0]), key=lambda s: (s[1], -s[2])):
                for i in range(a, b):
                    names.setdefault(i, (kind, a) if i == a or i - 1 not in names else names[i - 1])
            out, last = [], None
            for i, c in enumerate(r.text or ""):
                mark = names.get(i)
                if mark is None:
                    out.append(c)
                elif mark != last:
                    out.append(f"[{mark[0].upper()}]")
                last = mark
            texts.setdefault(r.doc_id, []).append("".join(out) if r.text is not None else None)
        got = pii.redacted(docs, FIELD).collect()
        assert len(got) == docs.count()
        for r in got:
            assert r.text in texts[r.doc_id]


def test_redaction(spark, odd):
    docs = spark.createDataFrame([(1, "call +1 (619) 555-0053 or a@b.co, password=0123456789abcdef0123 ok", 66), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redacted(docs, FIELD).collect()}
    text = "call [PHONE] or [EMAIL], [SECRET] ok"
    assert got == {1: (text, len(text)), 2: ("clean", 5), 3: (None, None)}
    assert pii.redacted(odd, FIELD).columns == odd.columns and pii.redacted(odd, FIELD).count() == odd.count()


def test_features_of_long_words_see_their_ends():
    for word in ("password=" + "0123456789abcdef" * 8 + "\"", "k=" + "7" * 70 + "z"):
        assert f"last={pii.shape(word[-1])}" in pii.features(word)
    assert pii.shape("x" * 100 + "=" + "1" * 100) == "a=9"
