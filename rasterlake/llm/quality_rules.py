"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule is a ratio of a text that is high for bad texts, rejected above a cutoff. Cutoffs stand on fixed grids; labelled good
documents of a stratum (language) are the holdout that tells how often a cutoff would reject a good one. A cutoff is certified if
the exact binomial test at the rule's share of the allowed risk is significant after Bonferroni's correction over all strata,
rules and cutoffs; each stratum takes its lowest certified cutoff, none if no cutoff is certified. By the union bound the rules
together then reject at most ``RISK`` of good documents in every stratum, with confidence ``1 - DELTA``.

Defined cases: null texts have no words, and fail the base rules; texts of separators only likewise; null strata are one stratum;
labels of unknown documents, null labels and labels in conflict are ignored; without labels only the base rules reject; rows are
independent, equal ids included (each labelled row counts); an empty table gives no rows; extra columns are carried or ignored.
Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

RISK = 0.05
DELTA = 0.05
MIN_WORDS = 50
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bits of a long for a window's position in its text; the others are the upper bits of its hash.
POSITION_BITS = 24
#: Cutoffs of each rule, lowest first. Fixed before any data are seen.
GRID = {
    "symbols_per_word": (0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0),
    "marks_per_word": (0.1, 0.2, 0.3, 0.5, 1.0),
    "upper_share": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "duplicate_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeated_words": (0.1, 0.2, 0.3, 0.4, 0.5),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return _let(F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK)))


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are hashed; hash and position go into one long each, so that a plain sort brings equal windows together; the
    positions of windows with an equal neighbour are then sorted and their cover is counted. Where the long has no room for the
    positions (``POSITION_BITS``), or windows of different hashes are equal in the part that it has room for, structs of the whole
    hash and the position are sorted instead.
    """
    low = (1 << POSITION_BITS) - 1

    def cover(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(F.sort_array(at), start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    def of_structs(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))

        return cover(F.transform(F.filter(s, lambda x, k: twin(x, k - 1) | twin(x, k + 1)), lambda x: x["at"]))

    def of_hashes(hs: Column) -> Column:
        packed = F.sort_array(F.transform(hs, lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        whole = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("at"))))

        def of_packed(s: Column) -> Column:
            def alike(x: Column, k: Column) -> Column:
                # beyond the ends get() is null, and the comparison with it null
                return F.coalesce(x.bitwiseXOR(F.get(s, k)).bitwiseAND(F.lit(~low)) == 0, F.lit(False))

            def hash_of(x: Column) -> Column:
                return F.get(hs, x.bitwiseAND(F.lit(low)).cast("int"))

            at = F.filter(s, lambda x, k: alike(x, k - 1) | alike(x, k + 1))
            return _let(at, lambda a: F.when(mixed(a, hash_of), _let(whole, of_structs)).otherwise(cover(F.transform(a, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))))

        def mixed(a: Column, hash_of) -> Column:
            """Whether neighbours that are alike in the packed part differ in their whole hashes."""
            def differs(x: Column, k: Column) -> Column:
                before = F.get(a, k - 1)
                return F.coalesce((x.bitwiseXOR(before).bitwiseAND(F.lit(~low)) == 0) & (hash_of(x) != hash_of(before)), F.lit(False))

            return F.size(F.filter(a, differs)) > 0

        return (
            F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0))
            .when(F.size(hs) > low + 1, _let(whole, of_structs))
            .otherwise(_let(packed, of_packed))
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(_let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """A struct with the base counts of a text and what the rules' ratios are made of."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    by_words = _let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    by_lines = _let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    return F.struct(
        by_words.alias("w"),
        by_lines.alias("l"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("!?").cast("long").alias("n_marks"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
    )


def ratios(m: str) -> dict[str, Column]:
    """The rules' ratios from the struct column ``m``; zero for texts without words."""
    c = lambda name: F.col(f"{m}.{name}")
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "symbols_per_word": over(c("n_symbols"), c("w.n_words")),
        "marks_per_word": over(c("n_marks"), c("w.n_words")),
        "upper_share": over(c("n_upper"), c("w.word_chars")),
        "duplicate_lines": over(c("l.n_dup_lines"), c("l.n_lines")),
        "repeated_words": over(c("w.n_repeat_words"), c("w.n_words")),
        "word_length": over(c("w.word_chars"), c("w.n_words")),
    }


def base_failed(m: str) -> Column:
    n, r = F.col(f"{m}.w.n_words"), F.col(f"{m}.w.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > 50 * n)


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly, by a sum of logarithms' powers; 1 where k is at the mean or above."""
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    start = F.struct(first.alias("t"), F.exp(first).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i * odds)
        return F.struct(t.alias("t"), (a["sum"] + F.exp(t)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, step, lambda a: a["sum"]))


def cutoffs(measured: DataFrame, labels: DataFrame, m: str, id_expr: Column, stratum: Column, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum`` and one column a rule: the lowest certified cutoff, null where there is none."""
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1 and _id is not null").select("_id")
    held = measured.select(id_expr.alias("_id"), stratum.alias("stratum"), *[r.alias(k) for k, r in ratios(m).items()]).join(good, "_id")
    counts = [F.count("*").alias("n")] + [F.count_if(F.col(k) > c).alias(f"{k}_{i}") for k, grid in GRID.items() for i, c in enumerate(grid)]
    by = stored(held.groupBy("stratum").agg(*counts), "strata")
    tests = by.count() * sum(map(len, GRID.values()))
    each = risk / len(GRID)
    limit = F.lit(delta / max(tests, 1))
    lowest = []
    for k, grid in GRID.items():
        certified = [F.when(binomial_tail(F.col("n"), F.col(f"{k}_{i}"), each) <= limit, F.lit(c)) for i, c in enumerate(grid)]
        lowest.append(F.least(*certified).alias(k))
    return by.select("stratum", *lowest)


def _rejected(m: str, prefix: str) -> Column:
    out = F.lit(False)
    for k, r in ratios(m).items():
        out = out | F.coalesce(r > F.col(f"{prefix}.{k}"), F.lit(False))
    return out


def judged(measured: DataFrame, labels: DataFrame, m: str, id_expr: Column, stratum: Column) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``. Cutoffs are a row a stratum; they are broadcast up to 10,000 rows."""
    cut = stored(cutoffs(measured, labels, m, id_expr, stratum), "cutoffs").select("stratum", F.struct(*GRID).alias("_cut"))
    if cut.count() <= 10_000:
        cut = F.broadcast(cut)
    joined = measured.withColumn("_stratum", stratum).join(cut.withColumnRenamed("stratum", "_s"), F.col("_stratum") == F.col("_s"), "left")
    return joined.withColumn("base_failed", base_failed(m)).withColumn("kept", ~F.col("base_failed") & ~_rejected(m, "_cut"))


def stratum_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the base counts, ``base_failed`` and ``kept``."""
    measured = stored(docs.select("doc_id", stratum_of(F.col("lang")).alias("stratum"), measures(F.col("text")).alias("m")), "measures")
    out = judged(measured, labels, "m", F.col("doc_id"), F.col("stratum"))
    return out.select(
        "doc_id", "m.w.n_words", "m.w.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "base_failed", "kept"
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    measured = stored(docs.select(F.struct("*").alias("row"), measures(F.col("text")).alias("m")), "measured-documents")
    out = judged(measured, labels, "m", F.col("row.doc_id"), stratum_of(F.col("row.lang")))
    return out.where("kept").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, cutoffs from all ``labels``."""
    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH grid(rule, cutoff) AS (VALUES %s),
w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
p AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + d) AS n FROM g, (VALUES (0), (1), (2)) AS t(d) WHERE c >= 2 GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
q AS (SELECT rid, doc_id, stratum, rule, CASE rule WHEN 'symbols_per_word' THEN coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0)
  WHEN 'marks_per_word' THEN coalesce(n_marks / nullif(n_words, 0)::DOUBLE, 0) WHEN 'upper_share' THEN coalesce(n_upper / nullif(word_chars, 0)::DOUBLE, 0)
  WHEN 'duplicate_lines' THEN coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) WHEN 'repeated_words' THEN coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0)
  ELSE coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) END AS ratio FROM v, (SELECT DISTINCT rule FROM grid)),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
k AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (WHERE ratio > cutoff) AS k FROM q JOIN grid USING (rule) JOIN good USING (doc_id) GROUP BY ALL),
b AS (SELECT stratum, rule, cutoff, n, k, CASE WHEN k >= n * %r THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(%r) + (n - i) * ln(1 - %r))) FROM unnest(range(0, k + 1)) AS s(i)) END AS tail FROM k),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM b WHERE tail <= %r / ((SELECT count(DISTINCT stratum) FROM k) * (SELECT count(*) FROM grid)) GROUP BY ALL),
bad AS (SELECT DISTINCT rid FROM q JOIN cut USING (stratum, rule) WHERE ratio > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM v
""" % (
    (", ".join(f"('{k}', {c!r}::DOUBLE)" for k, grid in GRID.items() for c in grid),) + (RISK / len(GRID),) * 3 + (DELTA,)
)
