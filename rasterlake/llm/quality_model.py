"""Quality classifier: document evidence with host and path posteriors by hierarchical empirical Bayes.

Document evidence is a logistic model over simple measures of a whole text, fitted on the driver on at most ``FIT_ROWS`` labelled
rows (those of the smallest hashes of id and measures; only rows below a threshold hash, which the number of labelled rows gives,
leave their tasks). Hosts and paths pool the evidence of their documents (a label where there is one, else the model's
probability) through grouped sums. Between-host and between-path variances, by the method of moments, give the prior strengths: a
path shrinks to its host, a host to the global rate, the more the fewer documents it has. A document's score adds the logit of its
path's posterior, against the global rate, to its own evidence. It is left out of that posterior: its own share is taken off the
sums of its path and of its host, so that neither its label nor its evidence counts for itself.

Defined cases: null and empty texts are scored as texts without words; null hosts and paths are one host and one path; a path's
only document has its host's posterior, a host's only document the global rate; null labels and labels in conflict (per id) are
ignored; without both labels the document evidence is neutral; rows are independent, equal ids included (equal labelled rows are
learned from once); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, quoted, stored, table

#: Bound of labelled rows that the document model is fitted on.
FIT_ROWS = 20_000
#: Hashes from 0 to this are compared with the threshold.
_HASHES = 1 << 40
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_"
_MARKS = b"!?"
_DIGITS = b"0123456789"
MEASURES = ("words", "symbols", "marks", "upper", "digits", "distinct", "length", "lines", "blank")


def measures(raw: bytes | None) -> list[float]:
    """Measures of one whole text, each about zero to one."""
    raw = raw or b""
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    per = max(n, 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        math.log1p(n) / 10, min(count(_SYMBOLS) / per, 3) / 3, min(count(_MARKS) / per, 3) / 3, count(_UPPER) / size, count(_DIGITS) / size,
        len(set(words)) / per / max(1.0, 5 / math.log(per + 10)), min(size / per, 30) / 30, len(set(lines)) / max(len(lines), 1), float(not n),
    ]


def _basis(x: np.ndarray) -> np.ndarray:
    """The measures, their squares and hinges, and a constant."""
    return np.concatenate([np.ones((len(x), 1)), x, x * x, np.maximum(x - 0.1, 0), np.maximum(x - 0.3, 0)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(h, g)
        w -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(row, mean: float) -> float:
    """Prior strength from groups' sums: sum n, sum n*n, groups, and the weighted squared deviation of their rates."""
    n, nn, groups, dev = (float(x or 0) for x in row)
    if groups < 2 or n <= 0 or n * n <= nn:
        return 1000.0
    within = mean * (1 - mean)
    between = max((dev - (groups - 1) * within) / (n - nn / n), 0.0)
    return min(max(within / between - 1, 1.0), 1e6) if between > 1e-9 else 1e6


def _sample(labelled: DataFrame, most: int) -> list:
    """At most ``most`` different rows, by hash. Tasks send rows below a threshold only, so that all of them send about ``most``."""
    n = labelled.count()
    share = min(1.0, 1.1 * most / max(n, 1))
    mark = F.pmod(F.xxhash64("id", "x", "label"), F.lit(_HASHES))
    some = labelled.select("x", "label", mark.alias("mark")).where(F.col("mark") < int(share * _HASHES)).dropDuplicates(["mark", "x", "label"])
    return some.orderBy("mark").limit(most).select("x", "label").collect()


def scores(docs: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_score`` (its own evidence), ``host_rate`` and ``path_rate`` (posteriors of the other documents of its host
    and path), ``quality_score`` and ``keep``."""
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[id_col]
    placed = docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(quoted(text_col)).alias("text"))

    def make():
        return lambda texts: {"x": [measures(t) for t in texts]}

    measured = per_text(placed, f"id {id_type}, host string, path string, x array<double>", make, "id", "text", carry=("host", "path"))
    said = labels.where("quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r")).where("q = r and id is not null").select("id", F.col("q").cast("double").alias("label"))
    measured = stored(measured.join(said, "id", "left"), "quality-measures")
    sample = _sample(measured.where("label is not null"), FIT_ROWS)
    y = np.array([r.label for r in sample])
    if len(set(y.tolist())) == 2:
        weights = fit_logistic(_basis(np.array([r.x for r in sample])), y)
    else:
        weights = np.zeros(_basis(np.zeros((1, len(MEASURES)))).shape[1])
    k = len(MEASURES)
    xs = [F.get("x", F.lit(i)) for i in range(k)]
    terms = [F.lit(float(weights[0]))]
    for i, x in enumerate(xs):
        a, b, c, d = (float(weights[1 + j * k + i]) for j in range(4))
        terms.append(x * a + x * x * b + F.greatest(x - 0.1, F.lit(0.0)) * c + F.greatest(x - 0.3, F.lit(0.0)) * d)
    z = terms[0]
    for t in terms[1:]:
        z = z + t
    z = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), z))
    marked = measured.select("id", "host", "path", z.alias("z"), "label").withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    marked = stored(marked.select("id", "host", "path", "z", "p", F.coalesce("label", "p").alias("e")), "quality-evidence")
    by_path = stored(marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s")), "quality-paths")
    n, s = by_path.agg(F.sum("n"), F.sum("s")).first()
    rate = min(max((s or 0.0) / n if n else 0.5, 1e-4), 1 - 1e-4)
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    sums = lambda n, s, mean: [F.sum(n), F.sum(F.col(n) * F.col(n).cast("double")), F.count("*"), F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - mean, 2))]
    strong = _strength(by_host.agg(*sums("hn", "hs", F.lit(rate))).first(), rate)
    hosts = by_host.withColumn("host_rate", (strong * rate + F.col("hs")) / (strong + F.col("hn")))
    both = stored(by_path.join(hosts, "host"), "quality-hosts")
    tied = _strength(both.agg(*sums("n", "s", F.col("host_rate"))).first(), rate)
    # the groups' sums without the document itself
    out = marked.join(both.select("host", "path", "n", "s", "hn", "hs"), ["host", "path"])
    out = out.withColumn("host_rate", (strong * rate + F.col("hs") - F.col("e")) / (strong + F.col("hn") - 1))
    out = out.withColumn("path_rate", (tied * F.col("host_rate") + F.col("s") - F.col("e")) / (tied + F.col("n") - 1))
    edge = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    final = F.col("z") + _logit(edge(F.col("path_rate"))) - math.log(rate / (1 - rate))
    score = 1 / (1 + F.exp(-final))
    return out.select(
        F.col("id").alias(id_col), F.col("p").alias("doc_score"), F.col("hn").alias("host_docs"), F.col("n").alias("path_docs"), "host_rate", "path_rate", score.alias("quality_score"), (score >= 0.5).alias("keep")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: the source is the host, source and language are the path."""
    docs = table(spark, sf_dir, "documents")
    return scores(docs, table(spark, sf_dir, "labels"), F.col("source"), F.concat_ws("/", "source", "lang"))
