"""Quality classifier with hierarchical empirical Bayes over sites.

A document classifier, fitted on labelled rows, gives each text a
probability.  Hosts shrink toward the corpus and paths toward their host,
sparse ones most, by strengths estimated from the variance within and between
them.  A document's score joins its own evidence with what the other documents of its path and host say.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import lowest, with_arrow
from catalogops.plans.staging import written

#: Hashed features of word shapes, besides the named ones.
SHAPES = 256
#: Labelled rows at most that the classifier learns from.
SAMPLE_ROWS = 4000
#: Most paths whose posteriors are broadcast; above it both sides are shuffled.
BROADCAST_PATHS = 200_000
KEEP_FROM = 0.5
_NAMED = 8
#: Symbols of a shape that make one feature; a longer shape makes several.
PIECE = 12
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
_runs = re.compile(r"(.)\1\1+", re.DOTALL)


class _Kinds(dict):
    """Code point to its kind: letters and digits by kind, others as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "a" if c.isalpha() else c
        return kind


class _Shapes(dict):
    """Word to the numbers of its shape's pieces: letters and digits by kind, at most two alike in a row, of the whole word."""

    def __init__(self):
        self.kinds = _Kinds()

    def __missing__(self, word: str) -> tuple[int, ...]:
        short = _runs.sub(r"\1\1", word.translate(self.kinds))
        n = tuple(_NAMED + xxhash.xxh32_intdigest(short[i : i + PIECE].encode(), i > 0) % SHAPES for i in range(0, len(short), PIECE))
        if len(word) <= REMEMBERED_CHARS:
            if len(self) > 300_000:
                self.clear()
            self[word] = n
        return n


def features(text: str | None, shapes: dict) -> np.ndarray:
    """Shares of pieces of word shapes, and measures of repetition, length and signs, of the whole text."""
    out = np.zeros(_NAMED + SHAPES, np.float32)
    text = text or ""
    words = text.split()
    n = len(words)
    if n:
        pieces = np.fromiter(chain.from_iterable(map(shapes.__getitem__, words)), np.int64)
        out[:] = np.bincount(pieces, minlength=len(out)) / len(pieces)
        lines = text.split("\n")
        out[0] = len(set(words)) / n**0.75
        out[1] = sum(a == b for a, b in zip(words, words[1:])) / n
        out[2] = len(set(lines)) / len(lines)
        out[3] = np.log1p(n)
        out[4] = np.log1p(len(text) / n)
        out[5] = np.log1p(n / len(lines))
        out[6] = sum(map(text.count, "|#$%&*")) / n
        out[7] = 1.0
    return out


class Logistic:
    """Regularised logistic regression by Newton's method on standardised features."""

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 5.0) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]).astype(np.float64)
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            curve = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge)
            w -= np.linalg.solve(curve, z.T @ (p - y) + ridge * w)
        self.weights = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _feature_work():
    shapes = _Shapes()

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([features(t, shapes).tobytes() for t in batch.column("text").to_pylist()], pa.binary())]

    return each


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Logistic | None:
    """A classifier from at most ``rows`` labelled rows, taken by hash of the id; None without both classes.

    Only the sample's ids are broadcast and only its feature vectors (1 KB each) come to the driver.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("y"))
    chosen = lowest(chosen, F.xxhash64("__id"), rows, "__id")
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    vectors = with_arrow(sample, "x binary", "text", _feature_work, drop=("text",))
    got = vectors.orderBy("__id", "x").limit(2 * rows).collect()
    y = np.array([float(r.y) for r in got])
    if not len(got) or y.min() == y.max():
        return None
    return Logistic().fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]), y)


def evidence(docs: DataFrame, model: Logistic | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``p``, the classifier's probability of good quality, in place of the text."""

    def work():
        shapes = _Shapes()

        def each(batch: pa.RecordBatch) -> list[pa.Array]:
            x = np.stack([features(t, shapes) for t in batch.column(text_col).to_pylist()])
            return [pa.array(model.predict(x) if model else np.full(len(x), 0.5), pa.float64())]

        return each

    return with_arrow(docs, "p double", text_col, work, drop=(text_col,))


def _strength(groups: DataFrame) -> float:
    """Pseudo-count of the prior from groups (n, s, q): variance within over variance between, by analysis of variance."""
    mean = F.col("s") / F.col("n")
    r = groups.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("n") * mean * mean).alias("b"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k")).first()
    if not r.n or r.k < 2 or r.n <= r.k:
        return 10.0
    within = max((r.q - r.b) / (r.n - r.k), 1e-9)
    between = (r.b - r.s * r.s / r.n - (r.k - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(max(within / between if between > 0 else 1e4, 0.1), 1e4))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_scores(rows: DataFrame, broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """Rows ``(.., host, path, p)`` with ``host_posterior``, ``path_posterior`` and ``score``.

    Sums by path are combined map-side; hosts are summed from paths and the corpus from hosts, so a host with a third of all rows costs no more than another.
    """
    by_path = rows.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    by_path = written(by_path, "quality-paths")
    by_host = written(by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")), "quality-hosts")
    all_ = by_host.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = (all_.s or 0.0) / (all_.n or 1.0)
    host_k, path_k = _strength(by_host), _strength(by_path)
    hosts = by_host.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = written(by_path.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s")).join(hosts.hint("merge"), "host"), "quality-sites")
    right = F.broadcast(sites) if sites.count() <= broadcast_paths else sites.hint("merge")
    joined = rows.join(right, ["host", "path"])
    p = F.col("p")
    # A document does not vote on its own prior.
    host = (F.col("host_s") - p + host_k * mu) / (F.col("host_n") - 1 + host_k)
    path = (F.col("path_s") - p + path_k * F.col("host_posterior")) / (F.col("path_n") - 1 + path_k)
    odds = _logit(p) + _logit(F.col("path_posterior")) - _logit(F.lit(mu))
    return joined.withColumn("host_posterior", host).withColumn("path_posterior", path).withColumn("score", 1 / (1 + F.exp(-odds))).drop("host_n", "host_s", "path_n", "path_s")


def classify(
    docs: DataFrame, model: Logistic | None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", keep_from: float = KEEP_FROM
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, host, path, p, host_posterior, path_posterior, score, kept``.

    A null or empty text has the evidence of an empty text; a null host or path is a site of its own (the empty string);
    rows that repeat an id are judged each.  Without a model the evidence is
    even.  An empty table gives no rows; other columns are not used.
    """
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), site(host_col).alias("host"), site(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = written(evidence(rows, model), "quality-evidence")
    return site_scores(rows).select(F.col("id").alias(id_col), "host", "path", "p", "host_posterior", "path_posterior", "score", (F.col("score") >= keep_from).alias("kept"))
