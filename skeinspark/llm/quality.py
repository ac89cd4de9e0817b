"""Quality classifier: Bradley-Terry ranking learned from preference pairs.

A document of label 1 is preferred to one of label 0. The chance that i is preferred to j is the logistic function of the
difference of their scores, each a linear function of the document's features, so the weights come from logistic loss on
feature differences. The documents' scores are then cut at a quantile of the training scores: the one, on a grid, that tells
the classes apart best. `score` maps the ranking score to 0..1 so that the cut is at 0.7.

Features are taken from the whole text in Arrow batches; label, language, source and id are no features. The classifier is
fitted on a bounded sample of labelled rows: at most `sample` of them, those of the smallest hash of doc_id, whose ids are
broadcast, and on `pairs` preference pairs drawn from these (40,000; their number bounds the fit, not what is scored).

Defined cases: a null text counts as empty and gets a score; labels that are null or of unknown documents are not used, and of
several labels of a document the mean counts, 1 from 0.5 on; without examples of both classes every document gets 0.7.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinspark.llm.common import crc_mod, map_texts, read
from skeinspark.llm.tokens import pieces

CUT = 0.7
SAMPLE = 20_000
#: Groups of bytes whose shares are features.
GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"#$%&*", b"|", b"@/\\_=+<>{}[]()'\"~^`-")


def features(text: str) -> list[float]:
    raw = text.encode()
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = [counts[list(g)].sum() / n for g in GROUPS] + [counts[128:].sum() / n]
    words, lines = raw.split(), raw.split(b"\n")
    k = max(len(words), 1)
    distinct = len({*words})
    twice = sum(map(eq, words, words[1:]))
    pairs = len({*zip(words, words[1:], strict=False)})
    p = counts[counts > 0] / n
    return [
        *np.sqrt(shares), np.log1p(len(raw)), np.log1p(len(words)), distinct / k, distinct / k**0.8, twice / k, pairs / k,
        sum(map(len, words)) / k / 10, len({*lines}) / len(lines), np.log1p(len(lines)), np.log1p(len(raw) / len(lines)), -(p * np.log2(p)).sum() / 8,
    ]


class Ranker:
    """Weights over the features and their hinges at quantiles of the training rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, pairs: int = 40_000, steps: int = 400, ridge: float = 1e-3) -> None:
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.knots = np.quantile((x - self.mean) / self.scale, (0.03, 0.15, 0.5, 0.85, 0.97), axis=0)
        z = self.expand(x)
        rng = np.random.default_rng(seed)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        self.w = np.zeros(z.shape[1])
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, steps + 1):
            g = ridge * self.w - (d.T @ (1 / (1 + np.exp(np.clip(d @ self.w, -30, 30))))) / pairs
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        s = z @ self.w
        cuts = np.quantile(s, np.arange(1, 400) / 400)
        rate = [((s[good] >= c).mean() + (s[bad] < c).mean()) for c in cuts]
        best = np.flatnonzero(np.isclose(rate, max(rate)))
        self.cut = float(cuts[best[len(best) // 2]])
        self.slope = 1.0 / max(float(s.std()), 1e-6) * 2

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, *[np.maximum(z - k, 0) for k in self.knots]])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted or not len(x):
            return np.full(len(x), CUT)
        at = np.clip(self.slope * (self.expand(x) @ self.w - self.cut), -30, 30)
        return 1 / (1 + np.exp(-at) * (1 - CUT) / CUT)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Ranker:
    """labels: doc_id and a 0/1 label, those that may be learned from."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label_col).alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(known), F.col("id") == F.col("doc_id")).select("label", "text")
    got = _features(rows, "label", "text").toPandas()
    x = np.array(got["f"].tolist(), float) if len(got) else np.zeros((0, 1))
    return Ranker(x, (got["doc_id"].to_numpy(float) >= 0.5).astype(int))


def _features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return map_texts(docs, id_col, text_col, lambda: lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))], "f array<double>")


def classify(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one row per row of docs."""

    def make():
        return lambda texts: [pa.array(ranker.score(np.array([features(t) for t in texts], float).reshape(len(texts), -1)), pa.float64())]

    return map_texts(docs, id_col, text_col, make, "score double")


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of docs that the ranker does not reject, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in pieces(batches, at):
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], float).reshape(batch.num_rows, -1)
            yield batch.filter(pa.array(ranker.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    return labels.filter(crc_mod(F.col("doc_id"), 4) != 2)


def held_out(c: Column) -> Column:
    return F.coalesce(crc_mod(c, 4) == 2, F.lit(False))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ranker = fit(docs, learnable(read(spark, sf_dir, "labels")))
    out = classify(docs, ranker)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
