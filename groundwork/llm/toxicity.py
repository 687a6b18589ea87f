"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and word beginnings learns from texts confirmed as toxic and from unlabelled
text. The unlabelled text stands for the negatives: its loss, less the share of it that the class prior says is
toxic, and never below zero (the non-negative risk estimator of Kiryo and others, 2017).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import small, written

WORDS = re.compile(r"[^\W\d_]+").findall
BITS = 22
# Lengths of the beginnings that stand for the stem of a word.
STEMS = (4, 5, 6)
# Words whose features a task keeps at hand.
KEPT_WORDS = 1 << 18


def word_features(word: str) -> list[int]:
    mask = (1 << BITS) - 1
    return [zlib.crc32(word.encode()) & mask,
            *(zlib.crc32(f"^{word[:n]}".encode()) & mask for n in STEMS if len(word) > n)]


def text_features(text: str) -> set[int]:
    return {f for word in set(WORDS(text.lower())) for f in word_features(word)}


@dataclass
class Model:
    """Weights of the chosen features (sorted by number), and a bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight_of = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        known: dict[str, tuple] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in set(WORDS((text or "").lower())):
                hits = known.get(word)
                if hits is None:
                    hits = tuple(f for f in word_features(word) if f in weight_of)
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = hits
                if hits:
                    found.update(hits)
            total = self.bias + sum(weight_of[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))

        return score


def fit_nnpu(rows: list[np.ndarray], positive: np.ndarray, width: int, prior: float, *, epochs: int = 300,
             rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier by the non-negative risk, with Adam on the whole sample.

    ``rows`` are the features present in each text, ``positive`` marks the confirmed ones, the rest is unlabelled.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    which = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for step in range(1, epochs + 1):
        z = np.bincount(at, w[which], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss_as_negative = np.logaddexp(0, z)
        negative_risk = loss_as_negative[~positive].sum() / n_u - prior * loss_as_negative[positive].sum() / n_p
        # Gradients of prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); below zero the second part is pushed back up.
        up = np.where(positive, prior * (p - 1) / n_p, 0.0)
        down = np.where(positive, -prior * p / n_p, p / n_u)
        slope = up + down if negative_risk >= 0 else -down
        g = np.append(np.bincount(which, slope[at], width), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", held_out=None, max_positive: int = 4_000, max_unlabelled: int = 12_000,
          max_features: int = 8_192, min_share: float = 1 / 60, min_z: float = 4.0) -> Model:
    """Learns from at most ``max_positive`` confirmed toxic texts and ``max_unlabelled`` others.

    ``held_out`` is a condition on the id for rows that training must not see. Both samples are the rows with the
    smallest hash of the id. The class prior is the share of toxic ones among all labelled training rows. Of the
    features, those enter that ``min_share`` of the positives (and three of them) have, and whose share there is
    above that in the unlabelled by at least ``min_z`` standard errors, ``max_features`` at most. Labels other than 0 and 1, null labels and null ids are ignored.
    Without a positive text the model is the prior alone.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("mark")).where(
        "id IS NOT NULL AND mark IN (0, 1)").groupBy("id").agg(F.max("mark").alias("mark"))
    if held_out is not None:
        marks, ids = marks.where(~held_out(F.col("id"))), ids.where(~held_out(F.col("id")))
    n, toxic = marks.agg(F.count("*"), F.sum("mark")).first()
    prior = min(0.5, max(0.001, ((toxic or 0) + 0.5) / ((n or 0) + 1)))
    by_hash = [F.xxhash64("id"), F.col("id")]
    chosen = marks.where("mark = 1").orderBy(*by_hash).limit(max_positive).select("id", F.lit(True).alias("positive"))
    # The unlabelled sample holds its natural share of toxic text, as the estimator expects.
    mixed = ids.where("id IS NOT NULL").select("id").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(
        max_unlabelled).distinct().select("id", F.lit(False).alias("positive"))
    sample = F.broadcast(written(chosen.union(mixed), "training-ids"))

    def features(batches):
        for batch in small(batches, "body"):
            found = [sorted(text_features(t or "")) for t in batch.column("body").to_pylist()]
            yield pa.record_batch({"id": batch.column("id"), "positive": batch.column("positive"),
                                   "features": pa.array(found, pa.list_(pa.int32()))})

    kind = dict(ids.dtypes)["id"]
    texts = written(ids.join(sample, "id").mapInArrow(features, f"id {kind}, positive boolean, features array<int>"),
                    "training-features")
    sizes = {r["positive"]: r["n"] for r in texts.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    seen = texts.select("positive", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum(F.col("positive").cast("int")).alias("p"), F.sum((~F.col("positive")).cast("int")).alias("u"))
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = seen.where(F.col("p") >= max(3, n_p * min_share)).withColumn("z", z).where(F.col("z") >= min_z).orderBy(
        F.desc("z"), "f").limit(max_features).select("f")
    numbers = np.array(sorted(r["f"] for r in best.collect()), np.int64)
    if not len(numbers):
        return Model(numbers, np.zeros(0), float(np.log(prior / (1 - prior))))
    shipped = docs.sparkSession.sparkContext.broadcast(numbers)

    def narrow(batches):
        numbers = shipped.value
        for batch in batches:
            rows = []
            for found in batch.column("features").to_pylist():
                found = np.array(found or [], np.int64)
                rows.append(np.searchsorted(numbers, found[np.isin(found, numbers)]))
            yield pa.record_batch({"id": batch.column("id"), "positive": batch.column("positive"),
                                   "features": pa.array(rows, pa.list_(pa.int32()))})

    table = texts.mapInArrow(narrow, texts.schema).orderBy("id", "positive").toPandas()
    rows = [np.asarray(r, np.int64) for r in table["features"]]
    weights, bias = fit_nnpu(rows, table["positive"].to_numpy(bool), len(numbers), prior)
    return Model(numbers, weights, bias)


def ship(docs: DataFrame, model: Model):
    """The model's arrays, of bounded size, for every task."""
    return docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))


def score_texts(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score from 0 to 1. Null and empty texts get the score of a text without words."""
    shipped = ship(docs, model)

    def scored(batches):
        score = Model(*shipped.value).scorer()
        for batch in small(batches, "body"):
            yield pa.record_batch({"id": batch.column("id"),
                                   "score": pa.array([score(t) for t in batch.column("body").to_pylist()], pa.float64())})

    work = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    return work.mapInArrow(scored, f"id {dict(work.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    shipped, at = ship(docs, model), docs.columns.index(text_col)

    def sieved(batches):
        score = Model(*shipped.value).scorer()
        for batch in small(batches, at):
            yield batch.filter(pa.array([score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(sieved, docs.schema)
