"""Toxicity: a linear classifier on character n-grams whose presence is scaled by naive Bayes log-count ratios.

The n-grams of three to five characters of the lower-cased whole text are hashed. From a bounded sample of labelled
documents come, for each n-gram, the log ratio of its document counts in both classes, and then the weights of a
logistic regression on the n-grams present, each scaled by its ratio. Scoring adds up the weights of those present.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches, stored, text_of
from voicegrain.operators.ranking import top_k

ORDERS = (3, 4, 5)
HASH_BITS = 18

#: Bounds of the fit: labelled documents of each class (first in the order of a hash), and n-grams with a weight.
SAMPLE_PER_CLASS = 3_000
FEATURES = 20_000


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text, with repeats."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    found, rolled = [], codes * np.uint32(2654435761)
    for order in range(2, max(ORDERS) + 1):
        if len(codes) < order:
            break
        rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint32(15))) * np.uint32(2246822519) + codes[order - 1 :]
        if order in ORDERS:
            mixed = rolled * np.uint32(3266489917) + np.uint32(order)
            found.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(668265263) >> np.uint32(32 - HASH_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def is_held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text is divisible by five (null: empty text); never used for learning."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts) -> np.ndarray:
        present = np.zeros(1 << HASH_BITS, np.float32)
        sums = np.empty(len(texts))
        for i, text in enumerate(texts):
            ids = grams(text or "")
            present[ids] = 1
            sums[i] = present @ self.weights
            present[ids] = 0
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -500, 500)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, per_class: int) -> DataFrame:
    """``text, toxic`` of at most ``per_class`` documents of each class outside the held-out part, however many share an id."""
    known = labels.select(F.col(key).alias("_id"), F.col("toxic")).where(
        "toxic is not null and _id is not null"
    ).groupBy("_id").agg(F.max("toxic").alias("toxic")).where(~is_held_out("_id"))
    order = [F.md5(F.col("_id").cast("string")), "_id"]
    picks = known.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(
        known.where("toxic != 1").orderBy(*order).limit(per_class)
    )
    found = docs.select(F.col(f"`{key}`").alias("_id"), text_of(F.col(f"`{text}`")).alias("text")).join(
        F.broadcast(picks), "_id"  # bounded by per_class
    )
    classed = found.withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    first = top_k(classed, ["toxic"], [*order, F.xxhash64("text"), "text"], per_class)
    return stored(first.select("text", "toxic").repartition(8))


def class_counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class in which an n-gram is present, and the number of documents of each class."""
    def count(batches):
        seen, docs = np.zeros((2, 1 << HASH_BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic, np.unique(grams(text))] += 1
                docs[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()]), pa.array([docs.tobytes()])], ["seen", "docs"])

    rows = sample.mapInArrow(count, "seen binary, docs binary").collect()  # eight rows of a fixed size
    seen, docs = np.zeros((2, 1 << HASH_BITS), np.int64), np.zeros(2, np.int64)
    for r in rows:
        seen += np.frombuffer(r.seen, np.int32).reshape(2, -1)
        docs += np.frombuffer(r.docs, np.int64)
    return seen, docs


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS,
    features: int = FEATURES, rounds: int = 150, penalty: float = 1e-3,
) -> Model:
    """Without both classes among the labels the model scores every text by the share of toxic labels."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, key, text, per_class)
    (clean, toxic), n = class_counts(sample)
    if not n.all():
        share = (n[1] + 0.5) / (n.sum() + 2)
        return Model(np.zeros(1 << HASH_BITS, np.float32), float(np.log(share / (1 - share))))
    ratio = np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    strength = np.abs(ratio) * np.sqrt(clean + toxic)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:features])
    chosen = chosen[(clean + toxic)[chosen] >= min(2, n.min())]
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def present(batches):
        for batch in batches:
            ids = [np.unique(place[grams(t)]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[x >= 0].astype(np.int32).tobytes() for x in ids], pa.binary()), batch.column("toxic")], ["ids", "toxic"]
            )

    rows = sample.mapInArrow(present, "ids binary, toxic int").collect()  # at most 2 * per_class rows
    y = np.array([r.toxic for r in rows], np.float64)
    ids = [np.frombuffer(r.ids, np.int32) for r in rows]
    weights, bias = logistic(ids, y, ratio[chosen], rounds, penalty)
    full = np.zeros(1 << HASH_BITS, np.float32)
    full[chosen] = weights
    return Model(full, bias)


def logistic(ids: list[np.ndarray], y, ratio, rounds, penalty) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by Adam over all rows at once; classes count alike.

    Sums go over a few hundred rows at a time, so besides the ids they need little memory.
    """
    blocks = [ids[i : i + 256] for i in range(0, len(ids), 256)]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, rounds + 1):
        scaled = w[:-1] * ratio
        slopes, whole, at = np.zeros(len(ratio)), 0.0, 0
        for block in blocks:
            columns, sizes = np.concatenate(block), [len(x) for x in block]
            margin = np.bincount(np.repeat(np.arange(len(block)), sizes), scaled[columns], len(block)) + w[-1]
            here = slice(at, at + len(block))
            error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[here]) * share[here]
            slopes += np.bincount(columns, np.repeat(error, sizes), len(ratio))
            whole += error.sum()
            at += len(block)
        grad = np.append(slopes * ratio + penalty * w[:-1], whole)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return (w[:-1] * ratio).astype(np.float32), float(w[-1])


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return scored(text_of(text))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text enters the score.

    Null texts count as empty. Null and repeated ids are rows of their own; other columns are left out; of labels
    given twice for an id the highest counts, and null ones are left out.
    """
    model = fit(docs, labels, key, text, **options)
    return docs.select(
        F.col(f"`{key}`").alias("doc_id"), is_held_out(key).alias("held_out"), score(model, F.col(f"`{text}`")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject.

    Null texts are scored as empty ones. Null and repeated ids are rows of their own; an empty table gives no rows.
    Labels count as in ``judge``.
    """
    model = fit(docs, labels, key, text, **options)
    return docs.where(score(model, F.col(f"`{text}`")) < 0.5)
