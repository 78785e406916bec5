"""Quality from trusted positives and unlabelled text, by minimising the non-negative unbiased risk.

Negative labels are never read. With squared loss the risk of a linear function of a text's measures depends on the data only
through first and second moments: those of the trusted positives and those of all text. Spark adds them up over the whole
corpus in one pass, so the fit is the same for every layout of the files and the driver holds two small matrices.

The risk is ``prior * R(positives, +1) + max(0, R(all, -1) - prior * R(positives, -1))``. As ``max(0, x)`` is the highest
``share * x`` with a share from 0 to 1, and the risk at each share is a convex square form, its exact minimum is found by
halving the share. The class prior is the lowest ratio, over cutoffs of scores fitted to one half of the positives, of
the part of all text above the cutoff to the part of the other half's positives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches, stored

#: Buckets of pairs of neighbouring bytes.
PAIRS = 192

#: Bound of the fit: labelled ids that are trusted as positive, first in the order of a hash.
TRUSTED = 20_000

#: Strengths of the penalty on weights, for measures scaled to a variance of one; chosen across the two halves.
PENALTIES = (0.003, 0.01, 0.03, 0.1, 0.3)

#: Penalties of the scores that the class prior is estimated with, and their cutoffs, from LOW to HIGH.
PRIOR_PENALTIES = (0.3, 1.0, 3.0, 10.0)
BINS, LOW, HIGH = 4096, -1.0, 3.0

#: Standard errors added to a ratio before the lowest one is taken.
ERRORS = 2.0

_KINDS = ["upper", "lower", "digit", "space", "line", "stop", "symbol", "other"]


def _kind_of_byte() -> np.ndarray:
    kinds = np.full(256, _KINDS.index("other"))
    kinds[33:127] = _KINDS.index("symbol")
    for name, chars in {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
        "stop": b".,;:'\"?-()",
    }.items():
        kinds[list(chars)] = _KINDS.index(name)
    return kinds


KIND = _kind_of_byte()
WORD_MEASURES = 8
MEASURES = 1 + len(_KINDS) + WORD_MEASURES + PAIRS


def word_measures(raw: bytes) -> list[float]:
    """Sizes and repeats: words, their mean length, distinct words, repeats of the word before, lines, distinct lines, ends."""
    words = raw.split()
    n = max(1, len(words))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    m = max(1, len(lines))
    pairs = set(zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)), np.log1p(sum(map(len, words)) / n), len(set(words)) / n / np.log1p(n),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(pairs) / n, len(set(lines)) / m, np.log1p(len(words) / m),
        sum(w[-1:] in b".!?" for w in words) / n,
    ]


def measures(texts: list[str]) -> np.ndarray:
    """A row of ``MEASURES`` numbers for each text; the first is 1. Empty texts have zeros in all others."""
    out = np.zeros((len(texts), MEASURES))
    out[:, 0] = 1
    for row, text in zip(out, texts, strict=True):
        raw = text.encode()
        if not raw:
            continue
        at = np.frombuffer(raw, np.uint8)
        row[1 : 1 + len(_KINDS)] = np.sqrt(np.bincount(KIND[at], minlength=len(_KINDS)) / len(at))
        row[1 + len(_KINDS) : 1 + len(_KINDS) + WORD_MEASURES] = word_measures(raw)
        codes = at.astype(np.uint32)
        mixed = (codes[:-1] * np.uint32(257) + codes[1:]) * np.uint32(2654435761)
        pairs = np.bincount((mixed >> np.uint32(16)) % np.uint32(PAIRS), minlength=PAIRS)
        row[-PAIRS:] = np.sqrt(pairs / max(1, len(at) - 1))
    return out


def is_held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 1 when divided by three (null: empty text); their labels are never read."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def trusted_ids(labels: DataFrame, key: str, most: int) -> DataFrame:
    """``_id, half`` (1 or 2) of at most ``most`` ids labelled good and not held out. Of repeated labels the highest counts."""
    good = labels.select(F.col(f"`{key}`").alias("_id"), F.col("quality")).where("_id is not null and quality is not null")
    good = good.groupBy("_id").agg(F.max("quality").alias("quality")).where((F.col("quality") == 1) & ~is_held_out("_id"))
    hashed = F.md5(F.col("_id").cast("string"))
    return good.orderBy(hashed, "_id").limit(most).select("_id", (F.conv(F.right(hashed, F.lit(1)), 16, 10).cast("int") % 2 + 1).alias("half"))


def measured(docs: DataFrame, labels: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """``doc_id, held_out, half, x``: the measures of every row; ``half`` is 0 unless the row is a trusted positive."""
    trusted = trusted_ids(labels, key, most)
    slim = docs.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("text")).join(
        F.broadcast(trusted), "_id", "left"  # bounded by TRUSTED
    ).select(F.col("_id").cast("bigint").alias("doc_id"), is_held_out("_id").alias("held_out"), F.coalesce("half", F.lit(0)).alias("half"), "text")

    def run(batches):
        for batch in batches:
            x = measures([t or "" for t in batch.column("text").to_pylist()]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "held_out", "half", "x"]
            )

    return slim.mapInArrow(run, "doc_id bigint, held_out boolean, half int, x binary")


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, MEASURES).astype(np.float64)


def moments(table: DataFrame) -> np.ndarray:
    """Sums of products of all pairs of measures: of all rows, and of the positives of either half.

    Each task adds up its own rows; row by row of the matrices the sums are then added in two steps, so no task meets
    more than a part of them, and the driver gets three matrices of a fixed size.
    """
    def add(batches):
        total = np.zeros((3, MEASURES, MEASURES))
        for batch in batches:
            x, half = rows_of(batch.column("x")), batch.column("half").to_numpy(zero_copy_only=False)
            for kind, chosen in enumerate((x, x[half == 1], x[half == 2])):
                total[kind] += chosen.T @ chosen
        at = np.arange(3 * MEASURES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([r.tobytes() for r in total.reshape(-1, MEASURES)], pa.binary())], ["place", "sums"]
        )

    def summed(group: pa.Table) -> pa.Table:
        total = np.zeros(MEASURES)
        for raw in group.column("sums"):
            total += np.frombuffer(raw.as_py())
        return group.slice(0, 1).select(["place"]).append_column("sums", pa.array([total.tobytes()], pa.binary()))

    parts = table.select("half", "x").mapInArrow(add, "place int, sums binary").withColumn(
        "part", F.pmod(F.spark_partition_id(), F.lit(256)))
    parts = parts.groupBy("place", "part").applyInArrow(summed, "place int, sums binary")
    out = np.zeros((3 * MEASURES, MEASURES))
    for r in parts.groupBy("place").applyInArrow(summed, "place int, sums binary").collect():  # three matrices
        out[r.place] = np.frombuffer(r.sums)
    return out.reshape(3, MEASURES, MEASURES)


@dataclass(frozen=True)
class Moments:
    """Means and second moments of scaled measures, of all text and of positives."""

    all_mean: np.ndarray
    all_square: np.ndarray
    good_mean: np.ndarray
    good_square: np.ndarray

    @staticmethod
    def of(everything: np.ndarray, good: np.ndarray, scale: np.ndarray) -> Moments:
        u = scale.T @ (everything / everything[0, 0]) @ scale
        p = scale.T @ (good / good[0, 0]) @ scale
        return Moments(u[0], u, p[0], p)

    def ratio(self, penalty: float) -> np.ndarray:
        """Weights of the ratio of the positives' density to that of all text, by least squares over all text."""
        return np.linalg.solve(self.all_square + ridge(penalty), self.good_mean)

    def negative_part(self, w: np.ndarray, prior: float) -> float:
        """The risk of unlabelled negatives: that of all text as negative less the positives' part of it."""
        risk = 1 + 2 * self.all_mean @ w + w @ self.all_square @ w
        return (risk - prior * (1 + 2 * self.good_mean @ w + w @ self.good_square @ w)) / 4

    def risk(self, w: np.ndarray, prior: float) -> float:
        good = prior * (1 - 2 * self.good_mean @ w + w @ self.good_square @ w) / 4
        return good + max(0.0, self.negative_part(w, prior))

    def weights(self, prior: float, penalty: float) -> np.ndarray:
        """The minimum of the non-negative risk and the penalty."""
        def at(share: float) -> np.ndarray:
            square = prior * (1 - share) * self.good_square + share * self.all_square + ridge(penalty)
            return np.linalg.solve(square, prior * (1 + share) * self.good_mean - share * self.all_mean)

        w = at(1.0)
        if self.negative_part(w, prior) >= 0:
            return w
        low, high = 0.0, 1.0
        for _ in range(40):
            share = (low + high) / 2
            w = at(share)
            low, high = (share, high) if self.negative_part(w, prior) > 0 else (low, share)
        return w


def ridge(penalty: float) -> np.ndarray:
    """The penalty on every weight but the first's; a trace on that keeps the equations solvable."""
    out = np.full(MEASURES, penalty)
    out[0] = 1e-9
    return np.diag(out)


def scaling(everything: np.ndarray) -> np.ndarray:
    """The matrix that brings measures to mean 0 and variance 1; constant ones are left out."""
    mean = everything[0] / everything[0, 0]
    spread = np.sqrt(np.maximum(np.diag(everything) / everything[0, 0] - mean**2, 0))
    by = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0)
    out = np.diag(by)
    out[0] = -mean * by
    out[0, 0] = 1
    return out


def prior_of(counts: np.ndarray) -> float:
    """The class prior from counts by score (rising), for several scores: all text in the first row of each, positives not
    used in the fit in the second. A ratio is never below the prior but by chance, so the lowest counts, errors included."""
    n = counts.sum(2)
    if not n.all():
        return 0.5
    text, good = np.moveaxis(np.cumsum(counts[..., ::-1], axis=2)[..., ::-1] / n[..., None], 1, 0)
    some = good > 0.5
    ratio = text[some] / good[some]
    error = np.sqrt((1 - good[some]) / (good[some] * n[0, 1]) + (1 - text[some]) / (text[some] * n[0, 0]))
    return float(np.clip(ratio[(ratio * (1 + ERRORS * error)).argmin()], 0.01, 0.99))


def score_counts(table: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Counts by score for the weights of either half (half, score, measure): of all text, and of the other half's positives."""
    scores = weights.shape[1]
    shape = (2, scores, 2, BINS)

    def count(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            x, half = rows_of(batch.column("x")), batch.column("half").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                bins = np.clip((x @ weights[k].T - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
                for i in range(scores):
                    total[k, i, 0] += np.bincount(bins[:, i], minlength=BINS)
                    total[k, i, 1] += np.bincount(bins[half == 2 - k, i], minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total.ravel()[some], pa.int64())], ["place", "n"])

    out = np.zeros(np.prod(shape), np.int64)
    found = table.select("half", "x").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n"))
    rows = found.toArrow()  # at most as many rows as the array has places
    out[rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(shape)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Above one half where the function is positive; at 1 and -1, the targets, 0.98 and 0.02."""
        return 1 / (1 + np.exp(-np.clip(4 * (x @ self.weights), -500, 500)))


def fit(table: DataFrame) -> Model:
    """From ``measured`` rows. Without positives in both halves the score of every text is one half."""
    everything, *halves = moments(table)
    if not everything[0, 0] or not all(h[0, 0] for h in halves):
        return Model(np.zeros(MEASURES), 0.5)
    scale = scaling(everything)
    sides = [Moments.of(everything, h, scale) for h in halves]
    scores = np.array([[scale @ side.ratio(p) for p in PRIOR_PENALTIES] for side in sides])
    prior = float(np.mean([prior_of(c) for c in score_counts(table, scores)]))

    def across(penalty: float) -> float:
        return sum(b.risk(a.weights(prior, penalty), prior) for a, b in (sides, sides[::-1]))

    penalty = min(PENALTIES, key=across)
    whole = Moments.of(everything, halves[0] + halves[1], scale)
    return Model(scale @ whole.weights(prior, penalty), prior)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", trusted: int = TRUSTED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only the text enters the score.

    All rows of ``docs`` are the unlabelled text. Null texts count as empty. Null and repeated ids are rows of their own; other
    columns are left out. Null labels are no labels. Without labels, or without rows, nothing is learnt.
    """
    bounded_batches(docs.sparkSession)
    table = stored(measured(docs, labels, key, text, trusted))
    model = fit(table)

    def score(batches):
        for batch in batches:
            found = model.scores(rows_of(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()),
                 pa.array((found >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    return table.mapInArrow(score, "doc_id bigint, held_out boolean, score double, predicted int")
