"""Learning quality from positives and unlabelled text: moments, risk and prior against direct sums, and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest

from voicegrain.llm import pu_quality
from voicegrain.llm.pu_quality import MEASURES, PENALTIES, Model, Moments, measures, prior_of, scaling

FOLDER = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, source string, score string, half int"
LABELS = "doc_id long, quality int, toxic int, half string"


def text_of(rnd, good):
    words = ["sun", "tree", "river", "stone", "cloud", "grass", "bird", "the", "of", "and"]
    chosen = [words[rnd.integers(len(words))] + str(rnd.integers(20)) for _ in range(rnd.integers(20, 60))]
    return " ".join(chosen) + "." if good else " ".join(w.upper() + "$$$" for w in chosen)


def tables(n=2000, seed=1):
    rnd = np.random.default_rng(seed)
    kinds = rnd.random(n) < 0.7
    rows = [(i, text_of(rnd, bool(k)), "en", "a", "x", 9) for i, k in enumerate(kinds)]
    labels = [(i, int(k), 0, "z") for i, k in enumerate(kinds) if i % 2]
    return rows, labels, kinds


def held(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 3 == 1


def test_held_out_labels_and_negatives_are_never_read(spark):
    rows, labels, kinds = tables()
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    one = {r.doc_id: r for r in pu_quality.judge(docs, spark.createDataFrame(labels, LABELS)).collect()}
    changed = [(i, 1 - q if held(i) else (q if q else None), t, h) for i, q, t, h in labels]
    two = {r.doc_id: r for r in pu_quality.judge(docs.repartition(2), spark.createDataFrame(changed, LABELS)).collect()}
    assert all(abs(one[i].score - two[i].score) < 1e-6 for i in one)
    assert all(r.held_out == held(i) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in one.items())
    right = [one[i].predicted == kinds[i] for i in one if held(i)]
    assert np.mean(right) > 0.97


def test_moments_and_counts_are_the_sums_over_all_rows(spark):
    rows, labels, _ = tables(200)
    docs, labelled = spark.createDataFrame(rows, DOCS).repartition(9), spark.createDataFrame(labels, LABELS)
    table = pu_quality.stored(pu_quality.measured(docs, labelled, "doc_id", "text", 1000))
    local = table.collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in local]).astype(float)
    half = np.array([r.half for r in local])
    assert {r.doc_id for r in local if r.half} == {i for i, q, *_ in labels if q == 1 and not held(i)}
    found = pu_quality.moments(table)
    for got, chosen in zip(found, (x, x[half == 1], x[half == 2]), strict=True):
        assert np.allclose(got, chosen.T @ chosen)
    w = np.stack([np.eye(MEASURES)[[3, 5, 9]], np.eye(MEASURES)[[4, 5, 6]]])
    counts = pu_quality.score_counts(table, w)
    assert counts.shape[:3] == (2, 3, 2) and (counts[:, :, 0].sum(2) == 200).all()
    assert (counts[0, :, 1].sum(1) == (half == 2).sum()).all() and (counts[1, :, 1].sum(1) == (half == 1).sum()).all()


def test_risk_is_that_of_single_rows_and_its_minimum_is_found():
    rnd = np.random.default_rng(4)
    good, everything = rnd.normal(size=(30, MEASURES)), rnd.normal(size=(50, MEASURES))
    good[:, 0] = everything[:, 0] = 1
    m = Moments.of(everything.T @ everything, good.T @ good, np.eye(MEASURES))

    def loss(x, w, y):
        return np.mean((1 - y * (x @ w)) ** 2) / 4

    def direct(w, prior):
        return prior * loss(good, w, 1) + max(0, loss(everything, w, -1) - prior * loss(good, w, -1))

    for prior in (0.3, 0.9):
        w = rnd.normal(size=MEASURES) / 5
        assert np.isclose(m.risk(w, prior), direct(w, prior))
        penalty = np.full(MEASURES, 0.3)
        penalty[0] = 1e-9
        best = m.weights(prior, 0.3)
        # the penalty of a square form of half the weight: the solved equations are twice the risk's
        def whole(v, prior=prior):
            return direct(v, prior) + penalty @ (v * v) / 4

        assert all(whole(best) <= whole(best + rnd.normal(size=MEASURES) * s) + 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(200))
        assert m.negative_part(best, prior) > -1e-6


def test_prior_of_a_mixture():
    rnd = np.random.default_rng(2)
    good, bad = rnd.normal(1, 0.3, 200_000), rnd.normal(-1, 0.3, 200_000)
    for share in (0.2, 0.6, 0.9):
        k = int(share * 100_000)
        edges = np.linspace(-3, 3, 500)
        counts = np.stack([np.histogram(np.r_[good[:k], bad[: 100_000 - k]], edges)[0], np.histogram(good[100_000:], edges)[0]])
        worse = np.stack([np.histogram(rnd.normal(size=1000), edges)[0], np.histogram(rnd.normal(size=1000), edges)[0]])
        assert abs(prior_of(np.stack([worse * 100, counts])) - share) < 0.03
    assert prior_of(np.zeros((1, 2, 5), int)) == 0.5


def test_scaling_brings_measures_to_mean_zero_and_variance_one():
    x = measures([text_of(np.random.default_rng(i), i % 3 > 0) for i in range(50)])
    y = x @ scaling(x.T @ x)
    spread = y[:, 1:].std(0)
    assert np.allclose(y[:, 1:].mean(0), 0, atol=1e-8) and np.all(np.isclose(spread, 1) | (spread < 1e-6))


def test_nulls_repeats_and_empty_tables(spark):
    rows, labels, _ = tables(120)
    rows += [(None, None, None, None, None, None), (None, "", "en", "a", "x", 1), (3, "other text", "en", "a", "x", 1),
             (500, "x" * 300_000, "en", "a", "x", 1), (501, "é 日本 " * 5000, "de", "a", "x", 1), (502, " \n", None, "a", "x", 1)]
    labels += [(1, 0, 0, "z"), (1, 1, 0, "z"), (None, 1, 1, "z"), (2, None, None, None), (99_999, 1, 0, "z")]
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    found = pu_quality.judge(docs, labelled)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None for r in got) == 2
    nothing = pu_quality.judge(docs, labelled.limit(0)).collect()
    assert len(nothing) == len(rows) and {(r.score, r.predicted) for r in nothing} == {(0.5, 1)}
    assert pu_quality.judge(docs.limit(0), labelled).count() == 0


def test_bound_of_trusted_ids(spark):
    _, labels, _ = tables(400)
    found = pu_quality.trusted_ids(spark.createDataFrame(labels, LABELS), "doc_id", 40).collect()
    assert len(found) == 40 and {r.half for r in found} == {1, 2} and not any(held(r._id) for r in found)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = pu_quality.judge(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    good = np.array([r.score for r in found if r.quality == 1])
    bad = np.array([r.score for r in found if r.quality == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.995
    assert (good >= 0.5).mean() > 0.99 and (bad >= 0.5).mean() < 0.05
    assert Model(np.zeros(MEASURES), 0.5).scores(np.ones((1, MEASURES)))[0] == 0.5 and len(PENALTIES) == 5
