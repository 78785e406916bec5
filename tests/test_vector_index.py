"""The inverted file against all pairs: the same rows in exact search, measured recall with probes."""

import random

import pytest

from voicegrain.operators import vector_index as ivf
from voicegrain.operators.retrieval import nearest_profiles

P, Q = "profile_id bigint, vector array<double>, label string", "question_id bigint, vector array<double>"


def clustered(n, seed, dim=16, centres=12):
    rnd = random.Random(seed)
    middle = [[random.Random(c).gauss(0, 1) for _ in range(dim)] for c in range(centres)]
    return [[x + rnd.gauss(0, 0.35) for x in middle[rnd.randrange(centres)]] for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark):
    known = [(i, v, "x") for i, v in enumerate(clustered(1500, 1))]
    known += [(5000 + i, known[0][1], "x") for i in range(700)]  # a third are copies of one vector
    known += [(9000, [0.0] * 16, "zero"), (9001, None, "none")]
    asked = [(i, v) for i, v in enumerate(clustered(60, 2))] + [(100, known[0][1]), (101, [0.0] * 16), (102, None)]
    return spark.createDataFrame(asked, Q).repartition(3).cache(), spark.createDataFrame(known, P).repartition(5).cache()


@pytest.fixture(scope="module")
def index(tables):
    return ivf.build_index(tables[1])


def rows(df):
    return sorted((r.question_id, r.rank, r.profile_id, r.similarity) for r in df.collect())


@pytest.fixture(scope="module")
def exact(tables):
    asked, known = (t.where("vector is not null") for t in tables)
    return nearest_profiles(asked, known.select("profile_id", "vector"), 7).cache()


def test_every_vector_is_in_the_list_of_its_nearest_centroid(index, tables):
    kept = index.rows.collect()
    assert len(kept) == index.sizes.sum() == 2201 and 40 <= len(index.sizes) <= 50
    import numpy as np

    for r in kept[::97]:
        x = np.array(r.vector)
        cosine = index.centroids @ (x / (np.linalg.norm(x) or 1))
        assert r.list == cosine.argmax()
        assert np.arccos(np.clip(cosine[r.list], -1, 1)) <= index.widest[r.list] + 1e-9


@pytest.mark.parametrize(("probes", "blocks"), [(1, (1024, 32768)), (4, (3, 50)), (100, (1024, 32768))])
def test_search_gives_the_rows_of_all_pairs(index, tables, exact, probes, blocks):
    assert rows(ivf.search(tables[0], index, 7, probes, *blocks)) == rows(exact)


def test_search_looks_into_few_lists(index, tables):
    asked = tables[0].where("question_id < 60")
    filled = index.sizes > 0
    wanted = ivf._wanted(asked, index, lambda _, cosine: ivf.nearest_lists(cosine, filled, 4))
    assert wanted.count() == 60 * 4


def test_probes_reach_the_recall_that_was_measured(index, tables, exact):
    probes, measured = ivf.probes_for(tables[0], index, 7, 0.95)
    assert measured >= 0.95 and 1 <= probes <= len(index.sizes) // 2
    found = ivf.search_probes(tables[0], index, 7, probes)
    assert ivf.recall_of(found, exact) >= 0.93
    assert ivf.recall_of(ivf.search_probes(tables[0], index, 7, len(index.sizes)), exact) == 1
    assert ivf.recall_of(ivf.search_probes(tables[0], index, 7, 1), exact) < 1


def test_parts_of_a_hot_list_are_bounded(index, tables):
    """The list of 700 copies is cut, so no task holds more than a part of it."""
    assert index.sizes.max() >= 700
    seen = []
    whole = ivf.best_in_block

    def noted(some, known, k):
        assert len(known) < 2 * 50 and len(some) < 2 * 20
        return whole(some, known, k)

    ivf.best_in_block = noted
    try:
        seen = rows(ivf.search_probes(tables[0], index, 7, 3, 20, 50))
    finally:
        ivf.best_in_block = whole
    assert seen


def test_empty_tables_and_few_vectors(spark, tables):
    none_known, none_asked = spark.createDataFrame([], P), spark.createDataFrame([], Q)
    empty = ivf.build_index(none_known)
    assert ivf.search(tables[0], empty, 3).count() == 0
    few = ivf.build_index(tables[1].where("profile_id < 3"))
    assert ivf.search(none_asked, few, 3).count() == 0 and ivf.probes_for(none_asked, few, 3) == (1, 1.0)
    assert ivf.search(tables[0].where("question_id < 5"), few, 9).count() == 15


def test_workers_hold_few_cosines_and_give_few_rows_at_once(index, tables, exact, monkeypatch):
    """Questions of a block are multiplied a few at a time, and a question is repeated for each pack of lists, not for each list."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from voicegrain.operators import retrieval

    held = []
    whole = retrieval.lowest_in_rows
    rnd = np.random.default_rng(3)
    known = pd.DataFrame({"profile_id": range(900), "vector": list(rnd.integers(-1, 2, (900, 3)).astype(float))})
    asked = pd.DataFrame({"question_id": range(200), "vector": list(rnd.integers(-1, 2, (200, 3)).astype(float))})
    with monkeypatch.context() as patch:
        patch.setattr(retrieval, "CELLS", 5000)
        patch.setattr(retrieval, "lowest_in_rows", lambda negative, k: (held.append(negative.size), whole(negative, k))[1])
        found = retrieval.best_in_block(asked, known, 6)
    cosine = np.round(retrieval.unit_rows(asked["vector"]) @ retrieval.unit_rows(known["vector"]).T, 9)
    best = np.argsort(-cosine, axis=1, kind="stable")[:, :6]
    assert held and max(held) <= 5000
    assert found["profile_id"].tolist() == best.ravel().tolist()
    assert found["similarity"].tolist() == np.take_along_axis(cosine, best, axis=1).ravel().tolist()

    batch = pa.record_batch({"vector": [[1.0]] * 10_000})
    pieces = list(ivf.few_rows([batch], ivf.MAX_LISTS))
    assert max(p.num_rows for p in pieces) * ivf.MAX_LISTS <= ivf.CELLS and sum(p.num_rows for p in pieces) == 10_000
    packs = ivf.packs_of(index.sizes, 400)
    held = np.bincount(packs, index.sizes)
    assert all(n <= 400 or (packs == p).sum() == 1 for p, n in enumerate(held)) and len(held) <= 12
    everything = ivf._wanted(tables[0].where("vector is not null"), index, lambda _, cosine: np.ones(cosine.shape, bool), packs)
    assert everything.count() == 62 * len(held)
    assert rows(ivf.search_probes(tables[0], index, 7, len(index.sizes), 1024, 400)) == rows(exact)
