"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from voicegrain.llm import periodic
from voicegrain.llm.periodic import anchors, collapsed, fragments, numbered, tiles, z_function

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, row long, runs int, octave int, _part int"


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                found.append((i, j + q - i, q))
                i = j + 1
            else:
                i += 1
    smallest = {}
    for start, length, q in found:
        if length >= max(6, 4 * q):
            smallest.setdefault((start, length), q)
    return sorted((start, length, q) for (start, length), q in smallest.items())


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def stretched(rnd, n, letters):
    words = [f"w{rnd.randrange(letters)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        if n > 10:
            a, p = rnd.randrange(n), rnd.randint(1, n // 5 + 1)
            for i in range(a, min(n, a + rnd.randint(1, 8) * p)):
                words[i] = words[a + (i - a) % p]
    return words


def stitch(found):
    out = []
    for p, low, high in sorted(found):
        if out and out[-1][0] == p and low <= out[-1][2] - p:
            out[-1][2] = max(out[-1][2], high)
        else:
            out.append([p, low, high])
    return sorted((a, z - a, p) for p, a, z in out if z - a >= max(6, 4 * p))


@pytest.mark.parametrize(("width", "most"), [(4096, 8), (1, 1), (16, 2)])
def test_tiles_of_any_width_give_all_runs(monkeypatch, width, most):
    monkeypatch.setattr(periodic, "TILE_WORDS", width)
    monkeypatch.setattr(periodic, "TILE_ANCHORS", most)
    rnd = random.Random(width)
    for _ in range(300):
        words = stretched(rnd, rnd.randint(0, 160), rnd.choice([1, 2, 3, 50]))
        assert stitch([f for t in tiles(numbered(words)) for f in fragments(*t)]) == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_any_short_sequence(words):
    assert stitch([f for t in tiles(numbered(words)) for f in fragments(*t)]) == brute_runs(words)


@given(st.lists(st.integers(0, 1), max_size=30))
def test_z_function(s):
    def common(i):
        n = 0
        while i + n < len(s) and s[n] == s[i + n]:
            n += 1
        return n

    assert z_function(s) == [common(i) for i in range(len(s))]


def test_multiples_of_a_period_make_no_tiles():
    found = list(anchors(numbered(["a", "b", "c"] * 2000)))
    assert [k for k, _ in found] == [1]  # period 3 lies in the octave of 2 and 3


def test_tiles_are_bounded_for_a_long_document():
    made = list(tiles(np.arange(40_000, dtype=np.int32) % 700))
    assert len(made) > 3 and {k for k, *_ in made} == {9}
    assert max(len(words) for _, _, words, _ in made) <= 512 * (periodic.TILE_ANCHORS + 8)
    assert stitch([f for t in made for f in fragments(*t)]) == [(0, 40_000, 700)]


def test_collapsed_keeps_the_first_period_of_overlapping_runs():
    words = list("abababababccccccccc")
    assert "".join(collapsed(words, brute_runs(words))) == "abc"


def table():
    rnd = random.Random(5)
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(stretched(rnd, rnd.randint(1, 300), 50))) for i in planted]
    rows += [(1000 + i, "\n".join(stretched(rnd, rnd.randint(0, 200), 3))) for i in range(60)]
    rows += [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "la " * 20_000), (6, "a\x85b a\x85b a b"), (7, "x" * 50_000),
        (None, "no no no no no no no"), (None, "no no no no no no no"), (8, "so " * 9), (8, "so " * 9), (8, "other text"),
        (planted[0], None), (planted[1], "  "), (planted[2], "é 日本 " * 40),
        (9, " ".join(f"w{i % 997}" for i in range(20_000))),
    ]
    return rows


def test_query_equals_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame([(i, t, "en", 7, 1, 2, 3) for i, t in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in periodic.digests(periodic.with_planted_runs(docs)).collect()]
    assert sorted(got, key=repr) == sorted((brute_row(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 50


def test_without_planting_and_of_nothing(spark):
    docs = spark.createDataFrame([(0, "go " * 8 + "on"), (0, "go on")], "doc_id long, text string")
    assert sorted((r.n_runs, r.start, r.length) for r in periodic.digests(docs).collect() if r.n_runs) == [(1, 0, 8)]
    assert periodic.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    found = periodic.runs(docs.selectExpr("text", "1L + length(text) as row")).collect()
    assert [(r.start, r.length, r.period) for r in found] == [(0, 8, 1)]
