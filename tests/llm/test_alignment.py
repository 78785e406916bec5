"""Alignment of two tokenizers against ends compared as sets, and counts added up in dictionaries."""

import collections
import hashlib
import itertools
import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from voicegrain.llm import alignment
from voicegrain.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, links int, n_a string, n int"


@pytest.fixture(scope="module")
def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file()


@pytest.fixture(scope="module")
def tool(files):
    return alignment.Aligner(*files)


def odd_texts():
    rnd = random.Random(3)
    words = "the token izer don't we'll naïve café 日本語 😀 1234 x=1; foo_bar ... — ﬁ ½ straße Ωmega <s> </s> <|endoftext|>".split()
    made = [rnd.choice(["", " "]) + rnd.choice([" ", "  ", "\n", " \t "]).join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(150)]
    return made + [
        "a  b", " a b ", "a▁b", "x ▁y", " x y", "a\x1cb c", "a \x85 b", "a\x00b \x00", "﻿x y", "a​ b", " ", "\n",
        "x 　 y　 z", "᠎ a᠎ b", "one", "é", "a" * 5000, "ab " * 3000, " ", "<unk> <0x41>",
    ]


def direct(tool, text):
    """Ids by the libraries alone, from the whole text at once."""
    a = tool.first.encode(" " + text, add_special_tokens=False).ids
    b = tool.second.encode(text)
    raw = (" " + text).encode()
    same = all(b"".join(side[i] for i in ids) == raw for side, ids in zip(tool.bytes, (a, b), strict=True))
    return (a, b) if text and same else ([], [])


def brute_groups(tool, a, b):
    ends = [list(itertools.accumulate(len(side[i]) for i in ids)) for side, ids in zip(tool.bytes, (a, b), strict=True)]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        i, j = x, y
    return groups


def brute(tool, rows):
    counts, found = collections.Counter(), []
    for i, text in rows:
        a, b = direct(tool, text or "")
        groups = brute_groups(tool, a, b)
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, a, b, groups, links, shown))
    top = collections.Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [
        (i, len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(shown.encode()).hexdigest() if a else "")
        for i, a, b, groups, links, shown in found
    ]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_equals_brute_force(spark, files, tool):
    rows = [*enumerate(odd_texts()), (900, None), (901, ""), (None, "twice this"), (None, "twice this"), (902, "a b"), (902, "a b"), (902, "c")]
    docs = spark.createDataFrame([(i, t, "en", 1, "x", 2) for i, t in rows], SCHEMA).repartition(6)
    got = [tuple(r) for r in alignment.align_documents(docs, *files).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(brute(tool, rows), key=repr)
    assert sum(not r[1] for r in got) >= 4


def test_of_nothing(spark, files):
    found = alignment.align_documents(spark.createDataFrame([], SCHEMA), *files)
    assert found.count() == 0 and set(found.columns) == set(COLUMNS)


def test_groups_as_text(spark, files, tool):
    docs = spark.createDataFrame([(1, "unbelievable straße")], "doc_id long, text string")
    row = alignment.aligned(docs, *files, tool.links, with_groups=True).first()
    a, b = direct(tool, "unbelievable straße")
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute_groups(tool, a, b))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 200).flatmap(lambda n: st.tuples(
    st.just(n), st.sets(st.integers(1, n)), st.sets(st.integers(1, n)), st.booleans())))
def test_stretches_are_the_common_ends(made):
    n, x, y, alike = made
    a, b = sorted(x | {n}), sorted((x if alike else y) | {n})
    flat = alignment.stretches(a, b)
    found = list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))
    at = [(i + k, j + k) for i, j, m in found for k in range(m)]
    assert [a[i] for i, _ in at] == [b[j] for _, j in at] == sorted(set(a) & set(b))
    assert all(i + m < p or j + m < q for (i, j, m), (p, q, _) in zip(found, found[1:], strict=False))


def test_long_one_to_one_stretches_take_few_probes():
    class Counted(list):
        looks = 0

        def __getitem__(self, i):
            Counted.looks += 1
            return list.__getitem__(self, i)

    ends = list(range(1, 100_001))
    assert alignment.stretches(Counted(ends), Counted([*ends[:500], *ends[501:]])) == [0, 0, 500, 501, 500, 99_499]
    assert Counted.looks < 200


def test_tokens_are_those_of_the_whole_texts(tool, monkeypatch):
    texts = odd_texts()
    texts += ["".join(random.Random(i).choices(["a", " ", "  ", "\n", "é", "1", "'s", "\u3000", "\x1c", ".", "The"], k=30)) for i in range(500)]
    texts.append(" ".join(t for t in texts if "▁" not in t))
    assert all(tool.pieces(t) == [t] for t in texts)
    want = [direct(tool, t) for t in texts]
    for size in (5, 100, 1000, alignment.PIECE_CHARS):
        monkeypatch.setattr(alignment, "PIECE_CHARS", size)
        assert [([], []) if f is None else tuple(x.tolist() for x in f) for f in map(tool.tokens, texts)] == want


def test_encoders_that_disagree_on_a_character_are_told_apart(files):
    tool = alignment.Aligner(*files)
    tool.agreed["é"] = False
    asked = []
    whole = tool.first.encode

    class Noted:
        def encode(self, text, **more):
            asked.append(text)
            return whole(text, **more)

    tool.first = Noted()
    assert [x.tolist() for x in tool.tokens("brown fox")] == list(direct(tool, "brown fox"))
    del asked[:]
    tool.tokens("café brown fox")
    assert asked == [" café brown fox"]


@pytest.mark.parametrize(("part", "name", "value"), [
    ("pre_tokenizer", "use_regex", False), ("pre_tokenizer", "type", "Whitespace"), ("model", "ignore_merges", True), (None, "normalizer", {"type": "NFC"})])
def test_files_of_other_rules_are_left_to_their_library(files, tool, tmp_path, part, name, value):
    with open(files[0], encoding="utf-8") as f:
        whole = json.load(f)
    (whole if part is None else whole[part])[name] = value
    (tmp_path / "other.json").write_text(json.dumps(whole), encoding="utf-8")
    assert alignment.fast_encoder(files[0], tool.bytes[0]) is not None
    assert alignment.fast_encoder(str(tmp_path / "other.json"), tool.bytes[0]) is None


def test_every_possible_pair_has_its_place(tool):
    a, b = tool.links // len(tool.sizes[1]), tool.links % len(tool.sizes[1])
    assert (tool.place(a, b) == alignment.np.arange(len(a))).all()
    assert len(tool.place(a[:0], b[:0])) == 0


def test_links_stay_within_the_vocabularies(tool):
    assert len(tool.links) < sum(map(len, tool.bytes[0])) + sum(map(len, tool.bytes[1]))
    with pytest.raises(ValueError):
        tool.place(alignment.np.array([0]), alignment.np.array([31999]))
