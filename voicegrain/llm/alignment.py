"""Alignment of two tokenizers' tokens over the same bytes, by skipping along diagonals.

Both token sequences become arrays of byte offsets at which tokens end. While tokens end together one by one, the two
indexes differ by a constant shift; probes of doubling length compare the arrays at that shift and jump over the whole
stretch. Behind it the side that lags moves on until both end together again; the shift is what it then is.

Linked tokens end together, so the bytes of one are the end of the other's. The vocabularies alone therefore bound the
pairs that can ever be linked, and counts of all pairs in the corpus fit an array of that fixed size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches, stored

SPACE_MARK = "▁"

#: Texts longer than so many characters are encoded in pieces.
PIECE_CHARS = 1 << 18

#: The fast encoder is kept from stretches of so many characters without a space; its time grows with their square.
LONG_WORD = 2000

#: A space between two characters that are no kind of space: no token of either tokenizer reaches across its front.
_NO_SPACE = f"[^\\s\u180e\u200b{SPACE_MARK}]"
_SAFE_SPACE = re.compile(f"(?<={_NO_SPACE}) (?={_NO_SPACE})")
_LONG_WORD = re.compile(f"\\S{{{LONG_WORD}}}")


def byte_of_letter() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def byte_level_bytes(vocabulary_file: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    with open(vocabulary_file, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    letters = byte_of_letter()
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(map(letters.__getitem__, entry))
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each id of a SentencePiece model: the mark is a space, <0xHH> a byte."""
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]


def possible_links(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs of ids of which one's bytes end the other's, as ``a * len(b) + b``, sorted."""
    by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
    for ids, side in zip(by_bytes, (a, b), strict=True):
        for i, raw in enumerate(side):
            if raw:
                ids.setdefault(raw, []).append(i)
    of_a, of_b = by_bytes
    pairs = {x * len(b) + y for raw, xs in of_a.items() for k in range(len(raw)) for y in of_b.get(raw[k:], ()) for x in xs}
    pairs |= {x * len(b) + y for raw, ys in of_b.items() for k in range(len(raw)) for x in of_a.get(raw[k:], ()) for y in ys}
    return np.array(sorted(pairs), np.int64)


def stretches(a: list[int], b: list[int]) -> list[int]:
    """``i, j, n`` for each stretch, one after the other: the tokens i to i + n - 1 of one side and j to j + n - 1 of the
    other end together, one by one.

    ``a`` and ``b`` are rising ends whose last ones are equal. Stretches come in order; between them nothing ends together.
    """
    out = []
    i = j = 0
    most, other = len(a), len(b)
    while i < most:
        x, y = a[i], b[j]
        while x != y:  # the side that lags moves on
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        n, left = 1, min(most - i, other - j)
        while n < left and a[i + n] == b[j + n]:
            n += 1
            width = 2
            while n < left and a[i + n : i + n + width] == b[j + n : j + n + width]:
                n += width
                width *= 2
            while width > 2:
                width //= 2
                if a[i + n : i + n + width] == b[j + n : j + n + width]:
                    n += width
            n = min(n, left)
        out += (i, j, n)
        i, j = i + n, j + n
    return out


def fast_encoder(byte_file: str, entries: list[bytes]):
    """An encoder by ranks for a byte-level file of the usual pattern whose merges are numbered in their order, else None."""
    import public_tokenizers
    import tiktoken

    with open(byte_file, encoding="utf-8") as f:
        whole = json.load(f)
    model, cut = whole["model"], whole["pre_tokenizer"] or {}
    usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    changed = whole["normalizer"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not usual or changed:
        return None
    vocabulary = model["vocab"]
    first = len(byte_of_letter())
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocabulary[m] != first + i for i, m in enumerate(merges)) or len(vocabulary) != first + len(merges):
        return None
    ranks = {raw: i for i, raw in enumerate(entries) if raw}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """Both tokenizers, their tokens' bytes and the pairs that can be linked."""

    def __init__(self, byte_file: str, piece_file: str, links: np.ndarray | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(byte_file)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.bytes = byte_level_bytes(byte_file), piece_bytes(self.second)
        plain = [p for p in map(self.second.id_to_piece, range(self.second.get_piece_size())) if p.strip(SPACE_MARK)]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in plain):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in self.bytes]
        if not all(x.all() for x in self.sizes):
            raise ValueError("a token without bytes: ends do not rise")
        self.links = possible_links(*self.bytes) if links is None else links
        self.slots = slots_of(self.links)
        ids = [list(map(str, range(len(x)))) for x in self.sizes]
        # tokens as text with what follows: of either side inside a group, then at the end of their side
        self.marked = [i + "," for i in ids[0]] + [i + "|" for i in ids[0]] + [i + "," for i in ids[1]] + [i + ";" for i in ids[1]]
        self.fast = fast_encoder(byte_file, self.bytes[0])
        self.agreed: dict[str, bool] = {}
        self.ascii_agrees = self.fast is not None and self.agree(set(map(chr, range(128))))
        self.first_is_whole = {bytes([b]) for b in range(256)} <= set(self.bytes[0])

    def agree(self, characters: set[str]) -> bool:
        """Whether both encoders put each character into the same class. Characters are tried once."""
        for c in characters - self.agreed.keys():
            probe = f"a{c}a 1{c}1 {c}!{c}  {c} {c}{c}\n{c}"
            self.agreed[c] = self.fast.encode_ordinary(probe) == self.first.encode(probe, add_special_tokens=False).ids
        return all(map(self.agreed.__getitem__, characters))

    def first_ids(self, piece: str) -> list[int]:
        """By ranks where that gives the same ids, else by the library that the file is made for."""
        fits = self.fast is not None and (self.ascii_agrees and piece.isascii() or self.agree(set(piece)))
        if fits and not (len(piece) >= LONG_WORD and _LONG_WORD.search(piece)):
            return self.fast.encode_ordinary(" " + piece)
        return self.first.encode(" " + piece, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """Long texts in pieces, cut at spaces that neither tokenizer can tell from the start of a text."""
        out, start = [], 0
        while len(text) - start > PIECE_CHARS:
            cut = _SAFE_SPACE.search(text, start + PIECE_CHARS)
            if cut is None:
                break
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]] if out else [text]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both tokenizers; None where a side's bytes are not a space and the text."""
        if not text:
            return None
        ids = [[], []]
        for piece in self.pieces(text):
            raw = (" " + piece).encode()
            for side, found in enumerate((self.first_ids(piece), self.second.encode(piece))):
                # every byte is a token of the first vocabulary, so that its tokens give back any text
                if (side or not self.first_is_whole) and b"".join(map(self.bytes[side].__getitem__, found)) != raw:
                    return None
                ids[side].append(np.array(found, np.int32))
        return np.concatenate(ids[0]), np.concatenate(ids[1])

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of each group on both sides."""
        ends = [np.cumsum(sizes[ids]).tolist() for sizes, ids in zip(self.sizes, (a, b), strict=True)]
        found = np.array(stretches(*ends), np.int64).reshape(-1, 3)
        inside = np.arange(found[:, 2].sum()) - np.repeat(np.cumsum(found[:, 2]) - found[:, 2], found[:, 2])
        return np.repeat(found[:, 0], found[:, 2]) + inside, np.repeat(found[:, 1], found[:, 2]) + inside

    def shown(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """All groups as text: ids of a group's tokens, the one side's before the other's."""
        per_a, per_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(last_b + 1 - per_b, per_a)
        place_b = np.arange(len(b)) + np.repeat(last_a + 1, per_b)
        most, other = map(len, self.sizes)
        shown_a, shown_b = a.astype(np.int64), b + np.int64(2 * most)
        shown_a[last_a] += most
        shown_b[last_b] += other
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a] = shown_a
        shown[place_b] = shown_b
        return "".join(map(self.marked.__getitem__, shown.tolist()))[:-1]

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Positions of linked pairs among the possible ones."""
        pairs = a.astype(np.int64) * len(self.sizes[1]) + b
        out, left = np.empty(len(pairs), np.int32), np.arange(len(pairs))
        slot = first_slot(pairs, len(self.slots))
        while len(left):
            found = self.slots[slot]
            right = self.links[found] == pairs[left]
            out[left[right]] = found[right]
            if (found[~right] < 0).any():
                raise ValueError("tokens end together of which neither ends the other")
            left, slot = left[~right], (slot[~right] + 1) % len(self.slots)
        return out


def first_slot(pairs: np.ndarray, slots: int) -> np.ndarray:
    """Where the search for a pair starts; ``slots`` is a power of two."""
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def slots_of(links: np.ndarray) -> np.ndarray:
    """Places of pairs, each in the first slot from its own on that was free; -1 in empty ones. A quarter is used at most."""
    slots = np.full(1 << max(4, (4 * len(links) - 1).bit_length()), -1, np.int32)
    left = np.arange(len(links))
    slot = first_slot(links, len(slots))
    while len(left):
        free = slots[slot] < 0
        slots[slot[free]] = left[free]  # of several that want a slot one gets it
        waits = slots[slot] != left
        left, slot = left[waits], (slot[waits] + 1) % len(slots)
    return slots


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"


def aligned(
    docs: DataFrame, byte_file: str, piece_file: str, possible: np.ndarray, key: str = "doc_id", text: str = "text",
    with_groups: bool = False,
) -> DataFrame:
    """One row per document: its numbers of tokens and groups, the digest of its groups, and its links.

    ``links`` holds 32-bit positions in ``possible``, an aligner's table of pairs; ``with_groups`` adds the groups as
    text. Null texts, empty ones and those whose tokens' bytes are not a space and the text have no tokens.
    """
    bounded_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(possible)  # bounded by the vocabularies

    def run(batches):
        tool = Aligner(byte_file, piece_file, table.value)  # of this task alone, and gone with it
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = tool.tokens(text.as_py() or "")
                if found is None:
                    rows.append((0, 0, 0, 0, "", b"", ""))
                    continue
                a, b = found
                last_a, last_b = tool.groups(a, b)
                shown = tool.shown(a, b, last_a, last_b)
                links = tool.place(a[last_a], b[last_b])
                rows.append((len(a), len(b), len(last_a), len(links), hashlib.sha256(shown.encode()).hexdigest(),
                             links.tobytes(), shown if with_groups else None))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()] + [pa.string()] * with_groups
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in schema.split(", ")])

    schema = ALIGNED + (", groups string" if with_groups else "")
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def link_counts(found: DataFrame, possible: int) -> DataFrame:
    """``link, n``: how often each possible pair is linked in all documents. Each task adds its own up first."""
    def count(batches):
        total = np.zeros(possible, np.int64)
        for batch in batches:
            for links in batch.column("links").to_pylist():
                places, times = np.unique(np.frombuffer(links or b"", np.int32), return_counts=True)
                total[places] += times
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["link", "n"])

    return found.select("links").mapInArrow(count, "link bigint, n bigint").groupBy("link").agg(F.sum("n").alias("n"))


def link_table(tool: Aligner, found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each possible pair its count in the corpus, and whether that is the highest of its second id.

    The table has as many rows as the vocabularies allow pairs, whatever the size of the corpus.
    """
    counts = np.zeros(len(tool.links), np.int64)
    rows = link_counts(found, len(tool.links)).toArrow()
    counts[rows.column("link").to_numpy()] = rows.column("n").to_numpy()
    second = tool.links % len(tool.sizes[1])
    highest = np.zeros(len(tool.sizes[1]), np.int64)
    np.maximum.at(highest, second, counts)
    return counts, (counts == highest[second]) & (counts > 0)


def align_documents(docs: DataFrame, byte_file: str, piece_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every whole text.

    ``n_best`` links have the highest count of their second id, ``count_sum`` adds up the counts of all links. Texts that
    are null, empty or not given back by both tokenizers have zeros and an empty digest. Null and repeated ids are rows of
    their own; other columns are left out. Both files must be readable under the same path on every executor.
    """
    tool = Aligner(byte_file, piece_file)
    found = stored(aligned(docs, byte_file, piece_file, tool.links, key, text))
    table = docs.sparkSession.sparkContext.broadcast(link_table(tool, found))  # bounded by the vocabularies

    def judge(batches):
        counts, best = table.value
        for batch in batches:
            links = [np.frombuffer(x or b"", np.int32) for x in batch.column("links").to_pylist()]
            n_best = pa.array([int(best[x].sum()) for x in links], pa.int64())
            sums = pa.array([int(counts[x].sum()) for x in links], pa.int64())
            columns = {c: batch.column(c) for c in batch.schema.names if c != "links"}
            yield pa.RecordBatch.from_pydict({**columns, "n_best": n_best, "count_sum": sums})

    schema = ALIGNED.replace(", links binary", "") + ", n_best bigint, count_sum bigint"
    return found.mapInArrow(judge, schema)
