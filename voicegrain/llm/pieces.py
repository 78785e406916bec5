"""SentencePiece encoding with merge-type vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text is cut where no piece of the vocabulary can reach across: in front of spaces and around characters that only
occur alone. Each part starts as single characters; the agenda holds the pairs that form a piece, best score
first and of equal ones the leftmost, and merges until it is empty. Characters outside the vocabulary become bytes.
Short parts go through their agendas side by side in numpy, long ones through a heap. Parts repeat, so a task keeps
their ids, up to a number of bytes, and lets go of them when it ends. In each Arrow batch every part that is new is checked
against the ``sentencepiece`` library, and the whole text is decoded by the library from its ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches

SPACE_MARK = "▁"

#: A task keeps the ids of the parts it has met: about so many bytes of late, and the generation before.
KEPT_BYTES = 20_000_000

#: What a kept part takes besides its characters and ids: two objects and their place in a dictionary.
KEPT_EACH = 180

#: Characters of text that are cut and learnt together.
LEARN_CHARS = 1_000_000

#: Symbols of parts, and places for them, that are merged side by side.
CELLS = 400_000

#: Parts up to the last of these lengths are merged side by side.
WIDTHS = [8, 16, 32, 64]

NONE = np.iinfo(np.int32).max
OUTSIDE = 1 << 20


class Agenda:
    """Encoder for a model file of type BPE with byte fallback, a dummy prefix and no normalisation."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [
            i for i in range(sp.get_piece_size())
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        ]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.cost = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece holds a space after another character: texts cannot be cut at spaces")
        self.alone = "".join(c for c in "\n\r\t" if c not in joined and c != SPACE_MARK)
        if not self.alone:
            raise ValueError("no control character stands alone: parts cannot be checked by themselves")
        stop = re.escape(self.alone)
        self.parts = re.compile(f"{SPACE_MARK}+[^{SPACE_MARK}{stop}]*|[^{SPACE_MARK}{stop}]+|[{stop}]").findall
        self.shown = [str(i) for i in range(sp.get_piece_size())]
        self.new: dict[str, bytes] = {}  # 32-bit ids
        self.old: dict[str, bytes] = {}
        self.held = 0

        # symbols are piece ids, and for characters outside the vocabulary OUTSIDE and their code point
        self.of_char = np.arange(OUTSIDE, OUTSIDE + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i

        def symbol(part: str) -> int | None:
            return self.ids.get(part, OUTSIDE + ord(part) if len(part) == 1 else None)

        pairs = [
            (left << 21 | right, self.cost[p], i)
            for p, i in self.ids.items() for k in range(1, len(p))
            if (left := symbol(p[:k])) is not None and (right := symbol(p[k:])) is not None
        ]
        pairs.sort()
        self.pair = np.array([x[0] for x in pairs] + [-1], np.int64)
        self.pair[-1] = np.iinfo(np.int64).max
        self.pair_cost = np.append(np.unique([x[1] for x in pairs], return_inverse=True)[1], NONE).astype(np.int32)
        self.pair_into = np.array([x[2] for x in pairs] + [-1], np.int32)

    def pairs_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and piece of each pair of symbols; ``NONE`` where they form no piece, or one is missing (-1)."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) << 21 | right)
        at = np.searchsorted(self.pair, key)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_cost[at], NONE), np.where(hit, self.pair_into[at], -1)

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge many parts side by side: a row of symbols each, -1 after the end and in the last column.

        Each row's costs are its agenda. A step takes the best pair of every row that has one, the leftmost of equal ones.
        """
        n, width = symbols.shape
        last = width - 1
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, last, dtype=np.int32), (n, 1))
        before[:, 0] = last  # the empty last column stands for "nothing there"
        after[:, last] = last
        cost, into = np.full((n, width), NONE, np.int32), np.full((n, width), -1, np.int32)
        cost[:, :last], into[:, :last] = self.pairs_of(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(n)
        while len(rows):
            i = cost[rows].argmin(1)
            some = cost[rows, i] < NONE
            rows, i = rows[some], i[some]
            j = after[rows, i]
            k = after[rows, j]
            h = before[rows, i]
            symbols[rows, i] = into[rows, i]
            symbols[rows, j] = -1
            cost[rows, j] = NONE
            after[rows, i] = k
            before[rows, k] = i
            here = symbols[rows, i]
            cost[rows, i], into[rows, i] = self.pairs_of(here, symbols[rows, k])
            cost[rows, h], into[rows, h] = self.pairs_of(symbols[rows, h], here)
        return symbols

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of many parts: short ones side by side, long ones one after the other."""
        out: list[list[int]] = [[]] * len(parts)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        low = 0
        for width in WIDTHS:
            found = np.flatnonzero((size > low) & (size <= width))
            for chosen in np.array_split(found, -(-len(found) * (width + 1) // CELLS) or 1):
                if len(chosen):
                    flat = np.frombuffer("".join([parts[i] for i in chosen]).encode("utf-32-le"), np.uint32)
                    rows = np.full((len(chosen), width + 1), -1, np.int64)
                    rows[np.arange(width + 1) < size[chosen, None]] = self.of_char[flat]
                    merged = self.merge_rows(rows)
                    left = merged >= 0
                    ends = np.cumsum(left.sum(1)).tolist()
                    ids = merged[left].tolist()
                    for i, a, b in zip(chosen.tolist(), [0, *ends], ends, strict=False):
                        out[i] = ids[a:b]
                    for r in np.flatnonzero((merged >= OUTSIDE).any(1)).tolist():
                        out[chosen[r]] = [
                            x for s in out[chosen[r]]
                            for x in ([s] if s < OUTSIDE else [self.bytes[b] for b in chr(s - OUTSIDE).encode()])
                        ]
            low = width
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self.encode_part(parts[i])
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of one part, by the agenda."""
        cost = self.cost
        symbols: list[str | None] = list(part)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            if (c := cost.get(symbols[i] + symbols[i + 1])) is not None:
                agenda.append((c, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != piece or len(left) == len(piece):
                continue  # one of the pair has been merged meanwhile
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (c, i, piece + symbols[k]))
            if (h := before[i]) >= 0 and (c := cost.get(symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (c, h, symbols[h] + piece))
        out = []
        for s in symbols:
            if s is not None:
                if (found := self.ids.get(s)) is not None:
                    out.append(found)
                else:
                    out += [self.bytes[b] for b in s.encode()]
        return out

    def check(self, parts: list[str], ids: list[list[int]]) -> None:
        """Compare with the library. It puts a space before its text, so each part follows a character that stands alone."""
        lead = self.alone[0]
        skip = len(self.library.encode(lead))
        found = self.library.encode([lead + p.replace(SPACE_MARK, " ") for p in parts], num_threads=1)
        for part, mine, theirs in zip(parts, ids, found, strict=True):
            if theirs[skip:] != mine:
                raise ValueError(f"the agenda's ids {mine} of {part!r} differ from the library's, {theirs[skip:]}")

    def learn(self, parts: set[str]) -> None:
        """Have all parts in ``new``: kept before, or encoded now and checked."""
        old, missing = self.old, []
        for p in parts - self.new.keys():
            if (found := old.get(p)) is None:
                missing.append(p)
            else:
                self.keep(p, found)
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            ids = self.encode_parts(some)
            self.check(some, ids)
            for p, x in zip(some, ids, strict=True):
                self.keep(p, array("i", x).tobytes())

    def keep(self, part: str, ids: bytes) -> None:
        self.new[part] = ids
        self.held += KEPT_EACH + len(part) + len(ids)

    def age(self) -> None:
        """Let go of what has not been used since ``new`` was last full."""
        if self.held > KEPT_BYTES:
            self.new, self.old, self.held = {}, self.new, 0

    def cut(self, text: str) -> list[str]:
        return self.parts(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Texts of ``LEARN_CHARS`` together, or one longer text, are cut and learnt together."""
        first = 0
        while first < len(texts):
            end, held = first, 0
            while end < len(texts) and (end == first or held + len(texts[end]) <= LEARN_CHARS):
                held += len(texts[end])
                end += 1
            cut = [self.cut(t) for t in texts[first:end]]
            self.learn(set(chain.from_iterable(cut)))
            known = self.new.__getitem__
            for parts in cut:
                yield array("i", b"".join(map(known, parts))).tolist()
            self.age()
            first = end


def encode_documents(docs: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``, ``decoded`` if asked for) of every whole text.

    A null text counts as empty and has no ids. Null and repeated ids are rows of their own; other columns are left out.
    The model file must be readable under the same path on every executor.
    """
    more = ", ids array<int>, decoded string" if with_ids else ""

    def digest(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def run(batches):
        agenda = Agenda(model_file)  # of this task alone: the worker keeps nothing of it
        shown = agenda.shown.__getitem__
        for batch in batches:
            n, of_ids, of_text, ids, decoded = [], [], [], [], []
            for found in agenda.encode([t or "" for t in batch.column("text").to_pylist()]):
                back = agenda.library.decode(found)
                n.append(len(found))
                of_ids.append(digest(",".join(map(shown, found))))
                of_text.append(digest(back))
                if with_ids:
                    ids.append(found)
                    decoded.append(back)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                       "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more)
