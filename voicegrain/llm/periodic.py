"""Maximal runs of a word sequence that repeats itself four times or more, in documents of any length.

For each octave of periods, ``2**k`` to below ``2**(k+1)``, a document is cut into overlapping tiles with an anchor
every ``2**k`` words. A run of period q and four periods or more holds an anchor b with all of [b, b + 3q), and within
an octave at most one period that is not a multiple of a smaller one can do so at an anchor. Hashes of windows of
``2**(k+1)`` words show exactly which anchors may; tiles without any are not made. The others are rows of their own:
dealt out over the cluster and solved independently, with Z-functions from each anchor to both ends of its
tile. What comes back are fragments of runs, clipped by their tiles. They are shuffled by document and period and
stitched where they overlap by a period or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from voicegrain.llm.shared import WORD, bounded_batches, stored, text_of

#: A run has at least so many periods and so many words.
PERIODS = 4
LEAST_WORDS = 6

#: Words that a tile of a small octave holds; tiles of a large one hold so many anchors.
TILE_WORDS = 4096
TILE_ANCHORS = 8

M1, M2, S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def split_words(text: str | None) -> list[bytes]:
    """Words in UTF-8; bytes are split at exactly the white space of the contracts."""
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int32, len(words))


def doubled(window: np.ndarray, half: int) -> np.ndarray:
    """Hashes of windows of twice ``half`` words from those of ``half`` words."""
    h = (window[:-half] * M1 + window[half:]) * M2
    h ^= h >> S
    h *= M1
    return h ^ (h >> S)


def prime_factors(n: int) -> list[int]:
    """Each prime factor once."""
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1 if f == 2 else 2
    return [*out, n] if n > 1 else out


def equal_windows(low: np.ndarray, size: int, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length`` words (``size`` to twice as many) from ``x`` and from ``y`` on are equal, by windows of ``size``."""
    tail = length - size
    return (low[x] == low[y]) & (low[x + tail] == low[y + tail])


def anchors(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each octave k the anchors b, multiples of ``2**k``, with a period p of the octave that spans [b, b + 3p) and
    is not the multiple of a smaller period there."""
    n = len(codes)
    here = codes.astype(np.uint64) * M2 + M1  # windows of 2**k words
    here ^= here >> S
    before = here  # windows of half as many
    step, k = 1, 0
    while PERIODS * step <= n:
        after = doubled(here, step)  # windows of 2 * step words
        m = len(after)
        # a row per anchor: offsets 0 to step - 1 from it; the row below holds the periods of the octave
        rows = -(-m // step)
        padded = np.zeros(rows * step, np.uint64)
        padded[:m] = after
        grid = padded.reshape(rows, step)
        same = grid[1:] == grid[:-1, :1]
        first = same.argmax(1)
        b = np.flatnonzero(same[np.arange(len(first)), first])
        p = step + first[b]
        b *= step
        fits = b + 3 * p <= n
        b, p = b[fits], p[fits]
        if len(b):  # [b, b + 2p) equals [b + p, b + 3p)
            whole = equal_windows(after, 2 * step, b, b + p, 2 * p)
            b, p = b[whole], p[whole]
        if len(b) and k:
            b = b[~has_smaller_period(before, here, step, b, p)]
        if len(b):
            yield k, b
        before, here = here, after
        step *= 2
        k += 1


def has_smaller_period(before: np.ndarray, here: np.ndarray, step: int, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the p words from b on repeat a part of them, p a multiple of its length.

    The parts to try are p divided by each of its prime factors; ``step <= p < 2 * step``.
    """
    out = np.zeros(len(b), bool)
    kinds, which = np.unique(p, return_inverse=True)
    for i, period in enumerate(kinds.tolist()):
        at = b[which == i]
        small = np.zeros(len(at), bool)
        for f in prime_factors(period):
            q = period // f
            length = period - q  # from half a period, so windows of step / 2 or of step words cover it
            window, size = (here, step) if length >= step else (before, step // 2)
            small |= equal_windows(window, size, at, at + q, np.int64(length))
        out[which == i] = small
    return out


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Octave, first word, words and anchors (counted from the first word) of each tile that may hold part of a run.

    A tile reaches from ``2**k`` words before its first anchor to ``7 * 2**k`` behind its last, so that the first and
    last anchors inside a run see its ends.
    """
    for k, found in anchors(codes):
        step = 1 << k
        width = step * max(TILE_ANCHORS, TILE_WORDS // step)
        place = found // width
        edges = np.flatnonzero(np.diff(place)) + 1
        for part in np.split(found, edges):
            start = max(0, int(part[0]) - step)
            yield k, start, codes[start : int(part[-1]) + 7 * step], part - start


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest common prefix of the list and of the list from there on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        t = 0
        if i < right:
            t = z[i - left]
            if t < right - i:
                z[i] = t
                continue
            t = right - i
        while i + t < n and s[t] == s[i + t]:
            t += 1
        z[i] = t
        if i + t > right:
            left, right = i, i + t
    return z


def fragments(k: int, start: int, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
    """``period, start, end`` of the stretches around a tile's anchors, those that belong together joined.

    The Z-function from an anchor to the right gives the words common to b and b + p for every p; the one to
    the left, of the tile read backwards from the end of the first period, those before them.
    """
    step, codes = 1 << k, words.tolist()
    out: list[list[int]] = []
    for b in at.tolist():
        if out and b + 3 * out[-1][0] <= out[-1][2] and step <= out[-1][0]:
            continue  # inside the stretch found last, which the tile shows as far as this anchor could
        z = z_function(codes[b : b + 7 * step])
        for p in range(step, min(2 * step, len(z))):
            if z[p] >= 2 * p:
                break
        else:
            continue
        # the stretch goes on to the right as far as the tile does
        end = b + p + z[p]
        if end == b + 7 * step:
            while end < len(codes) and codes[end] == codes[end - p]:
                end += 1
        back = z_function(codes[max(0, b - step) : b + p][::-1])
        left = back[p] if p < len(back) else 0
        first = b - min(left, step)
        if out and out[-1][0] == p and first <= out[-1][2] - p:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([p, first, end])
    return [(p, start + a, start + z) for p, a, z in out]


FOUND = "row bigint, octave int, start bigint, words binary, anchors binary"


def runs(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """``row, start, length, period`` of every run of each document; ``row`` identifies a document (never null).

    A run is a stretch of words with smallest period q, of at least ``LEAST_WORDS`` words and ``PERIODS`` periods, that no
    neighbouring word extends. Null and empty texts have none; runs are whole however long a text is.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            rows, octaves, starts, words, ats = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = 0
                for k, start, codes, at in tiles(numbered(split_words(t.as_py()))):
                    rows.append(i)
                    octaves.append(k)
                    starts.append(start)
                    words.append(codes.tobytes())
                    ats.append(at.astype(np.int32).tobytes())
                    held += len(words[-1])
                    if held > 1 << 22:
                        yield record(rows, octaves, starts, words, ats)
                        rows, octaves, starts, words, ats, held = [], [], [], [], [], 0
            yield record(rows, octaves, starts, words, ats)

    def record(rows, octaves, starts, words, ats):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(octaves, pa.int32()), pa.array(starts, pa.int64()),
             pa.array(words, pa.binary()), pa.array(ats, pa.binary())], ["row", "octave", "start", "words", "anchors"]
        )

    def solve(batches):
        for batch in batches:
            found = [
                (i, *f)
                for i, k, start, words, at in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for f in fragments(k, start, np.frombuffer(words, np.int32), np.frombuffer(at, np.int32))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[c] for f in found], pa.int64()) for c in range(4)], ["row", "period", "low", "high"]
            )

    slim = docs.select(F.col(f"`{row}`").cast("bigint").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    dealt = slim.mapInArrow(cut, FOUND).repartition("row", "octave", "start")
    return stitched(dealt.mapInArrow(solve, "row bigint, period bigint, low bigint, high bigint"))


def stitched(fragments_: DataFrame) -> DataFrame:
    """Runs from fragments ``row, period, low, high``: those of a document and period that overlap by a period are one."""
    order = Window.partitionBy("row", "period").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = F.col("low") > F.coalesce(reached, F.lit(-1)) - F.col("period")
    pieces = fragments_.withColumn("_new", F.coalesce(parted, F.lit(True)).cast("int")).withColumn(
        "_part", F.sum("_new").over(order)
    )
    whole = pieces.groupBy("row", "period", "_part").agg(F.min("low").alias("start"), F.max("high").alias("_end"))
    return whole.select("row", "start", (F.col("_end") - F.col("start")).alias("length"), "period").where(
        (F.col("length") >= LEAST_WORDS) & (F.col("length") >= PERIODS * F.col("period"))
    )


def with_runs(docs: DataFrame, text: str = "text", row: str = "row") -> DataFrame:
    """``docs`` and ``runs``: an array of ``start, length, period`` by start, then period; empty without any.

    The runs of a document are fewer than its words, and are gathered by document as its text is.
    """
    found = runs(docs, text, row).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    ordered = F.transform("_runs", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")))
    return docs.join(found.withColumnRenamed("row", "_row"), F.col(f"`{row}`") == F.col("_row"), "left").withColumn(
        "runs", F.coalesce(ordered, F.array().cast(kind))
    ).drop("_row", "_runs")


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds behind its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)] if found else words


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_runs``, the run with most periods (``start, length, period, exponent_milli``), ``runs_sha256`` and
    ``collapsed_sha256`` of every document.

    Null texts count as empty. Null and repeated ids are rows of their own; other columns are left out. Without a run
    the four values are null and the digests are those of no lines and of all words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))

    def screened(batches):
        """Documents without any tile are settled; only the others keep their texts."""
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [split_words(t) for t in texts]
            some = [next(anchors(numbered(w)), None) is not None for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t if x else None for t, x in zip(texts, some, strict=True)], pa.string()),
                 pa.array([None if x else sha(b" ".join(w)) for w, x in zip(words, some, strict=True)], pa.string())],
                ["doc_id", "text", "plain_sha256"],
            )

    # row numbers are written down, so a task that runs again cannot change them
    kept = stored(plain.mapInArrow(screened, "doc_id bigint, text string, plain_sha256 string").withColumn(
        "row", F.monotonically_increasing_id()))
    open_ = with_runs(kept.where("plain_sha256 is null").select("row", "doc_id", "text"))
    settled = kept.where("plain_sha256 is not null").select(
        "doc_id", F.lit(0).cast("bigint").alias("n_runs"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(sha(b"")).alias("runs_sha256"), F.col("plain_sha256").alias("collapsed_sha256"),
    )

    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, " \
             "runs_sha256 string, collapsed_sha256 string"

    def told(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for t, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                found = [(r["start"], r["length"], r["period"]) for r in found]
                best = most_periods(found)
                lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
                top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                row = (len(found), *top, sha(lines.encode()), sha(b" ".join(collapsed(split_words(t), found))))
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in out[:5]], *[pa.array(x, pa.string()) for x in out[5:]]],
                [f.split()[0] for f in schema.split(", ")],
            )

    return open_.select("doc_id", "text", "runs").mapInArrow(told, schema).unionByName(settled)


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def most_periods(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length in periods; of equal ones the leftmost, then the one of smallest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def with_planted_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts end in a run where the crc32 of the id as text is divisible by ten; others stay as they are."""
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    words = F.regexp_extract_all(text_of(F.col(f"`{text}`")), F.lit(f"({WORD})"), F.lit(1))

    def planted(found: Column) -> Column:
        n, g = F.size(found), F.floor(h / 10)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(place, lambda i: F.element_at(found, i.cast("int") + 1)), " ")

    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    new = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))[0]
    return docs.withColumn(text, F.when(chosen, new).otherwise(F.col(f"`{text}`")))
