"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Half of the labelled documents propose cutoffs, the other half judges them. Each stratum has one sequence of steps, a
cutoff for every rule in each, from the mildest on: a step passes if, were the true rate of good documents rejected by
any rule at the limit, so few rejections on the holdout would have a probability of at most ``doubt``, by the exact
binomial distribution. The first failure ends the sequence, which needs no further correction; ``doubt`` is divided among
the sequences. Strata with too few labels to prove any step share one sequence, whose bound holds for them together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches, stored
from voicegrain.operators.skew import lookup_join

SPACE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOL_BYTES = b"#*$%&|<>"
WINDOW = 5

#: Measures of a document, each rejected above its stratum's cutoff: counts and what they are divided by.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "repeats": ("n_repeat_words", "n_words"),
    "lines": ("n_dup_lines", "n_words"),
    "length": ("word_chars", "n_words"),
}

#: Shares of the proposing half that lie below the candidate cutoffs, mildest first.
SHARES = [0.9995, 0.999, 0.998, 0.996, 0.994, 0.992, 0.99, 0.985, 0.98, 0.975, 0.97, 0.96, 0.95, 0.94, 0.92, 0.9,
          0.88, 0.86, 0.84, 0.82, 0.8, 0.75, 0.7]

#: Steps before those: how far the cutoffs lie above the proposing half's good documents, in parts of the way to its
#: highest value or, if that is more, of the good ones' own highest value.
MARGINS = [1.0, 0.5, 0.25, 0.1, 0.05, 0.02]
STEPS = len(MARGINS) + len(SHARES)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    m = n - WINDOW + 1
    code = ids[:m]
    width = n
    for k in range(1, WINDOW):
        if width * n >= 1 << 62:  # too wide to pack further: number the distinct codes anew
            code = np.unique(code, return_inverse=True)[1]
            width = n
        code = code * n + ids[k : k + m]
        width *= n
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : k + m] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # of bytes, exactly the white space of SPACE_BYTES
    spaces = len(raw) - len(raw.translate(None, SPACE_BYTES))
    symbols = len(raw) - len(raw.translate(None, SYMBOL_BYTES))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """``doc_id, stratum`` and the five counts; null texts have none, null strata count as empty ones."""
    def batches(parts):
        for part in parts:
            rows = [measure(t.as_py()) for t in part.column("text")]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *columns],
                                             ["doc_id", "stratum", *COUNTS])

    bounded_batches(docs.sparkSession)
    slim = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("")).alias("stratum"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    return slim.mapInArrow(batches, "doc_id bigint, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def with_base(counted: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def value(rule: str):
    count, per = RULES[rule]
    return F.col(count) / F.greatest(F.col(per), F.lit(1))


def binomial_tail(k: int, n: int, rate: float) -> float:
    """P(X <= k) for n trials of probability ``rate``."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def safe_cutoff(cutoffs: Sequence[float], rejected: list[int], n: int, rate: float, doubt: float) -> float | None:
    """The last cutoff of the sequence before the first that is not proven; None if the first is not."""
    best = None
    for cutoff, k in zip(cutoffs, rejected, strict=True):
        if n == 0 or binomial_tail(k, n, rate) > doubt:
            break
        best = cutoff
    return best


def least_judges(sequences: int, rate: float, doubt: float) -> int:
    """Good documents that prove a step if none of them is rejected."""
    return math.ceil(math.log(doubt / sequences) / math.log1p(-rate))


def tested_alone(sizes: list[tuple[str, int]], strata: int, rate: float, doubt: float) -> tuple[list[str], int]:
    """Strata with enough good judging documents for a sequence of their own, and the number of sequences.

    ``sizes`` holds at least the strata that would do as the only one; ``strata`` is the number of all.
    """
    sizes = sorted(sizes, key=lambda x: (-x[1], x[0]))
    for k in range(len(sizes), 0, -1):
        sequences = k + (k < strata)
        if sizes[k - 1][1] >= least_judges(sequences, rate, doubt):
            return [s for s, _ in sizes[:k]], sequences
    return [], 1


def steps_of(rule: str):
    """Cutoffs of a rule, mildest first and never rising."""
    top, good = F.col(f"{rule}_top"), F.coalesce(f"{rule}_good", f"{rule}_top")
    steps = [good + m * F.greatest(top - good, good) for m in MARGINS] + [F.get(f"{rule}_below", i) for i in range(len(SHARES))]
    return F.array(steps[0], *[F.least(*steps[: i + 1]) for i in range(1, STEPS)])


def fit_cutoffs(
    measured: DataFrame, labels: DataFrame, most_rejected: float = 0.02, doubt: float = 0.05, key: str = "doc_id"
) -> DataFrame:
    """``stratum`` and one cutoff per rule (null: no step is proven, nothing is rejected there), for labelled strata.

    With a confidence of ``1 - doubt`` over all sequences at once, all rules together reject at most ``most_rejected`` of
    a stratum's good documents, or of those of all strata that share a sequence. ``labels`` holds ``key, quality``; null
    labels are left out and of repeated ones the highest counts.
    """
    known = labels.select(F.col(key).alias("doc_id"), F.col("quality")).where("quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    proposes = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    labelled = stored(measured.where(~F.col("base_failed")).join(known, "doc_id").select(
        "stratum", "quality", proposes.alias("proposes"), *[value(r).alias(r) for r in RULES]
    ))
    judges = stored(labelled.where("not proposes and quality = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    enough = judges.where(F.col("n") >= least_judges(1, most_rejected, doubt)).collect()  # at most one of so many labels
    alone, sequences = tested_alone([(r.stratum, r.n) for r in enough], judges.count(), most_rejected, doubt)
    own = labels.sparkSession.createDataFrame([(s, f"={s}") for s in alone], "stratum string, _own string")

    def with_sequence(df):
        return lookup_join(df, own, "stratum", "left").withColumn("sequence", F.coalesce("_own", F.lit("shared"))).drop("_own")

    # strata without a judging document have no part in any bound
    grouped = with_sequence(lookup_join(labelled, judges.select("stratum"), "stratum"))
    ends = grouped.where("proposes").groupBy("sequence").agg(
        *[F.percentile_approx(r, F.array(*[F.lit(s) for s in SHARES]), F.lit(10_000)).alias(f"{r}_below") for r in RULES],
        *[F.max(r).alias(f"{r}_top") for r in RULES], *[F.max(F.when(F.col("quality") == 1, F.col(r))).alias(f"{r}_good") for r in RULES],
    )
    grid = ends.select("sequence", *[steps_of(r).alias(f"{r}_at") for r in RULES])
    good = lookup_join(grouped.where("not proposes and quality = 1"), grid, "sequence")

    def rejected(i):
        return reduce(lambda a, b: a | b, [F.col(r) > F.get(f"{r}_at", i) for r in RULES])

    tests = good.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(f"{r}_at").alias(f"{r}_at") for r in RULES],
        F.array(*[F.sum(rejected(i).cast("bigint")) for i in range(STEPS)]).alias("over"),
    )

    def choose(parts):
        for part in parts:
            rows = part.to_pylist()
            steps = [safe_cutoff(range(STEPS), r["over"], r["n"], most_rejected, doubt / sequences) for r in rows]
            found = [[None if i is None else r[f"{x}_at"][i] for x in RULES] for i, r in zip(steps, rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("sequence"), *[pa.array([f[i] for f in found], pa.float64()) for i in range(len(RULES))]],
                ["sequence", *RULES],
            )

    proven = tests.mapInArrow(choose, "sequence string, " + ", ".join(f"{r} double" for r in RULES))
    return lookup_join(with_sequence(judges.select("stratum")), stored(proven), "sequence").select("stratum", *RULES)


def judge(docs: DataFrame, labels: DataFrame, most_rejected: float = 0.02, doubt: float = 0.05, **names) -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Empty and null texts fail the base rule; a stratum without labelled good documents rejects by the base rule alone,
    and so do those with too few of them if even together they prove nothing. Null and repeated ids are rows of their own; other columns are left out.
    """
    measured = stored(with_base(with_counts(docs, **names)))
    cutoffs = stored(fit_cutoffs(measured, labels, most_rejected, doubt)).select(
        "stratum", *[F.col(r).alias(f"_{r}") for r in RULES]
    )
    bad = reduce(lambda a, b: a | b, [F.coalesce(value(r) > F.col(f"_{r}"), F.lit(False)) for r in RULES])
    return lookup_join(measured, cutoffs, "stratum", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept")
    )
