"""Row counts at the borders of a job's stages, taken while its rows pass by.

    with counting() as counts:
        result = jobs.extract_from_posts(...)
    result.write.parquet(path)
    counts.check()

Counts are observed metrics of the job's own plan: no job is run for them. They can be read once the result has been
written or collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, functions as F

_active: ContextVar[StageCounts | None] = ContextVar("_active", default=None)


class StageCounts:
    def __init__(self):
        self._seen: dict[str, Observation] = {}
        self._rules: dict[str, int] = {}

    def observe(self, df: DataFrame, stage: str, at_least: int = 0, **more: Column) -> DataFrame:
        """``df`` with its rows, and the sums of ``more``, counted as ``stage``; a stage met again gets a number."""
        name, k = stage, 1
        while name in self._seen:
            k += 1
            name = f"{stage} {k}"
        self._seen[name], self._rules[name] = Observation(), at_least
        return df.observe(self._seen[name], F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in more.items()])

    def read(self) -> dict[str, dict[str, int]]:
        """What each stage counted; waits for the job that carries the counts."""
        return {stage: dict(seen.get) for stage, seen in self._seen.items()}

    def check(self) -> None:
        """An error if a stage has fewer rows than it must have."""
        short = {stage: found["rows"] for stage, found in self.read().items() if found["rows"] < self._rules[stage]}
        if short:
            raise ValueError(f"stages with too few rows: {short}")


@contextmanager
def counting() -> Iterator[StageCounts]:
    """Stages of the jobs called inside are counted."""
    counts = StageCounts()
    token = _active.set(counts)
    try:
        yield counts
    finally:
        _active.reset(token)


def counted(df: DataFrame, stage: str, at_least: int = 0) -> DataFrame:
    """``df``, counted as ``stage`` inside ``counting()``; otherwise as it is."""
    counts = _active.get()
    return df if counts is None else counts.observe(df, stage, at_least)
