"""URL verdicts by rules and by a cascade of Bloom filters that is exact over the corpus's own keys.

Level 1 encodes the listed keys, level 2 the other keys that level 1 lets pass, level 3 the listed keys that
level 2 lets pass, and so on until a level lets no wrong key pass. A key is listed if the first level that
stops it is an even one, or if none stops it and the last is odd. The filters are literals of the query, so a
row is judged by its own expressions, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.llm.shared import BITMAP, bit_at, stored

#: A level spends so many bits and probes on each key that it encodes.
BITS_PER_KEY, PROBES = 8, 5

#: Filters of one pass; a larger list is cut by the keys' hashes and judged in several passes.
PASS_BYTES = 32 * 1024 * 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    seed: int
    banks: int
    bitmaps: bytes

    def lets_pass(self, key: Column) -> Column:
        blob = F.lit(bytearray(self.bitmaps))
        found = [bit_at(blob, self.bank(key) * BITMAP + place) for place in self.places(key)]
        out = found[0]
        for x in found[1:]:
            out = out & x
        return out

    def bank(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), key), F.lit(self.banks))

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(BITMAP)) for i in range(1, PROBES + 1)]


def encode(keys: DataFrame, seed: int) -> Level | None:
    """The filter of a table with a unique ``key``; None for an empty one."""
    n = keys.count()
    if not n:
        return None
    shape = Level(seed, max(1, math.ceil(n * BITS_PER_KEY / BITMAP)), b"")
    key = F.col("key")
    probes = keys.select(shape.bank(key).alias("bank"), F.explode(F.array(*shape.places(key))).alias("place"))
    made = {
        r.bank: bytes(r.bitmap)
        for r in probes.groupBy("bank").agg(F.bitmap_construct_agg("place").alias("bitmap")).collect()
    }
    return Level(seed, shape.banks, b"".join(made.get(i, bytes(BITMAP // 8)) for i in range(shape.banks)))


def cascade(universe: DataFrame) -> list[Level]:
    """Levels for a table of unique ``key, listed`` holding every key that will be asked for."""
    inside, outside = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key")
    levels: list[Level] = []
    while (level := encode(inside, len(levels) + 1)) is not None:
        levels.append(level)
        inside, outside = stored(outside.where(level.lets_pass(F.col("key")))), inside
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact membership of any key of the universe."""
    verdict = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        verdict = F.when(~levels[i].lets_pass(key), F.lit(i % 2 == 1)).otherwise(verdict)
    return verdict


def mark_listed(df: DataFrame, key: str, listed: DataFrame, out: str = "listed", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Add ``out``: whether ``key`` is among the keys of ``listed`` (one column, any number of repeats).

    A null key is never listed. The universe is the set of distinct keys of ``df``.
    """
    name = listed.columns[0]
    on_list = listed.select(F.col(name).alias("key")).where("key is not null").distinct().withColumn("_on", F.lit(True))
    universe = stored(
        df.select(F.col(key).alias("key")).where("key is not null").distinct().join(on_list, "key", "left")
        .select("key", F.coalesce("_on", F.lit(False)).alias("listed"))
    )
    n = universe.where("listed").count()
    passes = max(1, math.ceil(n * BITS_PER_KEY / 8 / pass_bytes))
    part = F.pmod(F.xxhash64(F.lit("pass"), F.col("key")), F.lit(passes))
    whole = None
    for i in range(passes):
        levels = cascade(universe.where(part == i) if passes > 1 else universe)
        mine = F.pmod(F.xxhash64(F.lit("pass"), F.coalesce(F.col(key), F.lit(""))), F.lit(passes)) == i
        rows = (df.where(mine) if passes > 1 else df).withColumn(
            out, F.coalesce(F.col(key).isNotNull() & is_listed(levels, F.col(key)), F.lit(False))
        )
        rows = stored(rows) if passes > 1 else rows
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty for null and for text without ``://``."""
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.instr(address, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def matching_rule(rules: list[tuple[str, str, str]]) -> Column:
    """``rule, verdict`` of the longest of ``(verdict, host, path)`` that fits ``host`` and ``path``; else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(
    pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url",
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` for every row of ``pages``.

    The longest fitting rule decides; else a page is blocked if its host and path are on the list ``listed`` (one
    column of such addresses, like ``example.com/en/7``). Null urls have an empty address. Repeated rows stay, other
    columns are left out, an empty list blocks nothing.
    """
    rows = with_host_and_path(pages.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("url"))).drop("url")
    rows = rows.withColumn("address", F.concat("host", "path"))
    marked = mark_listed(rows, "address", listed, "listed", pass_bytes).withColumn("_rule", matching_rule(rules))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", by_list).alias("verdict"), "listed",
    )
