"""Balanced label propagation: linked rows move towards their neighbours' shards under capacity quotas.

Links are given by hubs: rows of one hub are neighbours of each other (an edge is a hub of two), so that a
large group is never expanded into pairs. A round counts each hub's rows by shard, lets every linked row ask
for the shard with most of its neighbours, and admits askers up to a quota: the rows of that shard without a
neighbour there. As many of these then leave for the shards that lost rows, so sizes stay at most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import running_total, stored, text_of
from voicegrain.operators.skew import skew_join


def _neighbours(state: DataFrame, members: DataFrame, shards: int) -> DataFrame:
    """``row, hub, shard, near`` of linked rows: ``near`` counts by shard the rows of their hubs, themselves included."""
    placed = members.join(state, "row")
    per_hub = placed.groupBy("hub").agg(
        *[F.sum((F.col("shard") == k).cast("bigint")).alias(f"_c{k}") for k in range(shards)]
    )
    return skew_join(placed, per_hub, "hub", ["row"]).groupBy("row").agg(
        F.min("hub").alias("hub"), F.first("shard").alias("shard"), F.count(F.lit(1)).alias("hubs"),
        F.array(*[F.sum(f"_c{k}") for k in range(shards)]).alias("near"),
    )


def _target(shards: int, open_: list[bool], round_: int):
    """The open shard with most neighbours, or the own one. Equal counts are settled by an order of the shards that is
    the same for all rows of a hub, anew in each round."""
    turn = F.pmod(F.xxhash64("hub", F.lit(round_)), F.lit(shards))
    return F.array_max(F.array(*[
        F.when(F.lit(open_[k]) | (F.col("shard") == k), F.struct(
            F.get("near", k).alias("near"), F.pmod(turn + k, F.lit(shards)).alias("turn"), F.lit(k).alias("shard")
        )) for k in range(shards)
    ]))["shard"]


def _by_shard(df: DataFrame, shards: int, column: str = "shard") -> list[int]:
    """Rows in each shard; the driver sees one number per shard."""
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [found.get(k, 0) for k in range(shards)]


def _pick(values: list[int], column: str):
    """The entry of ``values`` at a column's value."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), F.col(column) + 1)


def kept_links(known: DataFrame) -> int:
    """Pairs of a row and another row of its hubs in the same shard, both ways."""
    near = F.get("near", F.col("shard")) - F.col("hubs")
    return known.agg(F.coalesce(F.sum(near), F.lit(0))).first()[0]


#: Rounds without a gain in kept links after which propagation ends.
PATIENCE = 2


def propagate(rows: DataFrame, members: DataFrame, shards: int, rounds: int | None = None) -> DataFrame:
    """``row, shard`` for every row of ``rows`` (a unique ``row`` each); counts of shards are at most one apart.

    ``members`` holds ``row, hub``; rows without a hub are moved only to make room. Rows start evenly dealt by
    hash. Only shards with rows to spare are asked for, so a group too large for one shard goes on to the next, about a
    shard a round. Rounds end when nobody moves, when ``PATIENCE`` rounds have kept no more links than those before, or
    after ``rounds``, by default three for each shard and twelve at least. An empty table gives no rows.
    """
    start = running_total(rows.select("row"), [], ["row"], F.lit(1), "_at")
    linked = members.select("row").distinct().withColumn("linked", F.lit(True))
    state = stored(start.select("row", (F.col("_at") % shards).cast("int").alias("shard")).join(
        linked, "row", "left"
    ).select("row", "shard", F.coalesce("linked", F.lit(False)).alias("linked")))
    capacity = _by_shard(state, shards)
    best, best_state, since = -1, state, 0
    for round_ in range(max(12, 3 * shards) if rounds is None else rounds):
        known = stored(_neighbours(state.where("linked").select("row", "shard"), members, shards).select(
            "row", "hub", "hubs", "shard", "near", (F.get("near", F.col("shard")) <= F.col("hubs")).alias("alone")
        ))
        kept = kept_links(known)
        if kept > best:
            best, best_state, since = kept, state, 0
        else:
            since += 1
            if since == PATIENCE:
                state = best_state
                break
        unlinked = _by_shard(state.where(~F.col("linked")), shards)
        spare = [a + b for a, b in zip(unlinked, _by_shard(known.where("alone"), shards), strict=True)]
        wishes = known.withColumn("target", _target(shards, [n > 0 for n in spare], round_)).where("target != shard")
        ranked = running_total(wishes.select("row", "hub", "shard", "target"), ["target"], ["row"], F.lit(1), "_rank", first=["hub"])
        moves = stored(ranked.where(F.col("_rank") < _pick(spare, "target")).select("row", "shard", "target"))
        came, left = _by_shard(moves, shards, "target"), _by_shard(moves, shards)
        if not sum(came):
            break
        # no shard was above or below its capacity before; those that came are at most the rows that could be spared
        over = [max(0, a - b) for a, b in zip(came, left, strict=True)]
        under = [max(0, b - a) for a, b in zip(came, left, strict=True)]
        before = [sum(over[:k]) for k in range(shards)]
        first = [min(a, b) for a, b in zip(over, unlinked, strict=True)]  # rows without links leave first
        then = [a - b for a, b in zip(over, first, strict=True)]
        leaving = _leaving(state.where(~F.col("linked")), first, before)
        if sum(then):
            rest = known.where("alone").join(moves, "row", "left_anti")
            leaving = leaving.unionByName(_leaving(rest, then, [a + b for a, b in zip(before, first, strict=True)]))
        ends = [sum(under[: k + 1]) for k in range(shards)]
        dest = reduce(lambda rest, k: F.when(F.col("_place") < ends[k], k).otherwise(rest), reversed(range(shards)), F.lit(None))
        every = moves.select("row", "target").unionByName(leaving.select("row", dest.cast("int").alias("target")))
        state = stored(state.join(every, "row", "left").select(
            "row", F.coalesce("target", "shard").alias("shard"), "linked"
        ))
    assert _by_shard(state, shards) == capacity
    return state.select("row", "shard")


def _leaving(rows: DataFrame, number: list[int], before: list[int]) -> DataFrame:
    """``row, _place``: so many rows of each shard, numbered on from ``before``."""
    ranked = running_total(rows.where(_pick(number, "shard") > 0).select("row", "shard"), ["shard"], ["row"], F.lit(1), "_rank")
    return ranked.where(F.col("_rank") < _pick(number, "shard")).select("row", (F.col("_rank") + _pick(before, "shard")).alias("_place"))


def shard_documents(
    docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", rounds: int | None = None
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    Rows with equal texts (null counts as empty) are linked. ``law`` is ``rows``: counts of shards are at most
    one apart; ``slot`` runs from 0 without gaps within a shard; ``grown_shard`` is null. A group larger than a
    shard fills shards one after the other. Null and repeated ids, and repeated rows, are rows of their own;
    other columns are left out.
    """
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc_id"),
        text_of(F.col(f"`{text}`")).alias("_t"),
    ).select(
        "row", "doc_id", (F.octet_length("_t") + 1).cast("bigint").alias("size"),
        F.crc32(F.col("_t").cast("binary")).alias("text_crc32"), F.sha2("_t", 256).alias("hub"),
    ))
    shared = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hub")
    members = stored(skew_join(rows.select("row", "hub"), shared, "hub", ["row"]).select("row", "hub"))
    placed = running_total(propagate(rows, members, shards, rounds), ["shard"], ["row"], F.lit(1), "slot")
    return rows.join(placed, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
