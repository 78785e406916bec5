"""Posts by user and position, written once, so that fetching a few reads and shuffles little.

A post's ``slot`` is a hash of its user and position. Files are dealt by slot and sorted by it, in small row groups whose least
and highest slot parquet keeps. So a hot user's posts lie in all files alike; a few wanted slots are sent to the scan,
which skips the row groups without them; and many wanted slots become a bit set of bounded size, which drops all other rows
before the shuffle. Positions alone, without texts, are read as narrow columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from voicegrain.operators.bitset import bit_set, maybe_in
from voicegrain.operators.ranking import hash_positions, position_in_group
from voicegrain.session import checkpoint, shared_folder

#: Folders by slot, and bytes of a row group.
BUCKETS = 16
ROW_GROUP = 1 << 20

#: So many wanted slots are named to the scan; see ``spark.sql.parquet.pushdown.inFilterThreshold`` in ``session``.
FEW = 1000


def slot_of(user: Column | str = "user", position: Column | str = "position") -> Column:
    return F.xxhash64(user, position)


def bucket_of(slot: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(slot), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class PostStore:
    """``rows`` has the posts' columns, ``position, slot`` and ``bucket``; ``users`` has ``user, n_posts, user_position``."""

    rows: DataFrame
    users: DataFrame
    buckets: int

    @property
    def places(self) -> DataFrame:
        """Posts without their texts."""
        return self.rows.select("user", "ord", "post_id", "position")

    def of_users(self, users: DataFrame) -> DataFrame:
        """The places of these users' posts; others are dropped as they are read."""
        wanted = checkpoint(users.select("user").distinct())
        return maybe_in(self.places, "user", bit_set(wanted, "user")).join(wanted, "user", "left_semi")

    def fetch(self, picks: DataFrame, user: str = "user", columns: tuple[str, ...] = ("post_id", "tweet")) -> DataFrame:
        """``picks`` (kept, with ``user`` and ``position``) and these columns of the posts that lie there."""
        wanted = picks.withColumn("_slot", slot_of(user, "position"))
        bits = checkpoint(bit_set(wanted, "_slot"))  # combined in the tasks, so repeated slots need no shuffle
        found = self.rows.select(F.col("user").alias("_user"), F.col("position").alias("_position"), "slot", "bucket", *columns)
        few = self._few(wanted, bits)
        if few is not None:
            buckets = [r[0] for r in wanted.select(bucket_of("_slot", self.buckets)).distinct().collect()]
            found = found.where(F.col("bucket").isin(buckets) & F.col("slot").isin(few))
        else:
            found = maybe_in(found, "slot", bits)
        same = (F.col("_slot") == F.col("slot")) & (F.col(user) == F.col("_user")) & (F.col("position") == F.col("_position"))
        return wanted.join(found, same).drop("_slot", "slot", "_user", "_position", "bucket")

    @staticmethod
    def _few(wanted: DataFrame, bits: DataFrame) -> list[int] | None:
        """The different wanted slots if they are ``FEW`` at most; there are no fewer of them than bits."""
        if (bits.agg(F.sum(F.bitmap_count("_bitmap"))).first()[0] or 0) > FEW:
            return None
        few = [r[0] for r in wanted.select("_slot").distinct().limit(FEW + 1).collect()]
        return few if len(few) <= FEW else None


def write_store(posts: DataFrame, buckets: int = BUCKETS) -> PostStore:
    """All posts (``user, ord, post_id`` and what else they carry) with their position within the user, in the shared folder."""
    path = shared_folder(posts.sparkSession)
    placed = position_in_group(posts, ["user"], "ord").withColumn("slot", slot_of())
    dealt = placed.withColumn("bucket", bucket_of("slot", buckets)).repartition(buckets, "bucket")
    dealt.sortWithinPartitions("bucket", "slot").write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(path)
    kept = posts.sparkSession.read.schema(dealt.schema).parquet(path)
    users = kept.groupBy("user").agg(F.count(F.lit(1)).alias("n_posts"))
    return PostStore(kept, checkpoint(hash_positions(users, "users", ["user"], "user_position")), buckets)
