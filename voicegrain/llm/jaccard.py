"""Near-duplicate join on word shingles by a MinHash LSH forest.

Every distinct text gets a signature of ``TREES`` times ``DEPTH`` MinHash values. For each tree the signatures are
range-sorted, which lays out its prefix trie: texts that share a prefix are neighbours. Runs with a common prefix of
the present length are candidates. Candidates hang together in groups; within a group, cut into blocks of bounded
size, all similarities are computed exactly from the whole shingle sets. From the similarities found follows how
many links a forest of this depth should have missed; while the estimated recall is below the target, the
prefix is shortened by one.

Texts that are equal are one node with a weight; pairs are never rows: a block gives each text its number
of links and one edge towards the smallest text of its part.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from voicegrain.llm.components import components
from voicegrain.llm.shared import bit_set, bounded_batches, stored, text_of, with_maybe
from voicegrain.llm.shingles import shingle_set
from voicegrain.operators.skew import skew_join

TREES, DEPTH, LEAST_DEPTH = 48, 8, 5
SIMILARITY = Fraction(4, 5)
TARGET_RECALL = 0.9999

#: A block's share of a group's texts: bytes and number. A task holds two blocks.
BLOCK_BYTES, BLOCK_TEXTS = 4_000_000, 1_000

_draw = np.random.default_rng(20_01)
FLIPS = _draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)[:, None]
FACTORS = (_draw.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1))[:, None]


def signature(shingles: np.ndarray) -> bytes:
    """The MinHash values of a shingle set, 16 bits each, tree after tree."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 2048):
        np.minimum(low, ((short[i : i + 2048] ^ FLIPS) * FACTORS).min(1), out=low)
    return (low * np.uint32(2654435761) >> np.uint32(16)).astype(">u2").tobytes()


def with_identity(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, text, sha`` (identity of the text) and ``node``, a number that stands for it among candidates."""
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    return rows.withColumn("node", F.xxhash64("sha"))


def sign(rows: DataFrame, words: int) -> DataFrame:
    """``doc_id, sha, node, bytes, sig``; ``sig`` is null for texts without words."""
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            sigs = pa.array([signature(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "sha", "node", "bytes")], sigs], ["doc_id", "sha", "node", "bytes", "sig"]
            )

    bounded_batches(rows.sparkSession)
    sized = rows.withColumn("bytes", F.octet_length("text").cast("bigint"))
    return stored(sized.mapInArrow(run, "doc_id bigint, sha binary, node bigint, bytes bigint, sig binary"))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def forest_edges(signed: DataFrame) -> DataFrame:
    """``a, b, depth``: ``b`` shares a prefix of ``depth`` values, in some tree, with the first text ``a`` of its run.

    Stored. One sort serves all depths: a run of a shorter prefix contains those of longer ones.
    """
    nodes = signed.where("sig is not null").groupBy("node").agg(F.any_value("sig").alias("sig"))
    width = 2 * DEPTH
    trees = nodes.select("node", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)), lambda i: F.substring(F.col("sig"), i * width + 1, F.lit(width))
    )).alias("tree", "prefix"))
    laid_out = trees.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")

    def run(batches):
        part = TaskContext.get().partitionId()
        names = ["a", "b", "depth", "part", "tree", "prefix"]
        ends, carried = [], None  # first and last row; the row before, with the first of its run at each depth
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            node = batch.column("node").to_numpy(zero_copy_only=False)
            tree = batch.column("tree").to_numpy(zero_copy_only=False)
            prefix = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u2").reshape(n, DEPTH)
            if carried is None:
                ends.append((int(node[0]), int(tree[0]), prefix[0].tobytes()))
                shared = np.zeros(1, np.int64)
                heads = np.full(DEPTH + 1, node[0])
            else:
                last_tree, last_prefix, heads = carried
                shared = common_prefix(prefix[:1], last_prefix[None]) * (tree[0] == last_tree)
            shared = np.concatenate((shared, common_prefix(prefix[1:], prefix[:-1]) * (tree[1:] == tree[:-1])))
            a, b, depth, nearer = [], [], [], None
            for d in range(DEPTH, LEAST_DEPTH - 1, -1):
                place = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                head = np.where(place < 0, heads[d], node[np.maximum(place, 0)])
                new = (shared >= d) & (head != node)
                if nearer is not None:
                    new &= head != nearer
                a.append(head[new])
                b.append(node[new])
                depth.append(np.full(new.sum(), d, np.int32))
                nearer = head
                heads[d] = head[-1]
            carried = (tree[-1], prefix[-1], heads)
            latest = (int(node[-1]), int(tree[-1]), prefix[-1].tobytes())
            size = sum(map(len, a))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(depth)),
                 pa.nulls(size, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        if carried is not None:
            ends.append(latest)
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in ends]), pa.array([0, 1]), pa.nulls(2, pa.int32()), pa.array([part] * 2, pa.int32()),
                 pa.array([e[1] for e in ends], pa.int32()), pa.array([e[2] for e in ends])], names)

    found = stored(laid_out.mapInArrow(run, "a bigint, b bigint, depth int, part int, tree int, prefix binary"))
    # two rows for each task: runs go on from one task's last row to the next one's first
    order = Window.orderBy("part", F.col("b"))
    before = [F.lag(c).over(order).alias(f"_{c}") for c in ("a", "tree", "prefix")]
    seam = found.where("part is not null").select("a", "b", "tree", "prefix", *before).where("b = 0 and tree = _tree")
    alike = F.lit(0)
    for d in range(LEAST_DEPTH, DEPTH + 1):
        alike = F.when(F.substring("prefix", 1, 2 * d) == F.substring("_prefix", 1, 2 * d), d).otherwise(alike)
    seams = seam.select(F.col("_a").alias("a"), F.col("a").alias("b"), alike.alias("depth")).where(F.col("depth") >= LEAST_DEPTH)
    return found.where("part is null").select("a", "b", "depth").unionByName(seams)


def links_within(sets: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are linked, and the similarity of all pairs, exactly: from the shingles that two or more share."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(every)))
    both = np.zeros((n, n), np.float32)
    for d in np.unique(count[(count > 1) & (count <= 8)]).tolist():
        at = owner[first[count == d][:, None] + np.arange(d)]
        for x in range(d):
            for y in range(x):
                np.add.at(both, (at[:, y], at[:, x]), 1)
    both += both.T
    wide = np.flatnonzero(count > 8)
    for i in range(0, len(wide), 2048):
        some = wide[i : i + 2048]
        column = np.repeat(np.arange(len(some)), count[some])
        row = np.concatenate([owner[first[j] : first[j] + count[j]] for j in some])
        table = np.zeros((n, len(some)), np.float32)
        table[row, column] = 1
        both += table @ table.T
    both = np.rint(both).astype(np.int64)
    union = size[:, None] + size[None, :] - both
    linked = (both * similarity.denominator >= union * similarity.numerator) & (union > 0)
    np.fill_diagonal(linked, False)
    return linked, both / np.maximum(union, 1)


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """The first text of each text's connected part."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verify(groups: DataFrame, depth: int, words: int, similarity: Fraction) -> DataFrame:
    """Exact links in each block pair ``group, i, j`` of ``sha, weight, block, text``.

    Gives for each text ``links`` (weights of the texts it is linked with), ``root`` (null without links), ``found``
    and ``missed``: links found once, and those that a forest of this depth is expected to have missed for them.
    """
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(np.array(table["sha"].to_pylist(), object), kind="stable")
        sha = [table["sha"][i].as_py() for i in order.tolist()]
        weight, block = table["weight"].to_numpy()[order], table["block"].to_numpy()[order]
        linked, alike = links_within([shingle_set(table["text"][i].as_py(), words) for i in order.tolist()], similarity)
        if table["i"][0].as_py() != table["j"][0].as_py():
            linked &= block[:, None] != block[None, :]
        root = smallest_reachable(linked)
        some = linked.any(1)
        once = np.triu(linked)
        chance = 1 - (1 - np.where(once, alike, 1.0) ** depth) ** TREES
        missed = np.where(once, 1 / chance - 1, 0).sum(1)
        return pa.table({
            "group": table["group"], "sha": pa.array(sha, pa.binary()), "links": pa.array(linked @ weight, pa.int64()),
            "root": pa.array([sha[r] if s else None for r, s in zip(root, some, strict=True)], pa.binary()),
            "found": pa.array(once.sum(1), pa.int64()), "missed": pa.array(missed, pa.float64()),
        })

    return groups.groupBy("group", "i", "j").applyInArrow(
        run, "group bigint, sha binary, links bigint, root binary, found bigint, missed double"
    )


def linked_texts(
    rows: DataFrame, signed: DataFrame, words: int, similarity: Fraction, target: float
) -> DataFrame:
    """``sha, links, root`` of the distinct texts that have links to other texts."""
    edges = stored(forest_edges(signed))
    texts = signed.where("sig is not null").groupBy("sha", "node").agg(
        F.count(F.lit(1)).alias("weight"), F.first("bytes").alias("bytes")
    )
    for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
        groups = components(edges.where(F.col("depth") >= depth).select("a", "b"))
        members = texts.join(groups, "node")
        sizes = members.groupBy("root").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).select("root", F.greatest(
            F.ceil(F.col("b") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK_TEXTS), F.lit(1)
        ).cast("int").alias("blocks"))
        members = stored(skew_join(members, sizes, "root", ["sha"]).select(
            "sha", "node", "weight", F.col("root").alias("group"), "blocks",
            F.pmod(F.xxhash64("sha", F.lit(1)), F.col("blocks")).cast("int").alias("block"),
        ))
        suspects = with_maybe(rows.select("sha", "node", "text"), "node", bit_set(members, "node"), "_maybe").where("_maybe")
        once = suspects.groupBy("sha").agg(F.any_value("text").alias("text"))
        placed = once.join(members, "sha").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select(
            "group", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
            "sha", "weight", "block", "text", "blocks",
        )
        found = stored(verify(placed.drop("blocks"), depth, words, similarity))
        total = found.agg(F.sum("found"), F.sum("missed")).first()
        n, missed = total[0] or 0, total[1] or 0.0
        if n / max(n + missed, 1) >= target or not n:
            break
    links = found.groupBy("sha").agg(F.sum("links").alias("links")).where("links > 0")
    parts = found.where("root is not null")
    split = members.where("blocks > 1").select("group").distinct()
    whole = parts.join(split, "group", "left_anti").select("sha", "root")
    across = parts.join(split, "group", "left_semi").select(F.col("sha").alias("a"), F.col("root").alias("b"))
    roots = whole.unionByName(components(across).withColumnRenamed("node", "sha"))
    return links.join(roots, "sha")


def classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: Fraction = SIMILARITY,
    target: float = TARGET_RECALL,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, sha, class_id, n_links, keeps, rep_id``.

    Classes are the connected components of all links; ``class_id`` is the smallest id in it (nulls apart), ``n_links``
    counts the other rows at this similarity or above, copies included. ``keeps`` marks the copies of the class's
    representative text, that with the smallest id, of which the row with ``rep_id`` stands for the class.
    Texts without words (null, empty, white space) have no links and stay by themselves. A text shorter than
    ``words`` is one shingle. Null and repeated ids and repeated rows are rows of their own; other columns are left out.
    """
    rows = with_identity(docs, key, text)
    signed = sign(rows, words)
    found = linked_texts(rows, signed, words, similarity, target)
    texts = signed.where("sig is not null").groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")
    ).join(found, "sha", "left").select(
        "sha", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "sha").alias("root")
    )
    texts = stored(texts)
    best = texts.groupBy("root").agg(
        F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull().alias("none"), "low", "sha")).alias("best")
    ).select("root", "class_id", F.col("best.sha").alias("rep"), F.col("best.low").alias("rep_id"))
    known = skew_join(texts, best, "root", ["sha"]).select(
        "sha", "class_id", "n_links", (F.col("sha") == F.col("rep")).alias("keeps"), "rep_id"
    )
    wordy = skew_join(signed.where("sig is not null").select("doc_id", "sha"), known, "sha", ["doc_id"])
    alone = signed.where("sig is null").select(
        "doc_id", "sha", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"),
        F.lit(True).alias("keeps"), F.col("doc_id").alias("rep_id"),
    )
    columns = ["doc_id", "sha", "class_id", "n_links", "keeps", "rep_id"]
    return wordy.select(columns).unionByName(alone.select(columns))


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those that a class's other row stands for: one row of each class stays.

    Only rows whose key may be on the list of those that go, or repeats, meet that list.
    """
    found = classes(docs, key, text, **options)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("sha"))
    stays = F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    has_words = (F.col("n_links") > 0)  # a row without links stays as it is
    listed = stored(found.where(has_words).select(name.alias("_key"), stays.alias("_stays")).groupBy("_key").agg(
        F.max("_stays").alias("_stays"), F.count(F.lit(1)).alias("_n")
    ).where("not _stays or _n > 1"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("bigint").cast("string"), F.lit("-")),
                    F.hex(F.unhex(F.sha2(text_of(F.col(f"`{text}`")), 256)))).alias("_key"),
    )
    flagged = with_maybe(rows, "_key", bit_set(listed, "_key"), "_maybe")
    rest = flagged.where("_maybe").drop("_maybe").join(listed, "_key", "left")
    untouched = rest.where("_stays is null").select("_doc")
    repeats = rest.where("_stays").select("_key", "_doc").groupBy("_key").agg(F.any_value("_doc").alias("_doc")).select("_doc")
    return flagged.where("not _maybe").select("_doc").unionByName(untouched).unionByName(repeats).select("_doc.*")
