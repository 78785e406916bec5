"""Nearest profiles through an inverted file: vectors lie in lists around centroids, and a question looks into few lists.

Centroids come from spherical k-means over a bounded sample, each round one Spark aggregate of partial sums. Every vector
is then put into the list of its nearest centroid. A question looks into the lists of its nearest centroids first and ranks
what it finds exactly. Two ways tell when that is enough: lists are added until no other can hold a nearer vector, by the angle
between the question and the list's centroid and the widest angle inside the list (``search``); or as many lists are
probed as a sample of questions needs for a stated recall against all vectors (``search_probes``, ``probes_for``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from voicegrain.operators.ranking import hash_sample, key_hash, top_k
from voicegrain.operators.retrieval import CELLS, MOST_TASKS, PROFILE_BLOCK, QUESTION_BLOCK, best_in_block, nearest_profiles
from voicegrain.session import checkpoint

#: Lists are about the root of the number of vectors, so many at most; centroids are all that is ever broadcast.
MAX_LISTS = 4096

#: Vectors of the sample for each centroid, and rounds of k-means.
SAMPLE_PER_LIST = 64
ROUNDS = 4

#: Questions that the recall of a number of probes is measured on, against all vectors.
MEASURED_QUESTIONS = 256

#: Rows that a task gives away at once while it tells which lists are wanted.
WANTED_ROWS = 8192

#: Cosines this near the bound count as reached, so that rounding never hides a list.
MARGIN = 1e-6


@dataclass(frozen=True)
class Index:
    """``rows`` has ``profile_id, vector, list``; arrays have one entry for each list."""

    rows: DataFrame
    centroids: np.ndarray
    widest: np.ndarray  # angle between a centroid and the vector of its list that is farthest from it
    sizes: np.ndarray


def units(column: pa.Array) -> np.ndarray:
    """Rows of length one; a vector of zeros stays as it is."""
    rows = column.to_numpy(zero_copy_only=False)
    if not len(rows):
        return np.zeros((0, 1))
    matrix = np.stack(rows).astype(np.float64)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def few_rows(batches, lists: int):
    """Slices of the batches, so small that their cosines to all centroids are ``CELLS`` at most."""
    step = max(1, CELLS // lists)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def means(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the mean directions of the vectors nearest to each centroid; an empty list keeps its centroid."""
    def add(batches):
        total, some = np.zeros_like(centroids), np.zeros(len(centroids), bool)
        for batch in few_rows(batches, len(centroids)):
            x = units(batch.column("vector"))
            nearest = (x @ centroids.T).argmax(1)
            np.add.at(total, nearest, x)
            some[nearest] = True
        at = np.flatnonzero(some)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], ["list", "total"])

    sums = sample.select("vector").mapInArrow(add, "list int, total array<double>").select("list", F.posexplode("total").alias("place", "x"))
    cells = sums.groupBy("list", "place").agg(F.sum("x").alias("x")).toArrow()  # centroids, no more
    out = np.zeros_like(centroids)
    out[cells.column("list").to_numpy(), cells.column("place").to_numpy()] = cells.column("x").to_numpy()
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 0, out / np.where(length > 0, length, 1), centroids)


def build_index(profiles: DataFrame, seed=42, lists: int | None = None, rounds: int = ROUNDS) -> Index:
    """All rows of ``profiles`` (``profile_id, vector``) in lists, kept on reliable storage.

    Rows without a vector are left out. ``lists`` is the root of the number of rows unless given.
    """
    known = checkpoint(profiles.where(F.col("vector").isNotNull()).select("profile_id", "vector"))
    total = known.count()
    lists = max(1, min(lists or round(total**0.5), MAX_LISTS, total))
    bound = SAMPLE_PER_LIST * lists
    sample = known if total <= bound else checkpoint(hash_sample(known, f"{seed}-index", ["profile_id"], bound))
    first = sample.orderBy(key_hash(f"{seed}-first", "profile_id"), "profile_id").limit(lists).select("vector").toArrow()
    centroids = units(first.column("vector").combine_chunks()) if total else np.zeros((1, 1))
    for _ in range(rounds if total else 0):
        centroids = means(sample, centroids)
    schema = StructType([*known.schema.fields, StructField("list", IntegerType()), StructField("cosine", DoubleType())])

    def put(batches):
        for batch in few_rows(batches, len(centroids)):
            x = units(batch.column("vector"))
            cosine = x @ centroids.T
            nearest = cosine.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest, pa.int32()), pa.array(cosine[np.arange(len(x)), nearest], pa.float64())], schema.names
            )

    rows = checkpoint(known.mapInArrow(put, schema))
    facts = rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()  # one row a list
    sizes, widest = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in facts:
        sizes[r["list"]], widest[r["list"]] = r["n"], np.arccos(np.clip(r["least"], -1, 1))
    return Index(rows.drop("cosine"), centroids, widest, sizes)


def packs_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """The pack of each list: neighbours in the order of lists share one while they hold ``most`` vectors together."""
    packs, held = np.zeros(len(sizes), np.int32), 0
    for i, n in enumerate(sizes):
        opened = i > 0 and held + n > most
        packs[i] = packs[i - 1] + opened if i else 0
        held = n if opened else held + n
    return packs


def _wanted(questions: DataFrame, index: Index, choose, packs: np.ndarray | None = None) -> DataFrame:
    """``question_id, vector, pack, lists``: a row for each pack (each list, unless given) in which ``choose`` (batch, cosines
    to centroids) marks lists for a question, and those."""
    columns = [questions.schema[c] for c in ("question_id", "vector")]
    centroids, filled = index.centroids, index.sizes > 0
    packs = np.arange(len(index.sizes), dtype=np.int32) if packs is None else packs
    if not filled.any():
        return questions.select("question_id", "vector", F.lit(0).alias("pack"), F.array(F.lit(0)).alias("lists")).where(F.lit(False))

    def run(batches):
        for batch in few_rows(batches, len(centroids)):
            row, at = np.nonzero(choose(batch, units(batch.column("vector")) @ centroids.T) & filled)
            new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(packs[at], prepend=-1) != 0))
            ends = np.append(new, len(row))
            for i in range(0, len(new), WANTED_ROWS):
                first = new[i:i + WANTED_ROWS]
                bounds = ends[i:i + len(first) + 1]
                lists = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(at[bounds[0]:bounds[-1]], pa.int32()))
                asked = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("question_id").take(asked), batch.column("vector").take(asked), pa.array(packs[at[first]], pa.int32()), lists],
                    ["question_id", "vector", "pack", "lists"],
                )

    return questions.mapInArrow(run, StructType([
        *columns, StructField("pack", IntegerType()), StructField("lists", ArrayType(IntegerType()))]))


def nearest_lists(cosine: np.ndarray, filled: np.ndarray, probes: int) -> np.ndarray:
    """Marks of each question's ``probes`` nearest lists that hold anything."""
    order = np.argsort(np.where(filled, -cosine, np.inf), axis=1, kind="stable")[:, :probes]
    marked = np.zeros(cosine.shape, bool)
    np.put_along_axis(marked, order, True, axis=1)
    return marked


def best_in_lists(some: pd.DataFrame, known: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best for each question of ``some`` in its own ``lists`` among the profiles of ``known``, list by list."""
    known = known.sort_values("profile_id", ignore_index=True)
    asked, names = some["question_id"].to_numpy(), known["profile_id"].to_numpy()
    numbered, known = some.assign(question_id=range(len(some))), known.assign(profile_id=range(len(known)))
    wanted = np.concatenate([np.empty(0, np.int64), *some["lists"]])
    row = np.repeat(np.arange(len(some)), some["lists"].str.len())
    found = [best_in_block(numbered.iloc[row[wanted == at]], there, k) for at, there in known.groupby("list") if (wanted == at).any()]
    if not found:
        return best_in_block(some.iloc[:0], known, k)
    question, profile, similarity = (np.concatenate([f[c].to_numpy() for f in found]) for c in ("question_id", "profile_id", "similarity"))
    order = np.lexsort((profile, -similarity, question))
    ranked = question[order]
    order = order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]
    return pd.DataFrame({"question_id": asked[question[order]], "profile_id": names[profile[order]], "similarity": similarity[order]})


def ranked_in_lists(questions: DataFrame, choose, index: Index, k: int, question_block: int, profile_block: int) -> DataFrame:
    """The ``k`` best of each question within each pack of lists, from the lists that ``choose`` marks for it.

    Small lists share a pack, so a question and its results are repeated for each pack at most and not for each list. A list of
    many vectors, or a pack that many questions want, is cut into parts of bounded size on either side; a task multiplies one
    part of the questions by one of the vectors.
    """
    packs = packs_of(index.sizes, profile_block)
    wanted = checkpoint(_wanted(questions, index, choose, packs))
    spark, held = wanted.sparkSession, np.bincount(packs, index.sizes).astype(int)
    cuts = [  # one row a pack
        (r["pack"], -(-r["n"] // question_block), int(max(1, -(-held[r["pack"]] // profile_block))))
        for r in wanted.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()
    ]
    parts = F.broadcast(spark.createDataFrame(cuts, "pack int, _qs int, _ps int"))
    pack_of = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(packs)], "list int, pack int"))
    keys, tasks = ("pack", "_q", "_p"), max(1, min(sum(q * p for _, q, p in cuts), MOST_TASKS))

    def placed(df: DataFrame, key: str, lists: str, own: str, owns: str, other: str, others: str) -> DataFrame:
        return df.join(parts, "pack").select(
            key, "vector", "pack", lists, F.pmod(F.xxhash64(key), F.col(owns)).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(others).cast("bigint") - 1)).alias(other),
        ).repartition(tasks, *keys)

    left = placed(wanted, "question_id", "lists", "_q", "_qs", "_p", "_ps")
    right = placed(index.rows.join(pack_of, "list"), "profile_id", "list", "_p", "_ps", "_q", "_qs")
    schema = StructType([
        StructField("question_id", wanted.schema["question_id"].dataType),
        StructField("profile_id", index.rows.schema["profile_id"].dataType), StructField("similarity", DoubleType()),
    ])

    def best(some: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return best_in_lists(some, known, k)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["question_id"], [F.desc("similarity"), "profile_id"], k, slices=1)


def search_probes(
    questions: DataFrame, index: Index, k: int, probes: int, question_block: int = QUESTION_BLOCK, profile_block: int = PROFILE_BLOCK
) -> DataFrame:
    """``question_id, profile_id, similarity, rank`` from each question's ``probes`` nearest lists."""
    filled = index.sizes > 0
    return _best(ranked_in_lists(
        _asked(questions), lambda _, cosine: nearest_lists(cosine, filled, probes), index, k, question_block, profile_block), k)


def _asked(questions: DataFrame) -> DataFrame:
    return questions.where(F.col("vector").isNotNull()).select("question_id", "vector")


def search(
    questions: DataFrame, index: Index, k: int, probes: int = 4, question_block: int = QUESTION_BLOCK,
    profile_block: int = PROFILE_BLOCK,
) -> DataFrame:
    """As ``nearest_profiles``, row for row: what the first lists give tells which other lists can hold a nearer vector.

    The nearest vector of a list can be no nearer than the angle to its centroid less the widest angle inside it.
    """
    filled, widest = index.sizes > 0, index.widest
    asked = checkpoint(_asked(questions))
    first = checkpoint(_best(ranked_in_lists(
        asked, lambda _, cosine: nearest_lists(cosine, filled, probes), index, k, question_block, profile_block), k))
    reached = first.groupBy("question_id").agg(F.min("similarity").alias("_least"), F.count(F.lit(1)).alias("_found")).select(
        "question_id", F.when(F.col("_found") >= k, F.col("_least")).alias("_least"))
    known = asked.join(reached, "question_id", "left").select("question_id", "vector", F.coalesce("_least", F.lit(-2.0)).alias("_least"))

    def others(batch, cosine):
        nearest = np.cos(np.maximum(np.arccos(np.clip(cosine, -1, 1)) - widest, 0))
        can = nearest >= batch.column("_least").to_numpy()[:, None] - MARGIN
        return can & ~nearest_lists(cosine, filled, probes)

    more = ranked_in_lists(known, others, index, k, question_block, profile_block)
    return _best(first.drop("rank").unionByName(more), k)


def probes_for(questions: DataFrame, index: Index, k: int, recall: float = 0.95, seed=42) -> tuple[int, float]:
    """The least number of probes with that recall on a sample of questions, and the recall it has there.

    The sample's true neighbours come from all vectors; each is found by as many probes as the rank of its list among
    the lists nearest to its question.
    """
    sample = checkpoint(hash_sample(_asked(questions), f"{seed}-recall", ["question_id"], MEASURED_QUESTIONS))
    true = nearest_profiles(sample, index.rows.select("profile_id", "vector"), k)
    placed = true.select("question_id", "profile_id").join(index.rows.select("profile_id", "list"), "profile_id")
    rows = placed.join(sample, "question_id").select("vector", "list").toArrow()  # k rows a sampled question
    if not rows.num_rows:
        return 1, 1.0
    cosine = units(rows.column("vector").combine_chunks()) @ index.centroids.T
    cosine[:, index.sizes == 0] = -np.inf
    lists = rows.column("list").to_numpy()
    rank = (cosine > cosine[np.arange(len(lists)), lists][:, None]).sum(1)
    share = np.cumsum(np.bincount(rank, minlength=len(index.sizes))) / len(rank)
    probes = int(np.searchsorted(share, recall - 1e-12)) + 1
    return probes, float(share[probes - 1])


def recall_of(found: DataFrame, true: DataFrame) -> float:
    """The share of true pairs that were found; 1 if there are none."""
    pairs = ["question_id", "profile_id"]
    marked = true.select(*pairs).join(found.select(*pairs, F.lit(1).alias("_hit")), pairs, "left")
    row = marked.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits")).first()
    return row.hits / row.n if row.n else 1.0
