"""Masked pseudo-likelihood: every word is predicted from the words on both sides of it.

Words are counted over the whole corpus by 64-bit hash, in a table that grows with it. A word that occurs often enough
(``least_own``, so more words in a larger corpus) is an output of the network by itself; the others share hashed
outputs, no fewer than there are own ones, and within such an output a word has its share of the joined counts.
Outputs form classes of equal sums of the roots of their frequencies. A window network in numpy predicts a word's
class, and within it the output, from the outputs of the two words before and the two after it, each softmax in full.
A document's score is the sum of the logarithms of these conditional probabilities over all its words.

Documents are dealt into groups by a hash and read in its order, so training depends on the rows and not on their files.
A network is trained on all words of each group, from the same start; the networks are then averaged inside Spark, row of
parameters by row, each by its number of uses. A group grows with the network, so all networks together are
smaller than the words. The driver holds the own words and one network. Counts of the other words never leave Spark:
documents' hashes are sent to the shard of the table that counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voicegrain.llm.shared import bounded_batches, stored
from voicegrain.llm.shingles import word_hashes

#: Fewest hashed outputs for words without one of their own, and fewest classes.
BUCKETS = 1 << 12
CLASSES = 48
REACH, WIDTH = 2, 16

#: Words of a group: so many for each output of the network, and at least so many.
GROUP_PER_OUTPUT, GROUP_WORDS = 400, 500_000

#: Words of a step: one for each output of the network, within these bounds.
STEP_WORDS = (1024, 1 << 14)
#: Words and exponentials of a softmax that are held at once, few enough for a core's cache.
TOGETHER, HELD = 1 << 11, 1 << 18

#: Words counted together in a task before its counts go to the shuffle.
COUNTED = 1 << 22
#: Distinct words in a shard of the table of counts, about; there are never fewer than 64 shards.
SHARD_WORDS = 20_000

#: Offsets of the window's words; the word itself is masked.
OFFSETS = [o for o in range(-REACH, REACH + 1) if o]


def words_of(text: str | None) -> np.ndarray:
    return word_hashes(text or "").view(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """``word, n``: how often each word, by its hash, occurs in all documents."""
    def run(batches):
        held, size = [], 0

        def summed():
            word, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(word), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(word[i : i + (1 << 18)]), pa.array(n[i : i + (1 << 18)])], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.append(words_of(text))
                size += len(held[-1])
                if size >= COUNTED:
                    yield from summed()
                    held, size = [], 0
        if held:
            yield from summed()

    return docs.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def least_own(total: int) -> int:
    """How often a word must occur to be an output by itself, in a corpus of ``total`` words."""
    return max(4, int(total**0.5 / 4))


@dataclass(frozen=True)
class Vocabulary:
    """Classes of outputs, which ``counts`` names in any order, the network in that of falling counts."""

    of_bucket: np.ndarray
    log_share: np.ndarray  # of an output within its class
    frequency: np.ndarray  # of classes

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        order = np.argsort(-counts, kind="stable")
        smooth = counts + 0.5
        root = np.sqrt(smooth[order] / smooth.sum())
        ahead = np.cumsum(root) - root / 2
        # a word costs the number of classes and the size of its own: their sum is least with this number
        n = min(len(counts), max(CLASSES, round(root.sum())))
        place = (ahead / root.sum() * n).astype(int)
        classes = np.empty(len(counts), np.int32)
        classes[order] = np.unique(place, return_inverse=True)[1]
        total = np.bincount(classes, smooth)
        return Vocabulary(classes, np.log(smooth / total[classes]).astype(np.float32), (total / total.sum()).astype(np.float32))


@dataclass(frozen=True)
class Outputs:
    """The outputs of the network, most frequent first, and how words find theirs."""

    own: np.ndarray  # hashes, sorted
    own_output: np.ndarray
    bits: int
    bucket_output: np.ndarray
    log_counts: np.ndarray  # of shared outputs, 0 of own ones
    vocabulary: Vocabulary
    first: np.ndarray  # output of each class, and their number at the end

    @staticmethod
    def of(counts: DataFrame, total: int) -> Outputs:
        least = least_own(total)
        own = counts.where(F.col("n") >= least).orderBy("word").toArrow()
        word, n = own.column("word").to_numpy(), own.column("n").to_numpy()
        bits = max(BUCKETS.bit_length() - 1, int(len(word)).bit_length())
        shared = counts.where(F.col("n") < least).groupBy(F.shiftrightunsigned("word", 64 - bits).alias("bucket")).agg(
            F.sum("n").alias("n")
        ).orderBy("bucket").toArrow()
        bucket, m = shared.column("bucket").to_numpy(), shared.column("n").to_numpy()
        both = np.concatenate([n, m])
        order = np.argsort(-both, kind="stable")
        rank = np.empty(len(both), np.int64)
        rank[order] = np.arange(len(both))
        bucket_output = np.zeros(1 << bits, np.int64)
        bucket_output[bucket] = rank[len(n) :]
        log_counts = np.zeros(len(both))
        log_counts[rank[len(n) :]] = np.log(m)
        vocabulary = Vocabulary.of(both[order])
        first = np.searchsorted(vocabulary.of_bucket, np.arange(len(vocabulary.frequency) + 1))
        return Outputs(word, rank[: len(n)], bits, bucket_output, log_counts, vocabulary, first)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's output, and whether others share it."""
        found = self.bucket_output[(words.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)]
        shares = np.ones(len(words), bool)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, words), len(self.own) - 1)
            shares = self.own[at] != words
            found = np.where(shares, found, self.own_output[at])
        return found, shares


def fresh_network(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(1)
    outputs, classes = len(vocabulary.of_bucket), len(vocabulary.frequency)
    shapes = {"embed": (len(OFFSETS), outputs + 1, WIDTH), "shift": (WIDTH,), "out": (classes, WIDTH + 1), "word": (outputs, WIDTH + 1)}
    net = {k: draw.normal(0, 0.1, shape).astype(np.float32) for k, shape in shapes.items()}
    net["out"][:, WIDTH] = np.log(vocabulary.frequency)  # the last column goes with a constant of the hidden layer
    net["word"][:, WIDTH] = vocabulary.log_share
    return net


def windows(outputs: np.ndarray) -> np.ndarray:
    """The outputs around each word; -1, the last row of the embeddings, stands beyond the ends."""
    padded = np.full(len(outputs) + 2 * REACH, -1, np.int32)
    padded[REACH : REACH + len(outputs)] = outputs
    return np.stack([padded[REACH + o : REACH + o + len(outputs)] for o in OFFSETS])


def small(rows: np.ndarray) -> bool:
    """Whether no logit of these rows can be too large for an exponential, as the hidden layer is within -1 and 1."""
    return not len(rows) or float((np.abs(rows) @ np.ones(rows.shape[1], np.float32)).max()) <= 60


class Room:
    """Arrays that all softmaxes of a task use again: to get new ones from the system takes as long as to fill them."""

    def __init__(self, widest: int):
        self.logits = np.empty(max(HELD, widest), np.float32)
        self.ones = np.ones(widest, np.float32)
        self.parts = np.empty((TOGETHER, WIDTH + 1), np.float32)
        self.numbers = np.arange(TOGETHER)

    @staticmethod
    def of(outputs: Outputs) -> Room:
        return Room(max(int(np.diff(outputs.first).max()), len(outputs.first) - 1))

    def logits_of(self, hidden: np.ndarray, rows: np.ndarray, chosen: np.ndarray, are_small: bool):
        """Ranges of words, the logits of all ``rows`` for them, but for a summand for each word, and where the chosen ones stand."""
        wide = len(rows)
        most = min(TOGETHER, len(self.logits) // wide)
        for a in range(0, len(hidden), most):
            b = min(a + most, len(hidden))
            logits = np.matmul(hidden[a:b], rows.T, out=self.logits[: (b - a) * wide].reshape(b - a, wide))
            if not are_small:
                logits -= logits.max(1, keepdims=True)
            yield a, b, logits, self.numbers[: b - a] * wide + chosen[a:b]


def log_chosen(
    hidden: np.ndarray, rows: np.ndarray, chosen: np.ndarray, are_small: bool, room: Room | None = None
) -> np.ndarray:
    """The logarithm of the chosen row's part of all rows' exponentials, for each word."""
    room, out = room or Room(len(rows)), np.empty(len(hidden), np.float32)
    for a, b, logits, at in room.logits_of(hidden, rows, chosen, are_small):
        own = logits.ravel()[at]
        np.subtract(own, np.log(np.exp(logits, out=logits) @ room.ones[: len(rows)]), out=out[a:b])
    return out


def add_gradients(room: Room, hidden, rows, chosen, are_small: bool, back: np.ndarray, grad: np.ndarray) -> None:
    """Add the gradients of the words' negative log probabilities to ``back``, where the constant has none, and ``grad``.

    A word's errors are its exponentials, less their sum at the chosen row, over that sum. The sum divides what is
    made of them, which is narrower.
    """
    inner = np.ascontiguousarray(rows[:, :WIDTH])
    for a, b, powers, at in room.logits_of(hidden, rows, chosen, are_small):
        np.exp(powers, out=powers)
        sums = powers @ room.ones[: len(rows)]
        powers.ravel()[at] -= sums
        part = (1 / sums)[:, None]
        wrong = powers @ inner
        wrong *= part
        back[a:b] += wrong
        grad += powers.T @ np.multiply(hidden[a:b], part, out=room.parts[: b - a])


def hidden_layer(net: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    inner = net["embed"][0].take(around[0], 0)
    inner += net["shift"]
    side = np.empty_like(inner)
    for i in range(1, len(OFFSETS)):
        inner += net["embed"][i].take(around[i], 0, out=side, mode="wrap")
    hidden = np.ones((len(inner), WIDTH + 1), np.float32)
    np.tanh(inner, out=hidden[:, :WIDTH])
    return hidden


def order_of(numbers: np.ndarray, below: int) -> np.ndarray:
    """A stable order; numbers of 16 bits are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def class_ranges(own: np.ndarray, first: np.ndarray):
    """For each class with words and several outputs the range of its words, which are in the order of outputs, and of its outputs."""
    ends, bounds = np.searchsorted(own, first).tolist(), first.tolist()
    return [
        (a, b, low, high) for a, b, low, high in zip(ends, ends[1:], bounds, bounds[1:]) if b > a and high > low + 1
    ]


def log_probabilities(
    net: dict[str, np.ndarray], outputs: Outputs, own: np.ndarray, around: np.ndarray, room: Room | None = None
) -> np.ndarray:
    """Of each word's output, given the words around it."""
    order = order_of(own, len(net["word"]))
    place = own[order]
    hidden, classes = hidden_layer(net, around.take(order, 1)), outputs.vocabulary.of_bucket[place]
    room = room or Room.of(outputs)
    logs, are_small = log_chosen(hidden, net["out"], classes, small(net["out"]), room), small(net["word"])
    for a, b, low, high in class_ranges(place, outputs.first):
        logs[a:b] += log_chosen(hidden[a:b], net["word"][low:high], place[a:b] - low, are_small, room)
    found = np.empty_like(logs)
    found[order] = logs
    return found


class Trainer:
    """Adagrad on the negative log probability of the masked words; rows of parameters not in use stay as they are."""

    def __init__(self, net: dict[str, np.ndarray], outputs: Outputs, rate: float = 0.1):
        self.net, self.outputs, self.rate, self.words = {k: v.copy() for k, v in net.items()}, outputs, np.float32(rate), 0
        self.square = {k: np.full_like(v, 1e-6) for k, v in net.items()}
        self.uses = np.zeros((len(OFFSETS), len(net["word"]) + 1), np.int64)
        self.class_uses = np.zeros(len(net["out"]), np.int64)
        self.room, self.sums = Room.of(outputs), np.empty_like(net["embed"][0])
        self.root = np.empty(self.sums.shape[0] * (WIDTH + 1), np.float32)

    def move(self, net: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        """Move all rows; ``grad`` is used up."""
        root = np.multiply(grad, grad, out=self.root[: grad.size].reshape(grad.shape))
        square += root
        np.sqrt(square, out=root)
        grad /= root
        grad *= self.rate
        net -= grad

    def move_used(self, net: np.ndarray, square: np.ndarray, used: np.ndarray, grad: np.ndarray) -> None:
        """Move the used rows; the gradients of others are 0 and change nothing, so many are moved with all of them."""
        if 4 * len(used) > len(net):
            return self.move(net, square, grad)
        some, squares = net.take(used, 0), square.take(used, 0)
        self.move(some, squares, grad.take(used, 0))
        net[used], square[used] = some, squares

    def step(self, own: np.ndarray, around: np.ndarray) -> None:
        net, size = self.net, len(self.net["word"])
        order = order_of(own, size)  # a class is a run of words then
        own, around = own[order], around.take(order, 1)
        classes = self.outputs.vocabulary.of_bucket[own]
        hidden = hidden_layer(net, around)
        back, grad = np.zeros((len(own), WIDTH), np.float32), {k: np.zeros_like(net[k]) for k in ("out", "word")}
        add_gradients(self.room, hidden, net["out"], classes, small(net["out"]), back, grad["out"])
        are_small = small(net["word"])
        for a, b, low, high in class_ranges(own, self.outputs.first):
            word = net["word"][low:high]
            add_gradients(self.room, hidden[a:b], word, own[a:b] - low, are_small, back[a:b], grad["word"][low:high])
        rest = hidden[:, :WIDTH]
        back *= 1 - rest * rest
        for k in grad:
            self.move(net[k], self.square[k], grad[k])
        self.move(net["shift"], self.square["shift"], np.ones(len(back), np.float32) @ back)
        # two floats at once: sums by row take the time of their additions
        pairs, flat = np.arange(WIDTH // 2), back.view(np.complex64).ravel()
        for i, side in enumerate(around):
            side = np.where(side < 0, size, side)
            uses = np.bincount(side, minlength=size + 1)
            sums = self.sums
            sums.fill(0)
            np.add.at(sums.view(np.complex64).ravel(), (side[:, None] * (WIDTH // 2) + pairs).ravel(), flat)
            self.move_used(net["embed"][i], self.square["embed"][i], np.flatnonzero(uses), sums)
            self.uses[i] += uses
        self.class_uses += np.bincount(classes, minlength=len(self.class_uses))
        self.words += len(own)

    def rows(self):
        """All parameters in rows with their weights in the average, ``BLOCK`` rows at a time."""
        used = self.class_uses[self.outputs.vocabulary.of_bucket]
        flat, weight = flattened(self.net), np.concatenate([self.uses.ravel(), used, np.full(len(flattened_rest(self.net)), self.words)])
        for i in range(0, len(flat), BLOCK):
            yield i // BLOCK, flat[i : i + BLOCK], weight[i : i + BLOCK].astype(np.float64)


#: Rows of parameters that travel together.
BLOCK = 1 << 8


def flattened_rest(net: dict[str, np.ndarray]) -> np.ndarray:
    """What belongs to no single output, in rows as wide as the others."""
    return np.concatenate([net["out"], np.pad(net["shift"], (0, 1))[None]])


def flattened(net: dict[str, np.ndarray]) -> np.ndarray:
    embed = np.pad(net["embed"].reshape(-1, WIDTH), ((0, 0), (0, 1)))
    return np.concatenate([embed, net["word"], flattened_rest(net)])


def unflattened(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    a, b = like["embed"].shape[0] * like["embed"].shape[1], len(like["word"])
    return {
        "embed": flat[:a, :WIDTH].reshape(like["embed"].shape).copy(), "word": flat[a : a + b].copy(),
        "out": flat[a + b : -1].copy(), "shift": flat[-1, :WIDTH].copy(),
    }


def averaged(parts: DataFrame) -> DataFrame:
    """Weighted means of the tasks' rows, block by block; a block is all a task holds."""
    def run(batches):
        block, total, weights = None, None, None

        def mean():
            some = weights > 0
            total[some] /= weights[some, None]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([total.astype(np.float32).tobytes()]), pa.array([some.tobytes()])],
                ["block", "value", "used"],
            )

        for batch in batches:
            for r in batch.to_pylist():
                weight = np.frombuffer(r["weight"])
                value = np.frombuffer(r["value"], np.float32).reshape(len(weight), -1) * weight[:, None]
                if r["block"] == block:
                    total += value
                    weights += weight
                    continue
                if block is not None:
                    yield mean()
                block, total, weights = r["block"], value, weight.copy()
        if block is not None:
            yield mean()

    return parts.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, value binary, used binary")


def dealt(encoded: DataFrame, total: int, outputs: int) -> DataFrame:
    """The documents' outputs in groups of about ``GROUP_WORDS``, a partition each, in the order of a hash of the row."""
    groups = max(1, round(total / max(GROUP_WORDS, GROUP_PER_OUTPUT * outputs)))
    rows = encoded.select(F.xxhash64("doc_id", "outputs").alias("place"), "outputs")
    return rows.repartition(groups, "place").sortWithinPartitions("place", "outputs").select("outputs")


def trained(encoded: DataFrame, outputs: Outputs, total: int) -> dict[str, np.ndarray]:
    """The average of the networks trained on each group, over all words of its documents."""
    start = fresh_network(outputs.vocabulary)
    size = len(start["word"])
    step = min(max(size, STEP_WORDS[0]), STEP_WORDS[1])
    shared = encoded.sparkSession.sparkContext.broadcast((start, outputs))

    def run(batches):
        trainer = Trainer(*shared.value)
        owns, around, held = [], [], 0

        def learn(all_of_it: bool):
            nonlocal owns, around, held
            o, a = np.concatenate(owns), np.concatenate(around, 1)
            end = len(o) if all_of_it else len(o) - len(o) % step
            for i in range(0, end, step):
                trainer.step(o[i : min(i + step, end)], a[:, i : min(i + step, end)])
            owns, around, held = [o[end:]], [a[:, end:]], len(o) - end

        for batch in batches:
            for packed in batch.column("outputs").to_pylist():
                own = np.frombuffer(packed, np.int32)
                if len(own):
                    owns.append(own)
                    around.append(windows(own))
                    held += len(own)
                if held >= 4 * step:
                    learn(False)
        if held:
            learn(True)
        if trainer.words:
            for block, value, weight in trainer.rows():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([value.tobytes()]), pa.array([weight.tobytes()])],
                    ["block", "value", "weight"],
                )

    parts = dealt(encoded, total, size).mapInArrow(run, "block int, value binary, weight binary")
    flat = flattened(start)
    for r in averaged(parts).toArrow().to_pylist():  # one network
        used = np.frombuffer(r["used"], bool)
        at = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(used))
        flat[at] = np.where(used[:, None], np.frombuffer(r["value"], np.float32).reshape(len(used), -1), flat[at])
    return unflattened(flat, start)


def encoded_documents(slim: DataFrame, outputs: Outputs) -> DataFrame:
    """``row, doc_id``, the outputs of a document's words and the hashes of those that share theirs."""
    def run(batches):
        for batch in batches:
            own, shared = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found, shares = outputs.find(words)
                own.append(found.astype(np.int32).tobytes())
                shared.append(words[shares].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(own, pa.binary()), pa.array(shared, pa.binary())], ["doc_id", "outputs", "shared"]
            )

    found = slim.mapInArrow(run, "doc_id bigint, outputs binary, shared binary")
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def shared_counts(encoded: DataFrame, counts: DataFrame, least: int, distinct: int) -> DataFrame:
    """``row, log_counts``: the sum of the logarithms of the counts of a document's words without an own output.

    Counts and documents' hashes meet by shard, the counts first, so a task holds one shard of the table and one batch.
    """
    shards = max(64, distinct // SHARD_WORDS)

    def shard_of(words):
        return ((words.view(np.uint64) >> np.uint64(8)) % np.uint64(shards)).astype(np.int64)

    def parts(name):
        def run(batches):
            for batch in batches:
                if name == "word":
                    words, others = batch.column("word").to_numpy(), batch.column("n").to_numpy()
                else:
                    packed = [np.frombuffer(b, np.int64) for b in batch.column("shared").to_pylist()]
                    words = np.concatenate(packed) if packed else np.zeros(0, np.int64)
                    others = np.repeat(batch.column("row").to_numpy(), [len(p) for p in packed])
                shard = shard_of(words)
                order = np.argsort(shard, kind="stable")
                words, others, shard = words[order], others[order], shard[order]
                starts = np.flatnonzero(np.diff(shard, prepend=-1))
                ends = np.append(starts[1:], len(shard))
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard[starts], pa.int64()), pa.array([int(name != "word")] * len(starts), pa.int32()),
                    pa.array([words[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([others[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ], ["shard", "kind", "words", "others"])
        return run

    schema = "shard bigint, kind int, words binary, others binary"
    table = counts.where(F.col("n") < least).mapInArrow(parts("word"), schema)
    asked = encoded.select("row", "shared").mapInArrow(parts("shared"), schema)

    def meet(batches):
        shard, known, logs, loading = None, None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                words, others = np.frombuffer(r["words"], np.int64), np.frombuffer(r["others"], np.int64)
                if r["shard"] != shard:
                    shard, loading = r["shard"], []
                if r["kind"] == 0:
                    loading.append((words, others))
                    continue
                if loading:
                    known, n = (np.concatenate(x) for x in zip(*loading))
                    order = np.argsort(known)
                    known, logs, loading = known[order], np.log(n[order]), []
                rows, place = np.unique(others, return_inverse=True)
                sums = np.bincount(place, logs[np.searchsorted(known, words)])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(sums)], ["row", "log_counts"])

    found = table.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    return found.mapInArrow(meet, "row bigint, log_counts double").groupBy("row").agg(F.sum("log_counts").alias("log_counts"))


def log_likelihoods(net: dict[str, np.ndarray], outputs: Outputs, texts: list[np.ndarray], chunk: int = 1 << 16) -> np.ndarray:
    """Of each text the sum of its words' conditional log probabilities, less the logarithms of the counts to be joined."""
    out, room = np.zeros(len(texts)), Room.of(outputs)
    owns, around, of, held = [], [], [], 0

    def add():
        own, sides, text = np.concatenate(owns), np.concatenate(around, 1), np.concatenate(of)
        for i in range(0, len(own), chunk):
            part = own[i : i + chunk]
            logs = log_probabilities(net, outputs, part, sides[:, i : i + chunk], room) - outputs.log_counts[part]
            np.add(out, np.bincount(text[i : i + chunk], logs, len(texts)), out=out)

    for k, own in enumerate(texts):
        owns.append(own)
        around.append(windows(own))
        of.append(np.full(len(own), k))
        held += len(own)
        if held >= chunk:
            add()
            owns, around, of, held = [], [], [], 0
    if held:
        add()
    return out


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, log_likelihood, per_word`` for every row of ``docs``; the same for any layout of its files.

    Null, empty and white texts have no words, a sum of 0 and a null mean. Null and repeated ids are rows of their own;
    other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = stored(counted(slim.select("text")))
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    schema = "row bigint, doc_id bigint, n_words bigint, known double"
    if not size.total:
        nothing = F.lit(None).cast("double")
        return slim.select("doc_id", F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("log_likelihood"), nothing.alias("per_word"))
    outputs = Outputs.of(counts, size.total)
    encoded = encoded_documents(slim, outputs)
    fitted = docs.sparkSession.sparkContext.broadcast((trained(encoded, outputs, size.total), outputs))

    def run(batches):
        net, outputs = fitted.value
        for batch in batches:
            packed = [np.frombuffer(b, np.int32) for b in batch.column("outputs").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), pa.array([len(p) for p in packed], pa.int64()),
                pa.array(log_likelihoods(net, outputs, packed), pa.float64()),
            ], ["row", "doc_id", "n_words", "known"])

    found = encoded.select("row", "doc_id", "outputs").mapInArrow(run, schema)
    tail = shared_counts(encoded, counts, least_own(size.total), size.distinct)
    total = F.col("known") + F.coalesce("log_counts", F.lit(0.0))
    return found.join(tail, "row", "left").select(
        "doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word")
    )
