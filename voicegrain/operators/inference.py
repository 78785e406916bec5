"""Running a user-supplied model function over a prompt table.

The function gets a list of prompts and returns as many replies. It is made once per task by a
factory, so a client or model is opened where it is used. Everything else is a table operation.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from voicegrain.functions.text import as_column
from voicegrain.functions.replies import allowed_input, estimated_tokens, too_long_reply
from voicegrain.lookups import EMPTY_REPLY, RECOVERABLE_ERRORS, RECOVERABLE_REPLY, RETRIES_EXHAUSTED_REPLY
from voicegrain.session import checkpoint
from voicegrain.sources.sinks import append_replies, pending, saved_replies

REPLY_FIELDS = [
    StructField("response", StringType()), StructField("status", StringType()),
    StructField("error", StringType()), StructField("attempts", LongType()),
]


class RetryLater(Exception):
    """Raise from a model function for a rate limit, a server error or a timeout."""


class GiveUp(Exception):
    """Raise from a model function for a request that must not be tried again."""


def spread(rows: DataFrame, by: list[str]) -> DataFrame:
    """Shuffle rows by a unique key so that tasks get equal shares, however uneven the input splits are.

    Worth its cost where a row's model call takes far longer than moving the row.
    """
    return rows.repartition(*by) if by else rows


def infer(
    prompts: DataFrame, make_model: Callable[[], Callable], batch_size: int = 128,
    inputs: list[str] = (), recoverable: list[str] = RECOVERABLE_ERRORS, spread_by: list[str] = (),
) -> DataFrame:
    """Adds ``response, status, error, attempts`` to every prompt row.

    Batches of ``batch_size`` prompts go to the model, with the ``inputs`` columns (seeds,
    temperatures) as further lists. A recoverable error sends a batch's prompts one by one and marks
    those that fail again; any other error ends the job. ``spread_by`` (see ``spread``) evens out tasks.
    """
    prompts = spread(prompts, spread_by)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in parts:
            model = model or make_model()
            for start in range(0, part.num_rows, batch_size):
                batch = part.slice(start, batch_size)
                asked = [batch.column(name).to_pylist() for name in ("prompt", *inputs)]
                yield with_replies(batch, ask_isolated(model, asked, recoverable))

    return prompts.mapInArrow(run, StructType(prompts.schema.fields + REPLY_FIELDS))


def ask_isolated(model: Callable, asked: list[list], recoverable: list[str]) -> list[tuple]:
    """``response, status, error, attempts`` for each prompt of a batch. A recoverable error sends the prompts one by
    one and marks those that fail again."""
    def call(lists: list[list]) -> list:
        replies = list(model(*lists))
        if len(replies) != len(lists[0]):
            raise ValueError(f"{len(lists[0])} prompts but {len(replies)} replies")
        return replies

    def settle(reply, attempts: int) -> tuple:
        return (EMPTY_REPLY, "empty", None, attempts) if reply is None else (reply.strip(), "ok", None, attempts)

    def known(error: Exception) -> bool:
        return any(text in str(error) for text in recoverable)

    try:
        return [settle(reply, 1) for reply in call(asked)]
    except Exception as error:
        if not known(error):
            raise
    out = []
    for one in zip(*asked, strict=True):
        try:
            out.append(settle(call([[x] for x in one])[0], 2))
        except Exception as error:
            if not known(error):
                raise
            out.append((RECOVERABLE_REPLY, "error", str(error), 2))
    return out


def with_replies(batch: pa.RecordBatch, replies: list[tuple]) -> pa.RecordBatch:
    """The batch, its columns untouched, with the reply columns behind them."""
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    added = [pa.array([r[i] for r in replies], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *[f.name for f in REPLY_FIELDS]])


def infer_requests(
    prompts: DataFrame, make_request: Callable[[], Callable[[str], str]], batch_size: int = 32,
    workers: int = 8, tries: int = 3, delay: float = 1.0, spread_by: list[str] = (),
    clock: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Like ``infer`` for a function of one prompt, with threads inside a task and retries in later rounds.

    ``RetryLater`` is due again after ``delay * 2^attempt`` and, when tries run out, leaves a sentinel reply.
    ``GiveUp`` fails at once. Other errors are due after ``delay`` and fail at the last try. A failed prompt
    becomes an error row and does not end the job. No task waits: a round's rows are kept with the time they are due, the
    driver lets that pass, and the next round asks for them alone. Replies kept are never asked for again. Runs when called.
    """
    schema = StructType([*prompts.schema.fields, *REPLY_FIELDS, StructField("_due", DoubleType())])
    names = [f.name for f in REPLY_FIELDS]

    def ask_once(request, prompt: str, attempt: int) -> tuple:
        try:
            return request(prompt).strip(), "ok", None, attempt, None
        except RetryLater:
            if attempt == tries:
                return RETRIES_EXHAUSTED_REPLY, "error", "retries exhausted", attempt, None
            return None, "due", None, attempt, time.time() + delay * 2 ** (attempt - 1)
        except GiveUp as error:
            return f"[ERROR: {error}]", "error", str(error), attempt, None
        except Exception as error:
            if attempt == tries:
                return f"[ERROR: {error}]", "error", str(error), attempt, None
            return None, "due", str(error), attempt, time.time() + delay

    def round_of(attempt: int):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            request = None
            with ThreadPoolExecutor(workers) as pool:
                for part in parts:
                    request = request or make_request()
                    for start in range(0, part.num_rows, batch_size):
                        batch = part.slice(start, batch_size)
                        found = list(pool.map(lambda p: ask_once(request, p, attempt), batch.column("prompt").to_pylist()))
                        done = with_replies(batch, [f[:4] for f in found])
                        yield done.append_column("_due", pa.array([f[4] for f in found], pa.float64()))
        return run

    todo, settled = spread(prompts, spread_by), []
    for attempt in range(1, tries + 1):
        asked = checkpoint(todo.mapInArrow(round_of(attempt), schema))
        settled.append(asked.where(F.col("_due").isNull()).drop("_due"))
        again = asked.where(F.col("_due").isNotNull())
        due = again.agg(F.max("_due")).first()[0]
        if due is None:
            break
        wait(max(0.0, due - clock()))
        todo = spread(again.drop("_due", *names), spread_by)
    return reduce(DataFrame.unionByName, settled)


def guard_length(prompts: DataFrame, max_tokens, context, tokens: Column | None = None) -> DataFrame:
    """Adds ``n_tokens, allowed_tokens, skip_reply``; the last is null for prompts that may be sent.

    ``max_tokens`` and ``context`` are numbers or columns of a settings table joined before.
    """
    n = (estimated_tokens(F.col("prompt")) if tokens is None else tokens).cast("bigint")
    allowed = allowed_input(as_column(max_tokens), as_column(context)).cast("bigint")
    return prompts.withColumns({
        "n_tokens": n, "allowed_tokens": allowed,
        "skip_reply": F.when(n > allowed, too_long_reply(n, allowed)),
    })


def infer_guarded(prompts: DataFrame, run: Callable[[DataFrame], DataFrame], max_tokens: int, context: int) -> DataFrame:
    """Send only prompts within the token budget; the others get a sentinel reply with both numbers."""
    guarded = guard_length(prompts, max_tokens, context)
    extra = ["n_tokens", "allowed_tokens", "skip_reply"]
    sent = run(guarded.where(F.col("skip_reply").isNull()).drop(*extra))
    skipped = guarded.where(F.col("skip_reply").isNotNull()).withColumns({
        "response": F.col("skip_reply"), "status": F.lit("skipped"), "error": F.lit(None).cast("string"),
        "attempts": F.lit(0).cast("bigint"),
    }).drop(*extra)
    return sent.unionByName(skipped)


def infer_and_keep(prompts: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the model once and keep the replies on reliable storage, for results used more than once."""
    return checkpoint(run(prompts))


def infer_resumable(
    prompts: DataFrame, run: Callable[[DataFrame], DataFrame], path: str, run_id: str, parts: int = 1
) -> DataFrame:
    """Append replies to a table in ``parts`` separate writes and skip prompts that have one already.

    A job that stops in between loses at most the part it was writing. ``prompt_id`` must be unique. The prompts are
    made once, before the first part.
    """
    spark = prompts.sparkSession
    prompts = checkpoint(prompts) if parts > 1 else prompts
    for part in range(parts):
        mine = prompts.where(F.pmod(F.xxhash64("prompt_id"), F.lit(parts)) == part)
        append_replies(run(pending(mine, saved_replies(spark, path, run_id))), path, run_id)
    return saved_replies(spark, path, run_id)


def infer_files(
    spark: SparkSession, folder: str, schema: str, run: Callable[[DataFrame], DataFrame], path: str, files_per_batch: int = 1
) -> DataFrame:
    """Answer all prompt files of a folder, a few files at a time, and read the replies back.

    The files are a stream with its progress in a checkpoint, and replies are written by a sink that shows those of
    finished batches only. A run that stops in the middle is taken up at the file it stopped at, files that came since
    are answered too, and every prompt has one reply. ``run`` may not aggregate or sort.
    """
    prompts = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = (
        run(prompts).writeStream.format("parquet").option("path", f"{path}/replies")
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.parquet(f"{path}/replies")


def attach(prompts: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies stored apart from their prompts are joined back by ``prompt_id``."""
    return prompts.join(replies.select("prompt_id", "response", "status"), "prompt_id")


def split_pass_through(rows: DataFrame, passes: Column, reply: Column, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that ``passes`` keep ``reply`` as their response; only the others go to the model."""
    direct = rows.where(passes).withColumns({"response": reply, "status": F.lit("direct")})
    return direct.unionByName(run(rows.where(~passes)), allowMissingColumns=True)


def recommend_in_rounds(
    rows: DataFrame, make_model: Callable[[], Callable[[list[str]], list[str]]], rounds: int = 10,
    make_prompt: Callable[[str, list[str]], str] | None = None, batch_size: int = 128, spread_by: list[str] = (),
    recoverable: list[str] = RECOVERABLE_ERRORS,
) -> DataFrame:
    """Ask for one item at a time: match the reply to the remaining candidates and take it out.

    ``rows`` has ``interaction_history`` (text) and ``candidates`` (array). Each round asks for all
    rows of a batch at once, with the isolation of ``infer``. A reply that matches nothing, or fails, uses up its
    round. Adds ``recommendations, responses, prompts``: the items taken, and what was said and asked in each round.
    """
    rows = spread(rows, spread_by)
    names = ["recommendations", "responses", "prompts"]
    schema = StructType(list(rows.schema.fields))
    for name in names:
        schema = schema.add(name, ArrayType(StringType()))
    make_prompt = make_prompt or next_item_prompt

    def play(model, batch: pa.RecordBatch) -> pa.RecordBatch:
        left = [list(c or []) for c in batch.column("candidates").to_pylist()]
        chosen, said, asked = ([[] for _ in left] for _ in names)
        histories = batch.column("interaction_history").to_pylist()
        for _ in range(rounds):
            active = [i for i, items in enumerate(left) if items]
            if not active:
                break
            prompts = [make_prompt(histories[i], left[i]) for i in active]
            replies = ask_isolated(model, [prompts], recoverable)
            for i, prompt, (reply, status, _, _) in zip(active, prompts, replies, strict=True):
                asked[i].append(prompt)
                said[i].append(reply)
                item = matching_item(reply, left[i]) if status == "ok" else None
                if item:
                    chosen[i].append(item)
                    left[i].remove(item)
        added = [pa.array(x, pa.list_(pa.string())) for x in (chosen, said, asked)]
        return pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for part in parts:
            model = model or make_model()
            for start in range(0, part.num_rows, batch_size):
                yield play(model, part.slice(start, batch_size))

    return rows.mapInArrow(run, schema)


def next_item_prompt(history: str, candidates: list[str]) -> str:
    return (
        "Choose exactly one item to recommend next. Reply with its name only.\n"
        f"Items the user interacted with, in no particular order:\n{history}\nCandidates:\n{', '.join(candidates)}"
    )


def matching_item(reply: str, candidates: list[str]) -> str | None:
    """The rule of ``replies.match_item`` for one row: equal, inside the reply, around the reply."""
    parts = reply.split("</think>")
    said = (parts[1] if len(parts) > 1 else reply).strip().lower()
    lowered = [c.lower() for c in candidates]
    rules = (lambda c: c == said, lambda c: c in said, lambda c: said in c)
    return next((item for rule in rules for item, low in zip(candidates, lowered) if rule(low)), None)
