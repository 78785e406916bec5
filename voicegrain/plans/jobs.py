"""End-to-end jobs. Each takes tables and a ``run`` function (prompt table to reply table, see
``operators.inference``) and returns a result table; reading and writing are left to ``sources``.

Every prompt table has ``prompt_id``, a hash of its key columns, and ``prompt``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voicegrain import templates
from voicegrain.functions import json_replies, replies, text
from voicegrain.lookups import PASS_THROUGH_PROMPT, SCORED_INTENTS, topic_of
from voicegrain.operators import (
    batching, grading, inference, metrics, pairing, parsing, sampling, sft,
)
from voicegrain.operators.post_store import write_store
from voicegrain.operators.ranking import hash_positions, hash_sample, position_in_group
from voicegrain.operators.once import compute_once
from voicegrain.plans import evaluation
from voicegrain.plans.counts import counted
from voicegrain.session import checkpoint
from voicegrain.sources.tables import constant_prompts, ranking_columns, yes_no_columns

Run = Callable[[DataFrame], DataFrame]
c = F.col


def with_prompt(rows: DataFrame, prompt: Column, *keys: str) -> DataFrame:
    """Adds ``prompt`` and a ``prompt_id`` made from the row's key."""
    return rows.withColumns({"prompt_id": F.md5(F.to_json(F.struct(*keys))), "prompt": prompt})


def ask(run: Run, prompts: DataFrame) -> DataFrame:
    """The replies; prompts and replies are stages of the job (see ``counts``)."""
    return counted(run(counted(prompts, "prompts", at_least=1)), "replies", at_least=1)


def extract_from_posts(
    posts: DataFrame, run: Run, users: int = 20, minimum: int = 10, most: int = 100, start: int = -1, seed=42,
    template: str = templates.USEFUL_POST,
) -> DataFrame:
    """One reply per post of the sampled users: is the post useful, and what does it tell?"""
    chosen = sampling.pick_users(sampling.users_above(sampling.posts_per_user(posts), minimum), seed, users, start)
    first = batching.first_posts(posts, chosen, most, users_at_most=users)
    prompt = text.fill_template(template, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_TWEET", c("tweet")))
    return ask(run, with_prompt(first.drop("rank"), prompt, "user", "ord"))


def extract_from_batches(
    posts: DataFrame, run: Run, users: int = 200, minimum: int = 10, most: int = 50, size: int = 5,
    template: str = templates.USEFUL_POSTS,
) -> DataFrame:
    """One reply per batch of posts, with its three fields or N/A for all of them."""
    able = sampling.users_with_batch(sampling.posts_per_user(posts), minimum, size)
    chosen = sampling.first_rows(able, "first_ord", users)
    first = batching.first_posts(posts, chosen, batching.batch_cover(size, most), users_at_most=users if users >= 0 else None)
    batches = batching.post_batches(first, size, most)
    listed = text.numbered(c("tweets"), "User Tweet ", ": ", joint="", end="\n")
    prompt = text.fill_template(template, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_USER_TWEETS", listed))
    names = ["UsefulInformation", "Justification", "UserInformation"]
    answered = parsing.parse_by(ask(run, with_prompt(batches, prompt, "user", "batch")), json_replies.as_it_is, names)
    return answered.withColumns(json_replies.all_or_nothing(c("parsed"), names)).drop("parsed")


def merge_descriptions(
    labelled: DataFrame, run: Run, template: str = templates.MERGE_DESCRIPTIONS, most_tags: int = 2000
) -> DataFrame:
    """Useful descriptions of each user, without repeats, merged by the model into one row per user.

    A prompt holds about ``most_tags`` tags (two at least). A user with more has them merged in parts, then the
    profiles of the parts, in as many rounds as it takes; ``round`` tells in which the row was made. Replies are kept,
    so each is asked for once.
    """
    prompt = text.fill_template(template, ("TEMPLATE_USER_ID", c("user")), ("TEMPLATE_USER_DESCRIPTION_LIST", c("descriptions")))
    tags, done, round_ = batching.distinct_tags(parsing.useful_posts(labelled)), None, 0
    while True:
        pages = batching.tag_pages(tags, max(2, most_tags)).withColumn("round", F.lit(round_))
        asked = ask(run, with_prompt(pages, prompt, "user", "page", "round"))
        merged = checkpoint(parsing.parse_replies(asked, ["user_id", "user_profile"]))
        split = merged.groupBy("user").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("user")
        whole = merged.join(split, "user", "left_anti")
        done = whole if done is None else done.unionByName(whole)
        if split.isEmpty():
            return done
        parts = merged.join(split, "user", "left_semi")
        tags = parts.select("user", F.coalesce("parsed.user_profile", "response", F.lit("")).alias("tag")).distinct()
        round_ += 1


def fictional_profiles(spark: SparkSession, run: Run, n: int, seed: int = 42, template: str = templates.FICTIONAL_PROFILE) -> DataFrame:
    """The same prompt ``n`` times with different seeds; equal prompts stay separate rows."""
    return ask(run, constant_prompts(spark, template, n, seed))


def profile_interest(
    profiles: DataFrame, items: DataFrame, dataset: str, run: Run, per_profile: int = 200, start: int = 0,
    most: int | None = 1000, seed=42, template: str = templates.INTEREST,
) -> DataFrame:
    """Interest of each profile in random items; ``profiles`` has ``ord``, ``items`` is an item pool."""
    end = F.lit(True) if most is None else c("ord") < start + most
    pool = hash_positions(items.select("item_id", "item_description"), seed, ["item_id"])
    pairs = pairing.pair_with_items(profiles.where((c("ord") >= start) & end), pool, per_profile, seed)
    topic, kind = topic_of(dataset)
    prompt = text.fill_template(
        template, ("TEMPLATE_ITEM_DESCRIPTION", c("item_description")), ("TEMPLATE_USER_NAME", c("user_id")),
        ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_ITEM_TYPE", kind), ("TEMPLATE_TOPIC", topic))
    rows = with_prompt(pairs.withColumn("dataset", F.lit(dataset)), prompt, "user_id", "item_no")
    return ask(run, rows.withColumn("user_name", c("user_id")))


def fictional_interactions(
    spark: SparkSession, items: DataFrame, dataset: str, run: Run, n: int = 100_000, low: int = 2, high: int = 83, seed=42,
    template: str = templates.HISTORY,
) -> DataFrame:
    """Random histories and candidates of one catalogue, judged by the model."""
    pool = hash_positions(items.select("item_id", "item_description"), seed, ["item_id"])
    made = pairing.synthetic_histories(spark.range(n).withColumnRenamed("id", "history_id"), pool, low, high, seed)
    topic = topic_of(dataset)[0]
    prompt = text.fill_template(
        template, ("TEMPLATE_TOPIC", topic), ("TEMPLATE_USER_INTERACTIONS", text.numbered(c("history"))),
        ("TEMPLATE_CANDIDATE_NEWS_ARTICLE", c("candidate")), ("TEMPLATE_CANDIDATE_ITEM", c("candidate")))
    return ask(run, with_prompt(made, prompt, "history_id"))


def interest_to_sft(
    interest: DataFrame, row_key: list[str], dataset: str, variant: str, bounds: dict | None = None, ratio: float = 0.9,
    by: list[str] | None = None, seed=42, system_prompt: str = templates.RECOMMENDER_SYSTEM,
    template: str = templates.RECOMMENDER_USER,
) -> tuple[DataFrame, DataFrame]:
    """(cleaned replies, fine-tuning rows with their ``split``); both are kept on reliable storage,
    because each is read more than once. No row at all is an error."""
    lengths = sampling.history_bounds(dataset, bounds)
    cleaned = checkpoint(sft.clean_interest(interest))
    rows = checkpoint(sft.build_pairs(
        cleaned, row_key, lengths, dataset, variant, system_prompt, template, seed))
    if rows.isEmpty():
        raise ValueError("no fine-tuning rows: no user has enough positives and a negative")
    return cleaned, sampling.split_exact(rows, seed, ["user_id", "answer"], ratio, by)


def personal_answers(
    profiles: DataFrame, questions: DataFrame, run: Run, per_profile: int = 200, start: int = 0, most: int | None = 100,
    template: str = templates.PERSONAL_ANSWER,
) -> DataFrame:
    """Each profile of the slice with the first questions; ``questions`` has a dense ``position``."""
    end = F.lit(True) if most is None else c("ord") < start + most
    asked = questions.select("position", "question", c("reference_ans").alias("reference_answer"))
    pairs = pairing.pair_with_first(profiles.where((c("ord") >= start) & end), asked, per_profile)
    prompt = text.fill_template(
        template, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question")),
        ("TEMPLATE_REFERENCE_ANSWER", c("reference_answer")))
    return ask(run, with_prompt(pairs, prompt, "ord", "position"))


def question_answers(
    questions: DataFrame, run: Run, intent: str, language: str, most: int, profiles: DataFrame | None = None,
    people: int = 0, seed=42, template: str | None = None,
) -> DataFrame:
    """Sampled questions of one intent and language, plain or for each of the sampled profiles."""
    asked = counted(questions, "questions").where((c("user_intent") == intent) & (c("language") == language))
    asked = counted(hash_sample(counted(asked, "questions of the intent"), seed, ["ord"], most), "sampled questions").drop("position")
    keys = ["ord"]
    fields = [("TEMPLATE_QUESTION", c("question"))]
    if profiles is not None:
        chosen = hash_sample(profiles, seed, ["user_id"], people).select("user_id", "user_profile")
        asked = pairing.pair_with_first(asked, hash_positions(chosen, seed, ["user_id"]), people)
        keys.append("user_id")
        fields = [("TEMPLATE_USER_NAME", c("user_id")), ("TEMPLATE_USER_PROFILE", c("user_profile")), *fields]
    template = template or (templates.QUESTION if profiles is None else templates.QUESTION_FOR_USER)
    return ask(run, with_prompt(asked, text.fill_template(template, *fields), *keys))


def finetuned_answers(rows: DataFrame, run: Run, most: int = 0, seed=42) -> DataFrame:
    """System prompt and question in one prompt; all rows unless ``most`` is positive."""
    rows = sampling.sample_if_positive(rows, seed, ["ord"], most)
    return ask(run, with_prompt(rows, F.concat("system_prompt", F.lit("\n"), "question"), "ord"))


def judge(
    answers: DataFrame, run: Run, rubric_table: DataFrame, with_profile: bool = False, strict: bool = False, key: str = "ord",
    template: str | None = None,
) -> DataFrame:
    """Grades every answer by its intent's rubric: adds ``scores`` and ``overall``."""
    template = template or (templates.GRADE_BY_PROFILE if with_profile else templates.GRADE_BY_REFERENCE)
    rows = grading.with_rubric(answers, rubric_table, strict)
    asked = with_prompt(rows, grading.grading_prompt(template, with_profile), key).withColumnRenamed("response", "answer")
    scored = ask(run, asked.drop("rubric")).withColumn("scores", replies.judge_scores(c("response")))
    return scored.withColumn("overall", replies.overall_score(c("scores")))


def judge_one_intent(answers: DataFrame, run: Run, rubric_table: DataFrame, intent: str, with_profile: bool = False) -> DataFrame:
    """All answers graded as one intent; an intent without a rubric is an error."""
    return judge(answers.withColumn("intent", F.lit(intent)), run, rubric_table, with_profile, strict=True)


def judge_finetuned(
    answers: DataFrame, run: Run, rubric_table: DataFrame, intent: str | None = None, most: int = 0, seed=42
) -> DataFrame:
    """Answers graded by the intent of each row; null answers and unknown intents are left out."""
    if intent in SCORED_INTENTS:
        answers = answers.where(c("intent") == intent)
    answers = sampling.sample_if_positive(answers, seed, ["ord"], most).where(c("response").isNotNull())
    return judge(answers.withColumn("response", replies.after_analysis(c("response"))), run, rubric_table, with_profile=True)


def predict_author(
    profiles: DataFrame, posts: DataFrame, run: Run, total: int = 5, per_query: int = 1, exclude: int = 100,
    people: int | None = 200, by_post: bool = False, seed=42, template: str = templates.AUTHOR,
) -> DataFrame:
    """Own and other posts for each profile with the ``truth`` and what the model ``said``.

    ``profiles`` has ``ord, user_id, user_profile``. Negatives are posts of sampled other users, or,
    with ``by_post``, single posts of anybody else.
    """
    people_rows = sampling.first_rows(profiles, "ord", people).select(
        c("ord").alias("profile_id"), c("user_id").alias("user"), "user_profile")
    store = write_store(posts)
    mine = pairing.self_positives(people_rows, store, exclude, total // 2, seed)
    counted = pairing.positive_counts(people_rows, mine)
    if by_post:
        places, keys, size = pairing.other_posts(counted, store.users, total, seed), ["profile_id", "other", "post_id"], 1
    else:
        pairs = pairing.other_users(counted, store.users, total, per_query, seed)
        places, keys, size = pairing.posts_of_others(pairs, per_query, seed), ["profile_id", "other"], per_query
    negatives = pairing.query_batches(store.fetch(places, "other"), keys, "post_no", size).drop("post_id")
    own = store.fetch(mine, columns=("tweet",)).withColumns({"other": c("user"), "number": c("rank") - 1})
    positives = pairing.query_batches(own, ["profile_id", "other"], "number", per_query)
    rows = positives.withColumn("truth", F.lit(True)).unionByName(negatives.withColumn("truth", F.lit(False)))
    return _ask_author(rows, people_rows, run, template)


def predict_author_from_useful(
    profiles: DataFrame, labelled: DataFrame, run: Run, total: int = 5, per_query: int = 1, exclude: int = 100,
    ratio: float = 0.5, people: int | None = 200, seed=42, template: str = templates.AUTHOR,
) -> DataFrame:
    """As ``predict_author`` over posts labelled useful, for profiles whose user has labelled posts, with what the labels
    tell about the user as ``user_information``, an entry for each post.

    ``labelled`` has ``post_id, user, ord, tweet, response``.
    """
    useful = checkpoint(parsing.useful_posts(labelled).select("post_id", "user", "ord", "tweet", c("description").alias("user_information")))
    store, useful_store = write_store(labelled.select("post_id", "user", "ord", "tweet")), write_store(useful)
    known = store.users.select("user")
    named = profiles.join(known.withColumnRenamed("user", "user_id"), "user_id", "left_semi")
    people_rows = sampling.first_rows(named, "ord", people).select(
        c("ord").alias("profile_id"), c("user_id").alias("user"), "user_profile")
    eligible = useful.select("post_id", "user_information")
    mine = pairing.self_positives(people_rows, store, exclude, int(total * ratio), seed, eligible=eligible)
    everyone = hash_positions(known, "users", ["user"], "user_position").join(
        useful_store.users.select("user", "n_posts"), "user", "left").na.fill(0, ["n_posts"])
    pairs = pairing.other_users(pairing.positive_counts(people_rows, mine), everyone, total, per_query, seed)
    others = pairing.posts_of_others(pairs, F.lit(total) - c("n_positive"), seed)
    negatives = useful_store.fetch(others, "other", ("post_id", "tweet", "user_information")).select(
        "profile_id", "other", c("post_no").cast("bigint").alias("batch"), F.array("tweet").alias("tweets"),
        F.array("user_information").alias("user_information"), F.lit(False).alias("truth"))
    own = store.fetch(mine, columns=("tweet",)).withColumns({"other": c("user"), "number": c("rank") - 1})
    positives = pairing.query_batches(own, ["profile_id", "other"], "number", per_query, "user_information")
    return _ask_author(positives.withColumn("truth", F.lit(True)).unionByName(negatives), people_rows, run, template)


def _ask_author(rows: DataFrame, people: DataFrame, run: Run, template: str) -> DataFrame:
    listed = text.numbered(c("tweets"), "Tweet ", ": ")
    prompt = text.fill_template(template, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_USER_PROFILE", c("user_profile")),
                                ("TEMPLATE_TWEETS", listed))
    asked = with_prompt(rows.join(people, "profile_id"), prompt, "profile_id", "other", "batch", "truth", "tweets")
    answered = parsing.parse_replies(ask(run, asked), ["IsFromUser"])
    return answered.withColumn("said", parsing.flag(c("parsed"), "IsFromUser")).drop("parsed")


def profile_questions(rows: DataFrame, run: Run, most: int, seed=42, template: str = templates.PROFILE_QUESTION) -> DataFrame:
    """Sampled questions about profiles (``ord, user_name, user_profile, question, answer``) with the
    model's answer as ``said``."""
    prompt = text.fill_template(template, ("TEMPLATE_USER_NAME", c("user_name")), ("TEMPLATE_USER_PROFILE", c("user_profile")),
                                ("TEMPLATE_QUESTION", c("question")))
    asked = with_prompt(hash_sample(rows, seed, ["ord"], most), prompt, "ord")
    return parsing.parse_replies(ask(run, asked), ["Answer"]).withColumn("said", c("parsed.Answer")).drop("parsed")


def _answer_columns(questions: DataFrame) -> DataFrame:
    return questions.select(
        "ord", "position", "question", c("reference_ans").alias("reference_answer"), c("user_intent").alias("intent"))


def perspectives_of_first(profiles: DataFrame, questions: DataFrame, run: Run, n: int = 50, template: str = templates.PERSPECTIVE) -> DataFrame:
    """Every question answered for each of the first ``n`` profiles."""
    people = position_in_group(profiles.select("ord", "user_profile"), [], "ord").drop("ord")
    pairs = pairing.pair_with_first(_answer_columns(questions).drop("position"), people, n)
    prompt = text.fill_template(template, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question")))
    return ask(run, with_prompt(pairs, prompt, "ord", "position"))


def perspectives_of_related(
    annotation: DataFrame, questions: DataFrame, run: Run, n: int = 50, cap: int | None = 50, seed=42,
    template: str = templates.PERSPECTIVE,
) -> DataFrame:
    """Questions with more than ``n`` matching profiles, answered for up to ``cap`` of them.

    Where the annotation has a ``response`` only rows with MatchUserProfile YES count.
    """
    if "response" in annotation.columns:
        annotation = parsing.parse_replies(annotation, ["MatchUserProfile"]).where(c("parsed.MatchUserProfile") == "YES")
    pairs = pairing.related_profiles(_answer_columns(questions), annotation, n, cap, seed)
    prompt = text.fill_template(template, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question")))
    return ask(run, with_prompt(pairs, prompt, "ord", "user_profile"))


def repeated_answers(
    questions: DataFrame, run: Run, n: int = 50, seed: int = 42, temperature: float | None = None,
    model_temperature: float = 0.7, template: str = templates.QUESTION,
) -> DataFrame:
    """Every question asked ``n`` times without a profile, each time with its own seed."""
    rows = _answer_columns(questions)
    total = rows.agg(F.count(F.lit(1))).scalar()
    rows = rows.withColumn("sample_idx", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(n)]) if n > 0 else F.array().cast("array<bigint>"))).withColumns({
        "seed": F.lit(seed) + c("sample_idx") * total + c("position"),
        "sampling_temperature": F.coalesce(F.lit(temperature).cast("double"), F.lit(float(model_temperature))),
    })
    return ask(run, with_prompt(rows, text.fill_template(template, ("TEMPLATE_QUESTION", c("question"))), "ord", "sample_idx"))


def aggregate_answers(
    answers: DataFrame, run: Run, counts: str | int = "1-5-10", max_length: int = 3000, uncapped_up_to: int = 10,
    template: str = templates.SUMMARY,
) -> DataFrame:
    """One merged answer per question and K; K = 1 passes its only answer through without the model."""
    rows = batching.answers_by_count(answers, replies.counts_list(counts), max_length, uncapped_up_to)
    single = (c("k") == 1) & (F.size("answers") > 0)
    prompt = text.fill_template(template, ("TEMPLATE_QUESTION", c("question")), ("TEMPLATE_ANSWERS", F.array_join("answers", "\n")))
    rows = with_prompt(rows, F.when(single, PASS_THROUGH_PROMPT).otherwise(prompt), "question", "k")
    return inference.split_pass_through(rows, single, F.try_element_at("answers", F.lit(1)), run)


def judge_aggregated(merged: DataFrame, run: Run, rubric_table: DataFrame) -> DataFrame:
    """Merged answers made fit for grading, then graded against the reference."""
    rows = parsing.with_scoring_text(merged).where(c("scoring_text").isNotNull())
    rows = rows.withColumn("response", c("scoring_text")).select("prompt_id", "question", "intent", "reference_answer", "k", "response")
    return judge(rows.withColumnRenamed("prompt_id", "answer_id"), run, rubric_table, strict=True, key="answer_id")


def sft_table(rows: DataFrame, key: list[str], most: int = 10_000, seed=42, completion_only: bool = True, model_name: str = "") -> DataFrame:
    """Rows of ``question, answer, system_prompt`` ready for training, shuffled and cut to ``most``."""
    kept = hash_sample(sft.filled_rows(yes_no_columns(rows)), seed, key, most)
    return sft.format_completion(kept, model_name) if completion_only else sft.format_messages(kept)


def score_yes_no(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of stored YES/NO replies: ``answer, response``."""
    said = rows.withColumns({"said": replies.yes_no(c("response")), "target": replies.yes_no_target(c("answer"))})
    return metrics.yes_no_metrics(said, "said", "target", by)


def score_lists(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of stored list replies: ``target, response``."""
    return metrics.list_metrics(compute_once(rows, "items", replies.list_reply(c("response"))), "items", "target", "response", by)


def score_ratings(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Metrics of stored rating replies: ``target, response``."""
    return metrics.rating_metrics(evaluation.with_rating(rows), "stars", "confidence", "target", by)


def recommend_and_score(rows: DataFrame, make_model, rounds: int = 10, by: list[str] = ()) -> DataFrame:
    """Metrics of recommendations round by round; ``evaluation.rounds`` keeps the records too."""
    return evaluation.rounds(rows, make_model, rounds, by).metrics.where("is_total" if not by else "not is_total").drop("is_total")
