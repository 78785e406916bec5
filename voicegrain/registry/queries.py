"""One query per operator group. Each takes (spark, folder) and reads the given tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voicegrain import schemas, templates
from voicegrain.functions import json_replies, replies, text
from voicegrain.lookups import DATASET_TOPICS, PASS_THROUGH_PROMPT, topic_of
from voicegrain.operators import (
    batching, grading, inference, metrics, pairing, parsing, retrieval, sampling, scrubbing, sft, vector_index,
)
from voicegrain.operators.once import compute_once
from voicegrain.operators.post_store import write_store
from voicegrain.operators.ranking import hash_positions, hash_sample, position_in_group
from voicegrain.plans import evaluation
from voicegrain.registry import views
from voicegrain.session import checkpoint, shared_folder
from voicegrain.sources import sinks, tables
from voicegrain.sources.tables import item_pool

SEED = 42
c = F.col


def posts_normalised(spark, folder) -> DataFrame:
    raw = views.table(spark, folder, "documents").select(
        c("doc_id").alias("post_id"), c("source").alias("author"), "text", c("doc_id").alias("ord"))
    return tables.post_columns(raw)


def posts_copied(spark, folder) -> DataFrame:
    raw = views.table(spark, folder, "documents").select(c("doc_id").alias("post_id"), c("source").alias("author"), "text")
    return tables.copy_post_columns(raw)


def item_display(spark, folder) -> DataFrame:
    part = views.table(spark, folder, "part").select(
        c("p_partkey").alias("item_id"), c("p_name").alias("title"),
        F.when(c("p_size") % 10 != 0, c("p_size").cast("double")).alias("year"),
        F.when(c("p_type") != "ECONOMY", c("p_type")).alias("cat"), c("p_brand").alias("name"),
        F.nullif("p_brand", F.lit("Brand#2")).alias("detail_desc"),
    )
    shown = [item_pool(part, d).select("item_id", F.lit(d).alias("dataset"), "item_description")
             for d in ("netflix", "pens", "books", "hm")]
    return shown[0].unionByName(shown[1]).unionByName(shown[2]).unionByName(shown[3])


def user_post_counts(spark, folder) -> DataFrame:
    return sampling.posts_per_user(views.posts_wide(spark, folder))


def _picked_posts(spark, folder) -> DataFrame:
    posts = views.posts_wide(spark, folder)
    users = sampling.pick_users(sampling.users_above(sampling.posts_per_user(posts), 60), SEED, 20)
    return batching.first_posts(posts, users, 50, users_at_most=20)


def profile_prompts(spark, folder) -> DataFrame:
    return _picked_posts(spark, folder).select(
        "user", "post_id", c("rank").cast("bigint").alias("rank"),
        text.fill_template(templates.USEFUL_POST, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_TWEET", c("tweet")))
        .alias("prompt"))


def user_shard(spark, folder) -> DataFrame:
    users = sampling.posts_per_user(views.posts_wide(spark, folder))
    return sampling.pick_users(users, SEED, 25, start=40).select("user", "n_posts")


def question_filter_sample(spark, folder) -> DataFrame:
    asked = views.questions(spark, folder).where("user_intent = 'Leisure' and language = 'EN'")
    return hash_sample(asked, SEED, ["ord"], 40).select("ord", "question")


def reply_parse_stage(spark, folder) -> DataFrame:
    rows = parsing.parse_replies(views.interest_replies(spark, folder), ["IsInterested"], kinds=False)
    return rows.groupBy(
        c("shape").cast("bigint").alias("shape"), c("parsed.stage").alias("stage"), c("parsed.IsInterested").alias("label"),
    ).agg(F.count(F.lit(1)).alias("n"))


def reply_fields(spark, folder) -> DataFrame:
    rows, names = views.interest_replies(spark, folder), ["Justification", "IsInterested"]
    rules = {"last_braces": json_replies.in_last_braces, "from_brace": json_replies.from_last_brace,
             "final_channel": json_replies.in_final_channel, "strict": json_replies.as_it_is}
    rows = parsing.parse_by_rules(rows, rules, names, kinds=("strict",))
    batch = json_replies.all_or_nothing(c("strict"), names)
    return rows.select(
        "row_key", *[c(out)["IsInterested"].alias(out) for out in ("last_braces", "from_brace", "final_channel")],
        *[column.alias(f"batch_{name.lower()}") for name, column in batch.items()],
    )


def prompt_length_guard(spark, folder) -> DataFrame:
    settings = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(t).alias("max_tokens"), F.lit(x).alias("context"))
        for m, t, x in (("small", 512, 1024), ("wide", 2048, 2048), ("long", 4096, 32768))
    ]))
    prompts = views.posts(spark, folder).select(
        "post_id", text.fill_template(templates.USEFUL_POST, ("TEMPLATE_USER_NAME", c("user")),
                                      ("TEMPLATE_TWEET", c("tweet"))).alias("prompt"), settings.alias("s"))
    return inference.guard_length(prompts, c("s.max_tokens"), c("s.context")).select(
        "post_id", c("s.model").alias("model"), "n_tokens", "allowed_tokens", "skip_reply")


def chat_messages(spark, folder) -> DataFrame:
    q = c("question")
    prompt = (
        F.when(c("ord") % 4 == 0, F.concat(F.lit("Answer for the user. \nUser Profile: likes tea\nQuestion: "), q))
        .when(c("ord") % 4 == 1, F.concat(F.lit("Answer.\nQuestion: "), q))
        .when(c("ord") % 4 == 2, F.concat(F.lit("\n"), q)).otherwise(q)
    )
    m = text.chat_messages(prompt)
    return views.questions(spark, folder).withColumn("m", m).select(
        "ord", F.size("m").cast("bigint").alias("n_messages"), c("m")[0]["role"].alias("first_role"),
        c("m")[0]["content"].alias("first_content"), F.element_at("m", -1)["content"].alias("last_content"))


def stub_model():
    """Replies whether the prompt's length is even; a batch with a length divisible by 7 fails as a whole."""
    def model(prompts: list[str]) -> list[str | None]:
        if any(len(p) % 7 == 0 for p in prompts):
            raise RuntimeError("Invalid prefix encountered while decoding")
        return [None if len(p) % 11 == 0 else f' {{"UsefulInformation": {str(len(p) % 2 == 0).lower()}}} ' for p in prompts]
    return model


def batch_inference_stub(spark, folder) -> DataFrame:
    prompts = views.posts(spark, folder).select(
        c("post_id").alias("prompt_id"), text.fill_template(
            templates.USEFUL_POST, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_TWEET", c("tweet"))).alias("prompt"))
    return inference.infer(prompts, stub_model, batch_size=32, spread_by=["prompt_id"]).select("prompt_id", "response", "status")


def resume_pending(spark, folder) -> DataFrame:
    prompts = views.posts(spark, folder).select(c("post_id").alias("prompt_id"), "user")
    done = views.table(spark, folder, "labels").select(c("doc_id").alias("prompt_id"))
    return sinks.pending(prompts, done)


def post_batches(spark, folder) -> DataFrame:
    posts = views.posts_wide(spark, folder)
    users = sampling.users_with_batch(sampling.posts_per_user(posts), 60, 5)
    users = sampling.first_rows(users, "first_ord", 20)
    first = batching.first_posts(posts, users, batching.batch_cover(5, 48), users_at_most=20)
    listed = text.numbered(c("tweets"), "User Tweet ", ": ", joint="", end="\n")
    return batching.post_batches(first, 5, 48).select(
        "user", "batch", F.size("tweets").cast("bigint").alias("n_tweets"),
        text.fill_template(templates.USEFUL_POSTS, ("TEMPLATE_USER_NAME", c("user")), ("TEMPLATE_USER_TWEETS", listed))
        .alias("prompt"))


def user_descriptions(spark, folder) -> DataFrame:
    said = parsing.useful_posts(views.labelled_posts(spark, folder)).select("user", "description")
    return batching.tag_pages(batching.distinct_tags(said))


def profile_scrub(spark, folder) -> DataFrame:
    return scrubbing.scrub(views.posts(spark, folder).select("post_id", "tweet"), "tweet").drop("tweet")


def constant_prompts(spark, folder) -> DataFrame:
    people = views.table(spark, folder, "customer").count()
    return tables.constant_prompts(spark, templates.FICTIONAL_PROFILE, people, SEED)


def profile_item_pairs(spark, folder) -> DataFrame:
    topic, kind = DATASET_TOPICS["netflix"]
    pairs = pairing.pair_with_items(
        views.profiles(spark, folder).select("user_id", "user_profile"), views.pool(spark, folder), 20, SEED)
    return pairs.select(
        "user_id", c("item_no").cast("bigint").alias("item_no"), "item_description",
        text.fill_template(
            templates.INTEREST, ("TEMPLATE_ITEM_DESCRIPTION", c("item_description")), ("TEMPLATE_USER_NAME", c("user_id")),
            ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_ITEM_TYPE", kind), ("TEMPLATE_TOPIC", topic),
        ).alias("prompt"))


def profile_question_pairs(spark, folder) -> DataFrame:
    people = views.profiles(spark, folder).where("ord >= 10")
    asked = views.questions(spark, folder).select("position", "question", "reference_ans")
    return pairing.pair_with_first(people, asked, 10).select(
        "user_id", "position", text.fill_template(
            templates.PERSONAL_ANSWER, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question")),
            ("TEMPLATE_REFERENCE_ANSWER", c("reference_ans"))).alias("prompt"))


def question_profile_pairs(spark, folder) -> DataFrame:
    asked = views.questions(spark, folder).where("user_intent = 'Leisure' and language = 'EN'")
    asked = hash_sample(asked, SEED, ["ord"], 50).drop("position")
    people = views.profiles(spark, folder).select("user_id", "user_profile")
    people = hash_sample(people, SEED, ["user_id"], 20, "position")
    return pairing.pair_with_first(asked, people, 20).select(
        "ord", "user_id", text.fill_template(
            templates.QUESTION_FOR_USER, ("TEMPLATE_USER_NAME", c("user_id")), ("TEMPLATE_USER_PROFILE", c("user_profile")),
            ("TEMPLATE_QUESTION", c("question"))).alias("prompt"))


def synthetic_histories(spark, folder) -> DataFrame:
    rows = views.table(spark, folder, "customer").select(c("c_custkey").alias("history_id"))
    made = pairing.synthetic_histories(rows, views.pool(spark, folder), 2, 40, SEED)
    return made.select(
        "history_id", "history_size", "candidate", text.fill_template(
            templates.HISTORY, ("TEMPLATE_TOPIC", DATASET_TOPICS["netflix"][0]),
            ("TEMPLATE_USER_INTERACTIONS", text.numbered(c("history"))), ("TEMPLATE_CANDIDATE_ITEM", c("candidate")))
        .alias("prompt"))


def finetuned_prompts(spark, folder) -> DataFrame:
    rows = views.questions(spark, folder).withColumn("system_prompt", F.concat(F.lit("You serve "), c("user_intent")))
    return sampling.sample_if_positive(rows, SEED, ["ord"], 0).select(
        "ord", F.concat("system_prompt", F.lit("\n"), "question").alias("prompt"))


def finetuned_sample(spark, folder) -> DataFrame:
    rows = views.questions(spark, folder).withColumn("system_prompt", F.concat(F.lit("You serve "), c("user_intent")))
    return sampling.sample_if_positive(rows, SEED, ["ord"], 25).select(
        "ord", F.concat("system_prompt", F.lit("\n"), "question").alias("prompt"))


def sft_cut(spark, folder) -> DataFrame:
    rows = views.table(spark, folder, "documents").select("doc_id", c("text").alias("question"), c("lang").alias("answer"))
    return hash_sample(sft.filled_rows(rows), SEED, ["doc_id"], 150).select("doc_id", "question", "answer")


def default_topic_prompts(spark, folder) -> DataFrame:
    topic, kind = topic_of("a catalogue of our own")
    return views.pool(spark, folder).select("item_id", text.fill_template(
        templates.INTEREST, ("TEMPLATE_ITEM_DESCRIPTION", c("item_description")), ("TEMPLATE_USER_NAME", F.lit("u")),
        ("TEMPLATE_USER_PROFILE", F.lit("p")), ("TEMPLATE_ITEM_TYPE", kind), ("TEMPLATE_TOPIC", topic)).alias("prompt"))


def repeated_candidates(spark, folder) -> DataFrame:
    rows = views.ranking_eval(spark, folder).select("o_orderkey", "interaction_history", F.concat("candidates", "candidates").alias("candidates"))
    played = inference.recommend_in_rounds(rows, last_candidate_model, rounds=2, spread_by=["o_orderkey"])
    return played.select("o_orderkey", F.array_join("recommendations", "|").alias("taken"), F.size("prompts").cast("bigint").alias("n_prompts"))


def profiles_from_csv(spark, folder) -> DataFrame:
    """Texts written as quoted CSV with their line breaks, and read back in splits, in file order."""
    rows = views.table(spark, folder, "documents").select(c("doc_id").alias("user_id"), F.coalesce("text", F.lit("")).alias("user_profile"))
    path = shared_folder(spark)
    rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    found = tables.read_profiles(spark, path)
    return found.select(c("user_id").cast("bigint").alias("user_id"), F.md5(F.coalesce("user_profile", F.lit(""))).alias("digest"),
                        F.length(F.coalesce("user_profile", F.lit(""))).cast("bigint").alias("n_chars"))


def questions_from_json(spark, folder) -> DataFrame:
    """Evaluation rows written as JSON lines; those of one setting and task are read."""
    rows = views.ranking_eval(spark, folder).select(
        c("o_orderkey").cast("string").alias("prompt"), "target", F.when(c("o_orderkey") % 3 == 0, "few").otherwise("zero").alias("few_zero"),
        F.when(c("o_orderkey") % 2 == 0, "direct").otherwise("sequential").alias("task"))
    path = shared_folder(spark)
    rows.write.json(path)
    return tables.read_few_zero(spark, path, "zero", "direct").select(c("prompt").cast("bigint").alias("o_orderkey"), "target")


def interest_clean(spark, folder) -> DataFrame:
    return sft.clean_interest(views.interest_replies(spark, folder)).select(
        "row_key", "user_name", "item_description", "justification", "is_interested")


def _sft_pairs(spark, folder) -> DataFrame:
    return _pairs_of(sft.clean_interest(views.interest_replies(spark, folder)))


def _pairs_of(cleaned: DataFrame) -> DataFrame:
    return sft.build_pairs(
        cleaned, ["row_key"], sampling.history_bounds("netflix", {"netflix": (1, 100)}),
        "netflix", "base", templates.RECOMMENDER_SYSTEM, templates.RECOMMENDER_USER, SEED)


def sft_pairs(spark, folder) -> DataFrame:
    return _sft_pairs(spark, folder)


def sft_split(spark, folder) -> DataFrame:
    keys = ["user_id", "answer"]
    rows = checkpoint(_sft_pairs(spark, folder).select(*keys))  # read by both splits
    by_row = sampling.split_exact(rows, SEED, keys, 0.9)
    by_user = sampling.split_exact(rows, SEED, keys, 0.9, by=["user_id"], column="user_split")
    return by_row.join(by_user, keys)


def sft_format(spark, folder) -> DataFrame:
    rows = views.table(spark, folder, "documents").select(
        "doc_id", c("text").alias("question"), F.when(c("doc_id") % 10 == 3, "").otherwise(F.concat(F.lit("  lang "), "lang", F.lit("\n"))).alias("answer"),
        F.when(c("doc_id") % 3 == 0, F.lit(None)).when(c("doc_id") % 3 == 1, "").otherwise(" Name the language. ").alias("system_prompt"))
    kept = hash_sample(sft.filled_rows(rows), SEED, ["doc_id"], 10_000)
    shown = sft.format_messages(sft.format_completion(kept, "gemma-3"))
    return shown.select("doc_id", "prompt", "completion", F.size("messages").cast("bigint").alias("n_messages"),
                        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("chat"))


TOTAL, PER_QUERY, EXCLUDE = 10, 2, 20


def _author_people(spark, folder) -> DataFrame:
    return views.profiles(spark, folder).select(c("ord").alias("profile_id"), "user", "user_profile")


def _author_prompt(rows: DataFrame, people: DataFrame, *keys: str) -> DataFrame:
    listed = text.numbered(c("tweets"), "Tweet ", ": ")
    return rows.join(people.withColumnRenamed("user", "user_name"), "profile_id").select(
        *keys, F.size("tweets").cast("bigint").alias("n_tweets"), text.fill_template(
            templates.AUTHOR, ("TEMPLATE_USER_NAME", c("user_name")), ("TEMPLATE_USER_PROFILE", c("user_profile")),
            ("TEMPLATE_TWEETS", listed)).alias("prompt"))


def _own_posts(store, mine: DataFrame) -> DataFrame:
    return store.fetch(mine, columns=("tweet",)).withColumns({"other": c("user"), "number": c("rank") - 1})


def author_self_positives(spark, folder) -> DataFrame:
    store, people = write_store(views.posts_wide(spark, folder)), _author_people(spark, folder)
    mine = _own_posts(store, pairing.self_positives(people, store, EXCLUDE, TOTAL // 2, SEED))
    return _author_prompt(pairing.query_batches(mine, ["profile_id"], "number", PER_QUERY), people, "profile_id", "batch")


def author_user_negatives(spark, folder) -> DataFrame:
    store, people = write_store(views.posts_wide(spark, folder)), _author_people(spark, folder)
    mine = pairing.self_positives(people, store, EXCLUDE, TOTAL // 2, SEED)
    pairs = pairing.other_users(pairing.positive_counts(people, mine), store.users, TOTAL, PER_QUERY, SEED)
    picked = store.fetch(pairing.posts_of_others(pairs, PER_QUERY, SEED), "other")
    keys = ["profile_id", "other"]
    negatives = pairing.query_batches(picked, keys, "post_no", PER_QUERY).withColumn("truth", F.lit(False))
    positives = pairing.query_batches(_own_posts(store, mine), keys, "number", PER_QUERY).withColumn("truth", F.lit(True))
    return _author_prompt(positives.unionByName(negatives), people, "profile_id", "other", "batch", "truth")


def _post_negatives(spark, folder, *columns: str):
    store, people = write_store(views.posts_wide(spark, folder)), _author_people(spark, folder)
    mine = pairing.self_positives(people, store, EXCLUDE, TOTAL // 2, SEED)
    others = pairing.other_posts(pairing.positive_counts(people, mine), store.users, TOTAL, SEED)
    return people, mine, store.fetch(others, "other", columns)


def author_post_negatives(spark, folder) -> DataFrame:
    people, _, others = _post_negatives(spark, folder, "post_id", "tweet")
    return _author_prompt(others.withColumn("tweets", F.array("tweet")), people, "profile_id", "post_id", "other")


def author_useful_only(spark, folder) -> DataFrame:
    labelled = views.labelled_posts(spark, folder)
    useful = checkpoint(parsing.useful_posts(labelled).select("post_id", "user", "ord", "tweet", c("description").alias("user_information")))
    store, useful_store = write_store(views.posts_wide(spark, folder)), write_store(useful)
    known = store.users.select("user")  # every user has labelled posts here
    people = _author_people(spark, folder).join(known, "user", "left_semi")
    eligible = useful.select("post_id", "user_information")
    mine = pairing.self_positives(people, store, EXCLUDE, int(TOTAL * 0.5), SEED, eligible=eligible)
    # users are all labelled ones, also those without a useful post
    everyone = hash_positions(known, "users", ["user"], "user_position").join(
        useful_store.users.select("user", "n_posts"), "user", "left").na.fill(0, ["n_posts"])
    pairs = pairing.other_users(pairing.positive_counts(people, mine), everyone, TOTAL, PER_QUERY, SEED)
    others = pairing.posts_of_others(pairs, F.lit(TOTAL) - c("n_positive"), SEED)
    shown = ["profile_id", "other", "post_id", "tweet", "user_information"]
    negatives = useful_store.fetch(others, "other", ("post_id", "tweet", "user_information")).select(*shown)
    rows = _own_posts(store, mine).select(*shown).unionByName(negatives)
    return rows.join(people.select("profile_id", "user"), "profile_id").select(*shown, (c("user") == c("other")).alias("truth"))


def author_accuracy(spark, folder) -> DataFrame:
    _, mine, others = _post_negatives(spark, folder, "post_id")
    asked = mine.select("profile_id", "post_id", F.lit(True).alias("truth")).unionByName(
        others.select("profile_id", "post_id", F.lit(False).alias("truth")))
    lot = (c("profile_id") * 31 + c("post_id") * 17) % 10
    reply = F.when(lot == 0, "no idea").otherwise(
        F.concat(F.lit('```json\n{"IsFromUser": '), F.when(lot < 6, "true").otherwise("false"), F.lit("}\n```")))
    rows = parsing.parse_replies(asked.withColumn("response", reply), ["IsFromUser"])
    rows = rows.withColumn("said", parsing.flag(c("parsed"), "IsFromUser"))
    return metrics.accuracy_by(rows, c("said"), c("truth"), ["truth"]).withColumn("accuracy", F.round("accuracy", 6))


def profile_qa_accuracy(spark, folder) -> DataFrame:
    people = views.table(spark, folder, "customer")
    asked = hash_sample(people, SEED, ["c_custkey"], 1000).select(
        "c_mktsegment", "c_custkey", F.concat(F.lit("Does "), "c_name", F.lit(" follow sports?")).alias("question"),
        F.when(c("c_acctbal") > 5000, "Yes").otherwise("No").alias("answer"))
    lot = c("c_custkey") % 6
    reply = views.wrapped(F.concat(F.lit('{"Answer": "'), F.when(c("c_custkey") % 4 == 0, "No").otherwise("Yes"), F.lit('"}')), lot)
    rows = parsing.parse_replies(asked.withColumn("response", reply), ["Answer"])
    return metrics.accuracy_by(rows, c("parsed.Answer"), c("answer"), ["c_mktsegment"]).withColumn("accuracy", F.round("accuracy", 6))


def perspective_first_n(spark, folder) -> DataFrame:
    people = position_in_group(views.profiles(spark, folder).select("ord", "user_id", "user_profile"), [], "ord").drop("ord")
    asked = views.questions(spark, folder).drop("position")
    return pairing.pair_with_first(asked, people, 10).select(
        "user_id", "ord", c("user_intent").alias("intent"), text.fill_template(
            templates.PERSPECTIVE, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question"))).alias("prompt"))


def perspective_related(spark, folder) -> DataFrame:
    noted = parsing.parse_replies(views.annotation(spark, folder), ["MatchUserProfile"])
    matching = noted.where(c("parsed.MatchUserProfile") == "YES")
    related = pairing.related_profiles(views.questions(spark, folder), matching, 20, 20, SEED)
    return related.select(
        "ord", "user_profile", "n_related", text.fill_template(
            templates.PERSPECTIVE, ("TEMPLATE_USER_PROFILE", c("user_profile")), ("TEMPLATE_QUESTION", c("question"))).alias("prompt"))


def perspective_repeat(spark, folder) -> DataFrame:
    asked = views.questions(spark, folder)
    total = asked.agg(F.count(F.lit(1))).scalar()
    return asked.withColumn("sample_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).select(
        "ord", "sample_idx", (F.lit(SEED) + c("sample_idx") * total + c("position")).alias("seed"),
        F.coalesce(F.lit(None).cast("double"), F.lit(0.7)).alias("sampling_temperature"),
        text.fill_template(templates.QUESTION, ("TEMPLATE_QUESTION", c("question"))).alias("prompt"))


def _answers_by_k(spark, folder) -> DataFrame:
    return batching.answers_by_count(views.answers(spark, folder), replies.counts_list("1-5-10"), 20, 5)


def answers_by_k(spark, folder) -> DataFrame:
    return _answers_by_k(spark, folder).select(
        "question", "intent", "reference_answer", "n_answers", "k", F.size("answers").cast("bigint").alias("n_used"),
        F.array_join("answers", "\n").alias("answers"))


def answers_pass_through(spark, folder) -> DataFrame:
    rows = _answers_by_k(spark, folder)
    single = (c("k") == 1) & (F.size("answers") > 0)
    prompt = text.fill_template(templates.SUMMARY, ("TEMPLATE_QUESTION", c("question")), ("TEMPLATE_ANSWERS", F.array_join("answers", "\n")))
    rows = rows.withColumn("prompt", F.when(single, PASS_THROUGH_PROMPT).otherwise(prompt))

    def stub(pending: DataFrame) -> DataFrame:
        return pending.withColumns({"response": F.concat(F.lit("merged "), F.length("prompt").cast("string")), "status": F.lit("ok")})

    done = inference.split_pass_through(rows, single, F.try_element_at("answers", F.lit(1)), stub)
    return done.select("question", "k", "prompt", "response", "status")


def rubric_prompts(spark, folder) -> DataFrame:
    rows = views.answers(spark, folder).where(c("response").isNotNull() & c("intent").isin("Leisure", "Seek_Creativity"))
    rows = rows.withColumn("response", replies.after_analysis(c("response")))
    return grading.with_rubric(rows, grading.rubrics(spark)).select(
        "ord", "intent", grading.grading_prompt(templates.GRADE_BY_REFERENCE, with_profile=False).alias("prompt"))


def scoring_text(spark, folder) -> DataFrame:
    rows = views.answers(spark, folder).where(c("response").isNotNull())
    return parsing.with_scoring_text(rows).select("ord", "scoring_text")


def judge_scores(spark, folder) -> DataFrame:
    key = c("ord")
    judged = views.answers(spark, folder).withColumn("k", F.element_at(F.array(F.lit(1), F.lit(5), F.lit(10)), (key % 3 + 1).cast("int")).cast("bigint"))
    reply = F.concat(F.lit("Reasons {first}. {’Clarity’: "), (key % 10 + 1).cast("string"), F.lit(", 'User Satisfaction': "), (key % 7 + 1).cast("string"),
                     F.lit(", ‘"), F.when(key % 2 == 0, "综合得分").otherwise("Overall"), F.lit("’: "), (key % 12).cast("string"), F.lit("}"))
    scored = judged.withColumn("scores", replies.judge_scores(reply)).withColumn("overall", replies.overall_score(c("scores")))
    return metrics.judge_means(scored, "overall", ["k"], "intent").withColumn("mean_score", F.round("mean_score", 6))


ROUNDED = ["accuracy", "valid_response_rate", "precision", "recall", "f1_score"]


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _said(spark, folder) -> DataFrame:
    return tables.yes_no_columns(views.yesno_eval(spark, folder)).withColumns(
        {"said": replies.yes_no(c("response")), "target": replies.yes_no_target(c("answer"))})


def yesno_metrics(spark, folder) -> DataFrame:
    return rounded(metrics.yes_no_metrics(_said(spark, folder), "said", "target"), ROUNDED)


def item_matches(spark, folder) -> DataFrame:
    """Replies that are an item, hold one, or are part of one."""
    rows = views.ranking_eval(spark, folder)
    item = F.element_at("candidates", 4)
    reply = F.when(c("o_orderkey") % 4 == 0, F.upper(item)).when(c("o_orderkey") % 4 == 1, F.concat(F.lit("<think>x</think> I take "), item, F.lit("!"))).when(
        c("o_orderkey") % 4 == 2, F.substring(item, 2, 5)).otherwise("nothing of it")
    return rows.select("o_orderkey", replies.match_item(reply, c("candidates")).alias("item"))


def attached_replies(spark, folder) -> DataFrame:
    """Replies kept apart from their prompts, joined back."""
    prompts = views.posts(spark, folder).select(c("post_id").alias("prompt_id"), "user", F.length("tweet").cast("bigint").alias("n_chars"))
    kept = batch_inference_stub(spark, folder)
    return inference.attach(prompts, kept)


def results_written(spark, folder) -> DataFrame:
    """A result table written as parquet and quoted CSV, read back from the CSV."""
    rows = _said(spark, folder).select(c("doc_id").cast("string").alias("doc_id"), "question", F.coalesce("said", F.lit("none")).alias("said"))
    path = shared_folder(spark)
    sinks.write_results(rows, path, csv=True)
    found = tables.read_csv(spark, f"{path}_csv", required=["doc_id", "question", "said"])
    return found.select(c("doc_id").cast("bigint").alias("doc_id"), F.md5("question").alias("digest"), "said")


def splits_written(spark, folder) -> DataFrame:
    """Cleaned replies and both splits written, the splits read back."""
    cleaned = checkpoint(sft.clean_interest(views.interest_replies(spark, folder)))
    keys, path = ["user_id", "answer"], shared_folder(spark)
    sinks.write_splits(cleaned, sampling.split_exact(checkpoint(_pairs_of(cleaned).select(*keys)), SEED, keys, 0.9), path)
    return spark.read.parquet(f"{path}/sft").select(*keys, "split")


def first_profiles(spark, folder) -> DataFrame:
    """Profiles of the old column names, the first thirty."""
    old = views.profiles(spark, folder).select("ord", c("user_id").alias("UserName"), c("user_profile").alias("UserProfile"))
    return sampling.first_rows(schemas.normalise_profiles(old), "ord", 30)


def _evaluated(spark, folder) -> evaluation.Evaluation:
    return evaluation.yes_no(tables.yes_no_columns(views.yesno_eval(spark, folder)).drop("question"), ["source"])


def evaluation_records(spark, folder) -> DataFrame:
    return _evaluated(spark, folder).records.select("doc_id", "source", "prediction", "target", "is_right")


def evaluation_totals(spark, folder) -> DataFrame:
    return rounded(_evaluated(spark, folder).metrics, ROUNDED)


def hit_rates(spark, folder) -> DataFrame:
    rows = tables.ranking_columns(views.ranking_eval(spark, folder)).withColumn("task", F.when(c("o_orderkey") % 2 == 0, "direct").otherwise("sequential"))
    lot = c("o_orderkey") % 5
    listed = F.concat(F.lit("['"), F.array_join(F.slice("candidates", 1, 10), "', '"), F.lit("']"))
    reply = F.when(lot == 0, "nothing fits").when(lot == 1, F.concat(F.lit("> thinking [x] assistantfinal "), listed)).otherwise(listed)
    rows = compute_once(rows.withColumn("response", reply), "items", replies.list_reply(c("response")))
    rows = rows.withColumn("first_match", replies.match_item(F.upper(F.element_at("candidates", 3)), c("candidates")))
    matched = F.count_if(c("first_match") == c("candidates")[2])
    out = metrics.list_metrics(rows, "items", "target", "response", ["task"], n_matched=matched)
    return rounded(out, ["avg_response_length", "hit_rate_at_top_5", "hit_rate_at_top_10", "valid_response_rate"])


def last_candidate_model():
    """Recommends the last candidate of every prompt."""
    return lambda prompts: [p.rsplit(", ", 1)[-1].rsplit("\n", 1)[-1].upper() for p in prompts]


def iterative_hits(spark, folder) -> DataFrame:
    rows = views.ranking_eval(spark, folder)
    played = inference.recommend_in_rounds(rows, last_candidate_model, rounds=10, spread_by=["o_orderkey"])
    out = metrics.iterative_metrics(played, "recommendations", "target", ["interaction_history"])
    return rounded(out, ["hit_rate_at_top_5", "hit_rate_at_top_10", "avg_recommendations_per_sample"])


def rating_error(spark, folder) -> DataFrame:
    lot = c("l_linenumber") % 4
    stars, share = (c("l_quantity") % 5 + 1).cast("int").cast("string"), (c("l_discount") * 1000).cast("int").cast("string")
    pair = F.concat(F.lit("("), stars, F.lit(" stars, "), share, F.lit("%)"))
    reply = F.when(lot == 0, "unsure").when(lot == 1, F.concat(F.lit("(a) assistantfinal "), pair)).otherwise(F.concat(F.lit("I say "), pair))
    rows = views.table(spark, folder, "lineitem").withColumns({"response": reply, "target": (c("l_partkey") % 5 + 1).cast("double")})
    out = metrics.rating_metrics(evaluation.with_rating(rows), "stars", "confidence", "target", ["l_returnflag"])
    return rounded(out, ["average_prediction_error", "weighted_average_prediction_error"])


def variant_f1(spark, folder) -> DataFrame:
    rows = _said(spark, folder).withColumns({"model": F.when(c("doc_id") % 2 == 0, "a").otherwise("b"),
                                             "variant": (c("doc_id") % 3).cast("string"), "dataset": F.when(c("doc_id") % 5 < 3, "books").otherwise("news")})
    scores = metrics.yes_no_metrics(rows, "said", "target", ["model", "variant", "dataset"]).select(
        "model", "variant", "dataset", F.round("f1_score", 6).alias("f1_score"))
    return metrics.flag_best(scores, "f1_score", ["model", "dataset"])


def metrics_history(spark, folder) -> DataFrame:
    """Metrics of four steps written by step, the third of them twice, and read back."""
    rows = _said(spark, folder).withColumn("step", c("doc_id") % 4 * 100)
    found = checkpoint(rounded(metrics.yes_no_metrics(rows, "said", "target", ["step"]), ROUNDED))
    path = shared_folder(spark)
    spoilt = found.where("step = 200").withColumn("accuracy", F.lit(-1.0))
    for records in (found.where("step <> 200").unionByName(spoilt), found.where("step = 200")):
        sinks.put_metrics(records, path, "yes-no")
    fields = ", ".join(f"{name} {kind}" for name, kind in found.dtypes)
    return sinks.metrics_history(spark, path, "yes-no", f"{fields}, tag string").drop("tag")


def semantic_profiles(spark, folder) -> DataFrame:
    asked, known = views.vectors(spark, folder)
    found = vector_index.search(asked, vector_index.build_index(known, SEED), 5)
    return rounded(found, ["similarity"]).withColumn("rank", c("rank").cast("bigint"))


def semantic_recall(spark, folder) -> DataFrame:
    """Whether the probes chosen on a sample of questions reach their recall for all questions, against all pairs."""
    asked, known = views.vectors(spark, folder)
    index = vector_index.build_index(known, SEED)
    probes, _ = vector_index.probes_for(asked, index, 5, 0.97)
    found = vector_index.search_probes(asked, index, 5, probes)
    true = retrieval.nearest_profiles(asked, known, 5)
    hits = true.join(found.select("question_id", "profile_id", F.lit(1).alias("hit")), ["question_id", "profile_id"], "left")
    return hits.agg(
        F.count_distinct("question_id").alias("n_questions"), F.count(F.lit(1)).alias("n_pairs"),
        (F.count("hit") >= F.count(F.lit(1)) * 0.95).alias("recall_reached"))


QUERIES = {f.__name__: f for f in (
    posts_normalised, posts_copied, item_display, user_post_counts, profile_prompts, user_shard, question_filter_sample,
    reply_parse_stage, reply_fields, prompt_length_guard, chat_messages, batch_inference_stub, resume_pending,
    post_batches, user_descriptions, profile_scrub, constant_prompts, profile_item_pairs, profile_question_pairs,
    question_profile_pairs, synthetic_histories, finetuned_prompts,
    finetuned_sample, sft_cut, default_topic_prompts, repeated_candidates, profiles_from_csv,
    questions_from_json, interest_clean, sft_pairs, sft_split, sft_format,
    author_self_positives, author_user_negatives, author_post_negatives, author_useful_only, author_accuracy,
    profile_qa_accuracy, perspective_first_n, perspective_related, perspective_repeat, answers_by_k,
    answers_pass_through, rubric_prompts, scoring_text, judge_scores, yesno_metrics, item_matches, attached_replies, results_written,
    splits_written, first_profiles, evaluation_records, evaluation_totals, hit_rates, iterative_hits,
    rating_error, variant_f1, metrics_history, semantic_profiles, semantic_recall,
)}
