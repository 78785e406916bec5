"""Every job end to end with a stub model on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from voicegrain.operators import grading, inference
from voicegrain.plans import evaluation, jobs
from voicegrain.plans.counts import counting
from voicegrain.registry import views
from voicegrain.sources import sinks, tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def says(reply):
    """A model that always gives the same reply."""
    return lambda rows: rows.withColumns({"response": F.lit(reply), "status": F.lit("ok")})


def one_reply_per_prompt(df):
    rows = df.select("prompt_id", "prompt", "response").collect()
    assert rows and len({r.prompt_id for r in rows}) == len(rows)
    assert all(r.prompt and "TEMPLATE_" not in r.prompt and r.response is not None for r in rows)
    return len(rows)


@pytest.fixture(scope="module")
def data(spark):
    people = views.profiles(spark, FOLDER)
    return {
        "posts": views.posts_wide(spark, FOLDER), "labelled": views.labelled_posts(spark, FOLDER), "profiles": people,
        "questions": views.questions(spark, FOLDER), "answers": views.answers(spark, FOLDER).where("response is not null"),
        "authors": people.withColumn("user_id", F.col("user")), "rubrics": grading.rubrics(spark),
        "items": tables.item_pool(views.items(spark, FOLDER), "netflix"),
    }


def test_profile_jobs(spark, data):
    said = jobs.extract_from_posts(data["posts"], says("{}"), users=5, minimum=10, most=7)
    assert one_reply_per_prompt(said) == 35
    reply = '{"UsefulInformation": true, "Justification": "j", "UserInformation": "i"}'
    batches = jobs.extract_from_batches(data["posts"], says(reply), users=4, minimum=10, most=10)
    assert one_reply_per_prompt(batches) == 8
    assert {r.Justification for r in batches.collect()} == {"j"}
    assert {r.Justification for r in jobs.extract_from_batches(data["posts"], says("no"), users=4).collect()} == {"N/A"}
    merged = jobs.merge_descriptions(data["labelled"], says("{'user_id': 'x', 'user_profile': 'p'}"))
    assert one_reply_per_prompt(merged) == 15 and {r.parsed.user_profile for r in merged.collect()} == {"p"}
    made = jobs.fictional_profiles(spark, says("p"), 12, seed=5).collect()
    assert sorted(r.seed for r in made) == list(range(5, 17)) and len({r.prompt for r in made}) == 1


def test_interest_and_interaction_jobs(spark, data):
    pairs = jobs.profile_interest(data["profiles"], data["items"], "netflix", says("{}"), per_profile=6, start=3, most=10)
    assert one_reply_per_prompt(pairs) == 60
    assert pairs.select("user_name").distinct().count() == 10
    made = jobs.fictional_interactions(spark, data["items"], "netflix", says("YES"), n=30, low=2, high=5)
    assert 0 < one_reply_per_prompt(made) <= 30


def test_sft_jobs(spark, data, tmp_path):
    cleaned, rows = jobs.interest_to_sft(views.interest_replies(spark, FOLDER), ["row_key"], "netflix", "base")
    counts = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    assert counts["train"] == round(0.9 * sum(counts.values())) and sum(counts.values()) % 2 == 0
    assert {r.answer for r in rows.select("answer").distinct().collect()} == {"YES", "NO"}
    sinks.write_splits(cleaned, rows, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/sft").count() == sum(counts.values())
    assert spark.read.parquet(f"{tmp_path}/sft/split=train").count() == counts["train"]
    ready = jobs.sft_table(rows, ["user_id", "answer"], most=50)
    assert ready.count() == 50 and all(r.prompt.endswith(" ") for r in ready.collect())
    with pytest.raises(ValueError, match="history bounds"):
        jobs.interest_to_sft(views.interest_replies(spark, FOLDER), ["row_key"], "unknown", "base")


def test_answer_jobs(spark, data):
    assert one_reply_per_prompt(jobs.personal_answers(data["profiles"], data["questions"], says("a"), per_profile=3, most=8)) == 24
    plain = jobs.question_answers(data["questions"], says("a"), "Leisure", "EN", 6)
    assert one_reply_per_prompt(plain) == 6
    paired = jobs.question_answers(data["questions"], says("a"), "Leisure", "EN", 6, data["profiles"], 4)
    assert one_reply_per_prompt(paired) == 24
    tuned = data["questions"].withColumn("system_prompt", F.lit("s"))
    assert one_reply_per_prompt(jobs.finetuned_answers(tuned, says("a"), most=5)) == 5


def test_judging_jobs(spark, data):
    grade = "fine {'Clarity': 7, 'Overall': 6}"
    all_rows = jobs.judge_one_intent(data["answers"], says(grade), data["rubrics"], "Leisure")
    assert one_reply_per_prompt(all_rows) == data["answers"].count()
    assert {r.overall for r in all_rows.collect()} == {6}
    with pytest.raises(Exception, match="no rubric"):
        jobs.judge_one_intent(data["answers"], says(grade), data["rubrics"], "Other").collect()
    tuned = data["answers"].withColumn("user_profile", F.lit("p"))
    scored = jobs.judge_finetuned(tuned, says(grade), data["rubrics"], "Leisure", most=9)
    assert one_reply_per_prompt(scored) == 9 and {r.intent for r in scored.collect()} == {"Leisure"}


@pytest.mark.parametrize("by_post", [False, True])
def test_author_jobs(spark, data, by_post):
    reply = '{"Justification": "x", "IsFromUser": true}'
    rows = jobs.predict_author(data["authors"], data["posts"], says(reply), total=6, per_query=2, exclude=20, people=15, by_post=by_post)
    one_reply_per_prompt(rows)
    got = rows.collect()
    assert {r.said for r in got} == {True} and {r.truth for r in got} == {True, False}
    assert all((r.other == r.user) == r.truth for r in got)
    assert {len(r.tweets) for r in got if not r.truth} == ({1} if by_post else {2})


def test_useful_author_and_profile_questions(spark, data):
    rows = jobs.predict_author_from_useful(data["authors"], data["labelled"], says('{"IsFromUser": false}'), total=6, per_query=2, exclude=20)
    got = rows.collect()
    assert got and all((r.other == r.user) == r.truth for r in got) and {r.said for r in got} == {False}
    asked = data["profiles"].select("ord", F.col("user_id").alias("user_name"), "user_profile", F.lit("q").alias("question"), F.lit("Yes").alias("answer"))
    assert {r.said for r in jobs.profile_questions(asked, says('{"Answer": "Yes"}'), 11).collect()} == {"Yes"}


def test_perspective_jobs(spark, data):
    n = data["questions"].count()
    assert one_reply_per_prompt(jobs.perspectives_of_first(data["profiles"], data["questions"], says("a"), 4)) == 4 * n
    repeated = jobs.repeated_answers(data["questions"], says("a"), 3)
    assert one_reply_per_prompt(repeated) == 3 * n and repeated.select("seed").distinct().count() == 3 * n
    related = jobs.perspectives_of_related(views.annotation(spark, FOLDER), data["questions"], says("a"), 10, 10)
    assert one_reply_per_prompt(related) % 10 == 0
    merged = jobs.aggregate_answers(data["answers"], says('{"summary": "merged"}'), "1-3")
    assert {r.status for r in merged.where("k = 1").collect()} == {"direct"}
    final = jobs.judge_aggregated(merged, says("{'Overall': 9}"), data["rubrics"])
    assert {r.overall for r in final.collect()} == {9} and final.where("k = 3").first().answer == "merged"


def test_metric_jobs(spark, data):
    assert jobs.score_yes_no(views.yesno_eval(spark, FOLDER)).first().num_samples == 87
    ranked = views.ranking_eval(spark, FOLDER)
    listed = ranked.withColumn("response", F.to_json("candidates"))
    assert jobs.score_lists(listed).first().valid_response_rate == 1.0
    rated = spark.createDataFrame([("(4 stars, 50%)", 5.0)], "response string, target double")
    assert jobs.score_ratings(rated).first().average_prediction_error == 1.0
    literal = ranked.withColumn("candidates", F.to_json("candidates"))
    got = jobs.recommend_and_score(literal, lambda: lambda prompts: [p.rsplit(", ", 1)[-1] for p in prompts], 3).first()
    assert got.avg_recommendations_per_sample == 3.0


def test_prompts_over_the_budget_are_not_sent(spark, data):
    rows = data["posts"].select(F.col("post_id").alias("prompt_id"), F.repeat(F.lit("word "), (F.col("post_id") % 400).cast("int")).alias("prompt"))
    done = inference.infer_guarded(rows, lambda p: p.withColumns({
        "response": F.lit("r"), "status": F.lit("ok"), "error": F.lit(None).cast("string"), "attempts": F.lit(1).cast("bigint")}), 128, 256)
    assert done.count() == rows.count()
    assert done.where("status = 'skipped'").count() == rows.where("ceil(length(prompt) / 4) > 128").count() > 0


def test_many_tags_end_in_one_profile(spark):
    said = [(f"u{u}", i, f'{{"UsefulInformation": true, "UserInformation": "tag {u} {i}"}}') for u in range(2) for i in range(5000 if u else 3)]
    labelled = spark.createDataFrame(said, "user string, ord int, response string")

    def run(rows):
        answer = F.concat(F.lit('{"user_id": "x", "user_profile": "'), F.md5("descriptions"), F.lit('"}'))
        return rows.withColumns({"response": answer, "status": F.lit("ok")})

    rows = jobs.merge_descriptions(labelled, run, most_tags=50).collect()
    assert sorted((r.user, r.round) for r in rows) == [("u0", 0), ("u1", 2)]


def test_files_to_results(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("".join('{"author":"u%d","text":"t%d"}\n' % (i % 3, i) for i in range(60)))
    posts = tables.read_posts_json(spark, str(tmp_path))
    (tmp_path / "q.csv").write_text("question,reference_ans,user_intent,language\n" + "".join(f"q{i},r,Leisure,EN\n" for i in range(5)))
    (tmp_path / "u.csv").write_text("user_id,user_profile\n" + "".join(f"u{i},p\n" for i in range(3)))
    people, asked = tables.read_profiles(spark, str(tmp_path / "u.csv")), tables.read_questions(spark, str(tmp_path / "q.csv"))
    assert one_reply_per_prompt(jobs.personal_answers(people, asked, says("a"), per_profile=2, most=3)) > 0
    rows = jobs.predict_author(people, posts, says('{"IsFromUser": true}'), total=4, per_query=2, exclude=2, people=3)
    assert rows.count() > 0
    assert jobs.repeated_answers(asked, says("a"), 0).count() == 0


def test_stages_are_counted_without_a_job(spark, data):
    with counting() as counts:
        said = jobs.question_answers(data["questions"], says("a"), "Leisure", "EN", most=6, profiles=data["profiles"], people=3)
    plain = jobs.question_answers(data["questions"], says("a"), "Leisure", "EN", most=6, profiles=data["profiles"], people=3)
    assert said.count() == plain.count() == 18
    spark.sparkContext.setJobGroup("counts", "")
    found = {stage: n["rows"] for stage, n in counts.read().items()}
    counts.check()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counts")) == 0
    leisure = data["questions"].where("user_intent = 'Leisure' and language = 'EN'").count()
    assert found == {"questions": data["questions"].count(), "questions of the intent": leisure, "sampled questions": 6, "prompts": 18, "replies": 18}
    with counting() as counts:
        none = jobs.question_answers(data["questions"], says("a"), "no such intent", "EN", most=6)
    none.collect()
    with pytest.raises(ValueError, match="too few rows"):
        counts.check()


def test_evaluations_keep_records_and_totals(spark):
    rows = spark.createDataFrame(
        [(1, "a", "yes", "YES sir"), (2, "a", "no", "YES"), (3, "b", "no", "NO"), (4, "b", "yes", "maybe"), (5, None, "yes", "no")],
        "id int, source string, answer string, response string")
    found = evaluation.yes_no(rows, ["source"])
    records = {r.id: (r.prediction, r.target, r.is_right, r.response) for r in found.records.collect()}
    assert records[1] == ("YES", "YES", True, "YES sir") and records[2][:3] == ("YES", "NO", False) and records[4][:3] == (None, "YES", None)
    got = {(r.source, r.is_total): (r.num_samples, r.true_positives, r.accuracy) for r in found.metrics.collect()}
    assert got == {("a", False): (2, 1, 0.5), ("b", False): (2, 0, 1.0), (None, False): (1, 0, 0.0), (None, True): (5, 1, 0.5)}
    assert evaluation.yes_no(rows).metrics.first().is_total
    listed = evaluation.lists(spark.createDataFrame([("x", "['y', 'x']"), ("x", "none")], "target string, response string"))
    assert sorted((r.place or 0, r.response) for r in listed.records.collect()) == [(0, "none"), (2, "['y', 'x']")]
    assert listed.metrics.first().hit_rate_at_top_5 == 1.0
    rated = evaluation.ratings(spark.createDataFrame([(4.0, "(3 stars, 50%)", "u"), (4.0, "?", "v")], "target double, response string, user string"), ["user"])
    assert {(r.user, r.error) for r in rated.records.collect()} == {("u", 1.0), ("v", None)}
    assert {(r.user, r.is_total): r.num_valid for r in rated.metrics.collect()} == {("u", False): 1, ("v", False): 0, (None, True): 1}
    ranking = spark.createDataFrame([("B", "['A', 'B']", "h"), ("Z", "['A', 'B']", "h")], "target string, candidates string, interaction_history string")
    played = evaluation.rounds(ranking, lambda: lambda prompts: ["B" for _ in prompts], n=2, by=["interaction_history"])
    assert all(r.recommendations == ["B"] and len(r.prompts) == len(r.responses) == 2 for r in played.records.collect())
    assert {(r.is_total, r.num_samples, r.hit_rate_at_top_5) for r in played.metrics.collect()} == {(False, 2, 0.5), (True, 2, 0.5)}
