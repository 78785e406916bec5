"""Ranking, drawing, skew, pairing and inference operators against plain computations."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import Window, functions as F

from voicegrain.operators import batching, inference, metrics, pairing, post_store, ranking, retrieval, sampling
from voicegrain.operators.post_store import write_store
from voicegrain.operators.drawing import draw, draw_others
from voicegrain.operators.ranking import hash_positions, hash_slice, key_hash, position_in_group, top_k
from voicegrain.operators.skew import BROADCAST_ROWS, lookup_join, skew_join


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group."""
    return spark.range(6000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17)).repartition(12)


def hashed_order(ids, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def test_hash_positions_and_slices_equal_a_global_sort(spark, skewed):
    order = hashed_order(range(6000), 1)
    got = {r.id: r.position for r in hash_positions(skewed, 1, ["id"]).collect()}
    assert got == {k: i for i, k in enumerate(order)}
    assert {r.id for r in hash_slice(skewed, 1, ["id"], 100, 4321).collect()} == set(order[100:4321])
    assert hash_slice(skewed, 1, ["id"], 0, 99999).count() == 6000


@pytest.mark.parametrize("one_pass", [10, 100_000])
def test_samples_of_one_pass_and_of_buckets_are_the_same(skewed, monkeypatch, one_pass):
    monkeypatch.setattr(ranking, "ONE_PASS", one_pass)
    order = hashed_order(range(6000), 1)
    assert {r.id: r.p for r in ranking.hash_sample(skewed, 1, ["id"], 300, "p").collect()} == {k: i for i, k in enumerate(order[:300])}
    assert {r.id for r in hash_slice(skewed, 1, ["id"], 40, 65).collect()} == set(order[40:65])
    assert ranking.hash_sample(skewed, 1, ["id"], 9000).count() == 6000
    assert ranking.hash_sample(skewed.where("id < 0"), 1, ["id"], 5).count() == 0


def test_a_sample_reads_its_input_once(spark, tmp_path, monkeypatch):
    spark.range(20_000).repartition(6).write.parquet(f"{tmp_path}/ids")
    ids = spark.read.parquet(f"{tmp_path}/ids")
    assert scanned(ranking.hash_sample(ids, 1, ["id"], 50)) == 20_000
    monkeypatch.setattr(ranking, "ONE_PASS", 10)
    assert scanned(ranking.hash_sample(ids, 1, ["id"], 50)) > 20_000


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_draws_do_not_depend_on_partitions(spark, skewed, partitions):
    got = {r.id for r in hash_slice(skewed.repartition(partitions), 7, ["id"], 0, 25).collect()}
    assert got == set(hashed_order(range(6000), 7)[:25])


def test_position_in_group_is_exact_across_runs(spark, skewed):
    plain = skewed.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1)
    want = {r.id: r.p for r in plain.collect()}
    assert {r.id: r.position for r in position_in_group(skewed, ["g"], "id", width=64).collect()} == want


@pytest.mark.parametrize("slices", [1, 8])
def test_top_k(spark, skewed, slices):
    want = {r.id for r in skewed.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy("id"))).where("p <= 5").collect()}
    assert {r.id for r in top_k(skewed, ["g"], ["id"], 5, slices=slices).collect()} == want


def test_split_is_exact_disjoint_and_whole(spark, skewed):
    rows = sampling.split_exact(skewed, 3, ["id"], 0.9).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"train": 5400, "test": 600}
    odd = sampling.split_exact(spark.range(5), 3, ["id"], 0.5).where("split = 'train'").count()
    assert odd == round(2.5)
    torn = sampling.split_exact(skewed, 3, ["id"], 0.5, by=["g"]).groupBy("g").agg(F.countDistinct("split").alias("n"))
    assert torn.where("n > 1").count() == 0


def test_skew_join_equals_a_plain_join(spark, skewed):
    side = skewed.select("g").distinct().where("g < 9").withColumn("x", F.col("g") * 2)
    for how in ("inner", "left"):
        got = sorted((r.id, r.x) for r in skew_join(skewed, side, "g", ["id"], how, share=0.01).collect())
        assert got == sorted((r.id, r.x) for r in skewed.join(side, "g", how).collect())


def test_a_side_beyond_the_limit_is_not_broadcast(spark, skewed):
    side = skewed.select("g").distinct()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(bound):
            return lookup_join(skewed, side, "g", rows_at_most=bound)._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" in plan(20) and "BroadcastHashJoin" not in plan(BROADCAST_ROWS + 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_draws_are_different_and_never_self(spark):
    for m in (1, 2, 7):
        size = F.lit(m).cast("bigint")
        rows = spark.range(40).select("id", draw(3, size, 5, "id").alias("d"),
                                      draw_others(3, size, F.pmod("id", F.lit(m)), 99, "id").alias("o")).collect()
        for r in rows:
            assert len(set(r.d)) == min(5, m) == len(r.d) and set(r.d) <= set(range(m))
            assert sorted([*r.o, r.id % m]) == list(range(m))


def test_pair_with_first_is_the_capped_product(spark):
    many, few = spark.range(5), spark.range(8).select(F.col("id").alias("position"), (F.col("id") * 2).alias("x"))
    assert pairing.pair_with_first(many, few, 3).count() == 15
    assert pairing.pair_with_first(many, few, 100).count() == 40
    assert pairing.pair_with_first(many, few.where("x < 0"), 3).count() == 0


def test_histories_never_hold_their_candidate(spark):
    pool = hash_positions(spark.range(30).select(F.col("id").alias("item_id"), (F.col("id") % 20).cast("string").alias("item_description")), 1, ["item_id"])
    rows = pairing.synthetic_histories(spark.range(50).withColumnRenamed("id", "history_id"), pool, 2, 6, 1).collect()
    assert rows and all(r.candidate not in r.history and 2 <= len(r.history) < 6 for r in rows)
    short = pairing.synthetic_histories(spark.range(3).withColumnRenamed("id", "history_id"), pool.where("position < 3"), 9, 9, 1).collect()
    assert all(len(r.history) == 2 for r in short)


def test_related_profiles_need_strictly_more(spark):
    notes = spark.createDataFrame([("q1", "a"), ("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "b"), ("q2", "c")], "question string, user_profile string")
    questions = spark.createDataFrame([("q1", 1), ("q2", 2)], "question string, ord int")
    got = pairing.related_profiles(questions, notes, 2, None, 1).collect()
    assert {(r.question, r.user_profile) for r in got} == {("q2", p) for p in "abc"}
    assert pairing.related_profiles(questions, notes, 2, 2, 1).count() == 2


def author_tables(spark):
    rows = [(i, f"u{0 if i % 3 == 0 else i % 7}", f"post {i}", i) for i in range(200)]
    posts = spark.createDataFrame(rows, "post_id bigint, user string, tweet string, ord bigint")
    people = spark.createDataFrame([(1, "u0", "p"), (2, "u3", "p"), (3, "gone", "p")], "profile_id bigint, user string, user_profile string")
    return posts, people


def test_author_negatives_never_belong_to_the_user(spark):
    posts, people = author_tables(spark)
    store = write_store(posts, 3)
    owner = {r.post_id: r.user for r in posts.collect()}
    mine = pairing.self_positives(people, store, 10, 3, 1)
    kept = {r.post_id for r in mine.collect()}
    assert all(owner[p] in ("u0", "u3") for p in kept)
    firsts = {u: sorted(p for p, o in owner.items() if o == u)[:10] for u in ("u0", "u3")}
    assert not kept & {p for ps in firsts.values() for p in ps}
    counted = pairing.positive_counts(people, mine)
    user = {1: "u0", 2: "u3", 3: "gone"}
    wanted = {r.profile_id: 8 - r.n_positive for r in counted.collect()}
    by_post = store.fetch(pairing.other_posts(counted, store.users, 8, 1, width=5), "other").collect()
    for p, name in user.items():
        posts_of = [r.post_id for r in by_post if r.profile_id == p]
        assert len(set(posts_of)) == len(posts_of) == wanted[p] and all(owner[x] != name for x in posts_of)
    pairs = pairing.other_users(counted, store.users, 8, 2, 1)
    drawn = store.fetch(pairing.posts_of_others(pairs, 2, 1), "other").collect()
    for p, name in user.items():
        others = {r.other for r in drawn if r.profile_id == p}
        assert len(others) == min(wanted[p] // 2, 7 - (name != "gone")) and name not in others
    assert all(owner[r.post_id] == r.other and r.tweet == f"post {r.post_id}" for r in drawn)


def scanned(df):
    """Rows that the parquet scans of a plan gave, after it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    rows, todo = 0, [leaves.apply(i) for i in range(leaves.size())]
    while todo:
        leaf = todo.pop()
        if leaf.nodeName().startswith("Scan parquet"):
            rows += leaf.metrics().apply("numOutputRows").value()
        elif hasattr(leaf, "plan") and "QueryStage" in leaf.getClass().getSimpleName():
            inner = leaf.plan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
        elif leaf.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            inner = leaf.executedPlan().collectLeaves()
            todo += [inner.apply(i) for i in range(inner.size())]
    return rows


def test_many_picks_are_not_made_distinct(spark, monkeypatch):
    posts = spark.range(600).select(F.col("id").alias("post_id"), F.concat(F.lit("u"), F.col("id") % 7).alias("user"),
                                    F.col("id").cast("string").alias("tweet"), F.col("id").alias("ord"))
    store = write_store(posts, 3)
    picks = store.places.where("post_id % 3 = 0").select("user", "position")
    picks = picks.unionByName(picks)  # every pick twice
    want = sorted(2 * [i for i in range(600) if i % 3 == 0])
    assert sorted(r.post_id for r in store.fetch(picks).collect()) == want  # by few slots
    monkeypatch.setattr(post_store, "FEW", 100)

    def distinct(frame):
        raise AssertionError("wanted slots are shuffled")

    monkeypatch.setattr(type(picks), "distinct", distinct)
    assert sorted(r.post_id for r in store.fetch(picks).collect()) == want
    monkeypatch.undo()
    assert store.fetch(picks.limit(0)).count() == 0


def test_fetching_few_posts_reads_few(spark, monkeypatch):
    total = 200_000
    posts = spark.range(total).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("user"),
        F.concat(F.lit("post "), F.sha2(F.col("id").cast("string"), 512), F.sha2((F.col("id") + 1).cast("string"), 512)).alias("tweet"), F.col("id").alias("ord"))
    monkeypatch.setattr(post_store, "ROW_GROUP", 1 << 16)
    store = write_store(posts, 8)
    wanted = [("hot", 7), ("hot", 60_000), ("u1", 3), ("u2", 10_000), ("nobody", 0)]
    picks = spark.createDataFrame(wanted, "user string, position bigint")
    assert "PartitionFilters" in store.fetch(picks)._jdf.queryExecution().toString()
    got = {(r.user, r.position): r.post_id for r in store.fetch(picks).collect()}
    places = {("hot", 7): 21, ("hot", 60_000): 180_000}
    assert {k: v for k, v in got.items() if k[0] == "hot"} == places and set(got) == {("hot", 7), ("hot", 60_000), ("u1", 3)}
    assert scanned(store.fetch(picks)) < total / 10
    many = store.places.where("post_id % 50 = 0").select("user", "position")
    monkeypatch.setattr(post_store, "FEW", 10)
    found = store.fetch(many)
    assert sorted(r.post_id for r in found.collect()) == list(range(0, total, 50))
    assert store.of_users(spark.createDataFrame([("u7",), ("u8",), ("u8",)], "user string")).groupBy("user").count().count() == 2


def test_batches_and_pages(spark):
    posts = spark.createDataFrame([(f"u{i % 2}", f"t{i}", i) for i in range(25)], "user string, tweet string, ord bigint")
    users = sampling.users_with_batch(sampling.posts_per_user(posts), 5, 5)
    got = batching.post_batches(batching.first_posts(posts, users, batching.batch_cover(5, 8), 2), 5, 8).collect()
    assert {(r.user, r.batch): len(r.tweets) for r in got} == {(u, b): 5 for u in ("u0", "u1") for b in (0, 1)}
    assert next(r for r in got if r.user == "u1" and r.batch == 0).tweets == ["t1", "t3", "t5", "t7", "t9"]
    said = spark.createDataFrame([("u", "; ".join(f"Tag {i}" for i in range(50)) + "; N/A; tag 1"), ("v", "x")], "user string, description string")
    tags = batching.distinct_tags(said)
    assert {r.user: r.n_tags for r in batching.tag_pages(tags).collect()} == {"u": 50, "v": 1}
    pages = [r for r in batching.tag_pages(tags, most=10).collect() if r.user == "u"]
    assert len(pages) > 1 and sum(r.n_tags for r in pages) == 50


@pytest.mark.parametrize("bound", [None, 3, 10**9])
def test_first_posts_of_few_and_of_many_users(spark, bound):
    posts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 40)).alias("user"), F.col("id").alias("ord"), F.lit("t").alias("tweet"))
    users = spark.createDataFrame([("hot",), ("u1",), ("u1",), ("gone",)], "user string")
    got = {(r.user, r.rank): r.ord for r in batching.first_posts(posts.repartition(5), users, 4, bound).collect()}
    of_u1 = [i for i in range(3000) if i % 3 and i % 40 == 1][:4]
    assert got == {**{("hot", k + 1): 3 * k for k in range(4)}, **{("u1", k + 1): i for k, i in enumerate(of_u1)}}


def test_answers_by_count(spark):
    rows = [("q", i, None if i == 1 else f"a{i}", "I", "R") for i in range(8)] + [("empty", 9, None, "I", "R")]
    frame = spark.createDataFrame(rows, "question string, ord bigint, response string, intent string, reference_answer string")
    got = {(r.question, r.k): r.answers for r in batching.answers_by_count(frame, [1, 3], 1, 1).collect()}
    assert got == {("q", 1): ["a0"], ("q", 3): ["a...", "a...", "a..."], ("empty", 1): [], ("empty", 3): []}


def test_inference_isolates_failures(spark):
    def make():
        def model(prompts, seeds):
            if any("bad" in p for p in prompts):
                raise RuntimeError("prompt would exceed the max model length")
            return [None if p == "none" else f" {p}-{s} " for p, s in zip(prompts, seeds)]
        return model

    rows = spark.createDataFrame([(i, p, 10 + i) for i, p in enumerate(["a", "bad", "none", "b"])], "prompt_id int, prompt string, seed int")
    got = {r.prompt: (r.status, r.response) for r in inference.infer(rows.coalesce(1), make, 2, inputs=["seed"]).collect()}
    assert got["a"] == ("ok", "a-10") and got["b"] == ("ok", "b-13") and got["bad"][0] == "error" and got["none"][0] == "empty"

    def broken():
        def model(prompts):
            raise RuntimeError("something else")
        return model

    with pytest.raises(Exception, match="something else"):
        inference.infer(rows, broken).collect()


def test_requests_retry_in_rounds(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        def request(prompt):
            name = os.path.join(folder, prompt)
            with open(name, "a") as f:
                f.write(f"{time.time()}\n")
            times = len(open(name).readlines())
            if prompt == "later" and times < 3 or prompt == "never":
                raise inference.RetryLater()
            if prompt == "no":
                raise inference.GiveUp("400")
            if prompt == "odd" and times < 2 or prompt == "broken":
                raise ValueError("odd")
            return prompt.upper()
        return request

    waited = []
    rows = spark.createDataFrame([(p, 2**60 + 1) for p in ("later", "never", "no", "ok", "odd", "broken")], "prompt string, n bigint")
    done = inference.infer_requests(rows.repartition(2), make, delay=0.2, wait=lambda s: (waited.append(s), time.sleep(s)))
    got = {r.prompt: (r.response, r.status, r.attempts) for r in done.collect()}
    assert got["later"] == ("LATER", "ok", 3) and got["ok"] == ("OK", "ok", 1) and got["odd"] == ("ODD", "ok", 2)
    assert got["never"] == ("[ERROR: Max retries exceeded]", "error", 3) and got["no"] == ("[ERROR: 400]", "error", 1)
    assert got["broken"] == ("[ERROR: odd]", "error", 3)
    assert done.columns == ["prompt", "n", "response", "status", "error", "attempts"] and {r.n for r in done.collect()} == {2**60 + 1}
    times = {p: [float(t) for t in open(os.path.join(folder, p))] for p in got}
    assert {p: len(t) for p, t in times.items()} == {"later": 3, "never": 3, "no": 1, "ok": 1, "odd": 2, "broken": 3}
    assert len(waited) == 2 and times["later"][1] - times["later"][0] >= 0.2 and times["later"][2] - times["later"][1] >= 0.4


def test_a_stopped_run_over_files_answers_every_prompt_once(spark, tmp_path):
    prompts, path, mark = f"{tmp_path}/prompts", f"{tmp_path}/out", tmp_path / "mended"
    spark.range(40).selectExpr("id AS prompt_id", "concat('p', id) AS prompt").repartitionByRange(4, "prompt_id").write.parquet(prompts)
    broken = str(mark)

    def make():
        def model(batch):
            if "p25" in batch and not os.path.exists(broken):
                raise RuntimeError("the machine is gone")
            return [p.upper() for p in batch]
        return model

    def run(rows):
        return inference.infer(rows, make, recoverable=[])

    schema = "prompt_id bigint, prompt string"
    with pytest.raises(Exception, match="machine is gone"):
        inference.infer_files(spark, prompts, schema, run, path)
    before = spark.read.parquet(f"{path}/replies").count()
    assert 0 < before < 40
    mark.write_text("x")
    spark.range(40, 45).selectExpr("id AS prompt_id", "concat('p', id) AS prompt").write.mode("append").parquet(prompts)
    done = inference.infer_files(spark, prompts, schema, run, path).collect()
    assert sorted((r.prompt_id, r.response) for r in done) == [(i, f"P{i}") for i in range(45)]
    assert inference.infer_files(spark, prompts, schema, run, path).count() == 45


def test_resume_asks_only_for_missing_replies(spark, tmp_path):
    path = str(tmp_path / "replies")
    prompts = spark.range(20).select(F.col("id").alias("prompt_id"), F.lit("p").alias("prompt"))

    def run(tag):
        return lambda rows: rows.withColumn("response", F.lit(tag))

    inference.infer_resumable(prompts.where("prompt_id < 5"), run("first"), path, "r1", parts=2)
    done = inference.infer_resumable(prompts, run("second"), path, "r1", parts=3)
    assert {r.response: r["count"] for r in done.groupBy("response").count().collect()} == {"first": 5, "second": 15}
    assert done.select("prompt_id").distinct().count() == 20


def test_rounds_remove_one_copy_and_match_rule_is_shared(spark):
    rows = spark.createDataFrame([("h", ["a", "b", "a"])], "interaction_history string, candidates array<string>")
    got = inference.recommend_in_rounds(rows, lambda: lambda prompts: ["A" for _ in prompts], rounds=5).first()
    assert got.recommendations == ["a", "a"] and len(got.responses) == 5
    assert inference.matching_item("", ["x"]) == "x" and inference.matching_item("q", ["x"]) is None


def test_metrics_with_empty_denominators(spark):
    rows = spark.createDataFrame([(None, "YES")], "said string, target string")
    got = metrics.yes_no_metrics(rows, "said", "target").first()
    assert (got.accuracy, got.precision, got.recall, got.f1_score, got.valid_response_rate) == (0, 0, 0, 0, 0)
    weights = spark.createDataFrame([(4.0, 50.0, 5.0), (1.0, 150.0, 1.0), (None, None, 3.0)], "s double, c double, t double")
    got = metrics.rating_metrics(weights, "s", "c", "t").first()
    assert got.average_prediction_error == 0.5 and got.weighted_average_prediction_error == 0.25


def test_nearest_profiles_equal_brute_force(spark):
    rng = random.Random(5)
    def vector():
        return [rng.uniform(-1, 1) for _ in range(6)]
    known = [(i, vector()) for i in range(60)]
    known += [(100 + i, known[0][1]) for i in range(30)]  # a third are copies of one vector
    asked = [(i, known[0][1] if i == 0 else vector()) for i in range(9)]
    q = spark.createDataFrame(asked, "question_id bigint, vector array<double>")
    p = spark.createDataFrame(known, "profile_id bigint, vector array<double>")

    def cosine(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 9)

    want = {i: [x[1] for x in sorted((-cosine(v, w), j) for j, w in known)[:4]] for i, v in asked}
    for blocks in ((1024, 32768), (2, 7)):
        rows = retrieval.nearest_profiles(q, p, 4, *blocks).collect()
        assert {i: [r.profile_id for r in sorted((r for r in rows if r.question_id == i), key=lambda r: r.rank)] for i, _ in asked} == want


def test_draws_reach_all_of_a_large_pool(spark):
    pool = 5 * 10**11
    drawn = spark.range(2000).select(F.explode(draw(3, F.lit(pool), 20, "id")).alias("d"))
    counts = drawn.groupBy(F.expr(f"d div {pool // 10}").alias("tenth")).count().collect()
    assert sorted(r.tenth for r in counts) == list(range(10)) and all(3000 < r["count"] < 5000 for r in counts)
    spread = spark.range(200).select(F.transform(draw(3, F.lit(pool), 20, "id"), lambda d: d).alias("d"))
    assert spread.where(F.array_max("d") - F.array_min("d") < pool // 10).count() == 0  # one key's draw spreads as well


def test_carried_columns_stay_exact(spark):
    big = 2**60 + 1
    rows = spark.createDataFrame([(1, "p", big, ["A", "B"], "h"), (2, "q", None, None, "h")],
                                 "id int, prompt string, n long, candidates array<string>, interaction_history string").coalesce(1)
    got = inference.infer(rows, lambda: lambda prompts: prompts).collect()
    assert {(r.prompt, r.n, r.response) for r in got} == {("p", big, "p"), ("q", None, "q")}
    got = inference.infer_requests(rows, lambda: lambda prompt: prompt).collect()
    assert {(r.n, r.status) for r in got} == {(big, "ok"), (None, "ok")}
    played = {r.n: r for r in inference.recommend_in_rounds(rows, lambda: lambda prompts: ["B" for _ in prompts], rounds=2).collect()}
    assert played[big].recommendations == ["B"] and len(played[big].prompts) == 2 and played[None].prompts == []


def test_a_failing_prompt_does_not_end_a_round(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("Invalid prefix encountered")
        return ["A" for _ in prompts]
    rows = spark.createDataFrame([("ok", ["A"]), ("bad", ["A"])], "interaction_history string, candidates array<string>").coalesce(1)
    got = {r.interaction_history: r for r in inference.recommend_in_rounds(
        rows, lambda: model, rounds=1, recoverable=["Invalid prefix"]).collect()}
    assert got["ok"].recommendations == ["A"] and got["bad"].recommendations == [] and len(got["bad"].responses) == 1


def test_positions_over_many_bundles(spark, monkeypatch):
    from voicegrain.operators import ranking
    monkeypatch.setattr(ranking, "RUNS_TOGETHER", 4)
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7).alias("o"))
    got = ranking.position_in_group(rows, ["g"], "o", width=10).collect()
    for g in range(3):
        assert [r.position for r in sorted((r for r in got if r.g == g), key=lambda r: r.o)] == list(range(sum(r.g == g for r in got)))


def test_few_rows_are_dealt_to_tasks_by_the_rows_they_become(spark, monkeypatch):
    """A small table of profiles lies in one task; its pairs are made in many."""
    from voicegrain.operators import skew

    monkeypatch.setattr(skew, "MADE_ROWS", 100)
    people = spark.range(200).coalesce(1).select(F.concat(F.lit("u"), "id").alias("user_id"))
    pool = spark.range(50).select(F.col("id").alias("position"), F.concat(F.lit("i"), "id").alias("item_description"))
    pairs = pairing.pair_with_items(people, pool, 10, 7).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in pairs}) > 10 and len({(r.user_id, r.item_description) for r in pairs}) == 2000
    dealt = skew.dealt_for(people, 10, "user_id")
    assert dealt.rdd.getNumPartitions() == 20 and skew.dealt_for(people.where("false"), 10, "user_id").count() == 0
    users = spark.range(30).select(F.col("id").cast("string").alias("user"), F.lit(4).cast("bigint").alias("n_posts"))
    asked = spark.range(300).coalesce(1).select(F.col("id").alias("profile_id"), (F.col("id") % 30).cast("string").alias("user"), F.lit(2).alias("n_positive"))
    calls = []
    monkeypatch.setattr(pairing, "dealt_for", lambda *a: calls.append(a[1:]) or skew.dealt_for(*a))
    others = pairing.other_posts(asked, users, 10, 7).collect()
    assert calls == [(10, "profile_id")] and len({(r.profile_id, r.other, r.position) for r in others}) == 300 * 8
