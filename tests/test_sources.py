"""Readers, column checks and file order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from voicegrain import schemas
from voicegrain.sources import quoted_csv, sinks, tables


def test_file_order_over_many_splits(spark, tmp_path):
    for f in range(3):
        lines = ['{"author":"a","text":"%d-%04d"}' % (f, i) for i in range(300 + f)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = tables.read_posts_json(spark, str(tmp_path)).orderBy("ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.tweet for r in rows] == sorted(r.tweet for r in rows)
    assert [r.ord for r in rows] == list(range(903)) and rows[0].user == "a"


def split_by(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def whole_files(spark):
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_no_job_runs_before_the_rows_are_asked_for(spark, tmp_path):
    frame = spark.range(3000).selectExpr("concat('u', id % 7) AS author", "concat('t', id) AS text").repartitionByRange(4, "text").sortWithinPartitions("text")
    frame.write.mode("overwrite").parquet(f"{tmp_path}/posts")
    frame.write.mode("overwrite").json(f"{tmp_path}/lines")
    for part in os.listdir(f"{tmp_path}/lines"):
        if part.endswith(".json"):
            os.link(f"{tmp_path}/lines/{part}", f"{tmp_path}/lines/{part}l")
    raw = spark.read.parquet(f"{tmp_path}/posts")  # this looks into a footer
    spark.sparkContext.setJobGroup("planning", "")
    ordered = tables.with_row_order(raw)
    posts = tables.read_posts_json(spark, f"{tmp_path}/lines")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setJobGroup("reading", "")
    in_files = [r.text for f in sorted(os.listdir(f"{tmp_path}/posts")) if f.endswith(".parquet") for r in spark.read.parquet(f"{tmp_path}/posts/{f}").collect()]
    split_by(spark, 4000)
    try:
        assert [r.text for r in ordered.orderBy("ord").collect()] == in_files
        rows = sorted(posts.collect(), key=lambda r: r.ord)
        assert [r.ord for r in rows] == list(range(3000)) and [r.tweet for r in rows] == in_files
    finally:
        whole_files(spark)


def csv_text(rnd, n, end):
    fields = ["plain", "two words", "é 日本", 'say ""hi""', "a,b", "line\nbreak", "\n\n", "x\r\ny", "", '""', "tail\n", 'q""\n""q', " sp "]
    out = ["a,b,c"]
    for _ in range(n):
        row = [rnd.choice(fields) for _ in range(3)]
        out.append(",".join(f'"{f}"' if set(f) & set('",\n\r') or rnd.random() < 0.2 else f for f in row))
        if rnd.random() < 0.05:
            out.append("")
    return end.join(out) + (end if rnd.random() < 0.5 else "")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_splits_of_any_size_give_the_records_of_whole_files(spark, tmp_path, end):
    rnd = random.Random(3)
    for name, n in (("0", 0), ("1", 60), ("2", 40), ("3", 1)):
        (tmp_path / f"{name}.csv").write_bytes(csv_text(rnd, n, end).encode())
    (tmp_path / "4.csv").write_bytes(b"")
    (tmp_path / "5.csv").write_bytes(('a,b,c' + end + '"' + "long\n" * 300 + '",x,y').encode())
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("a string, b string, c string")
    want = [tuple(r) for f in sorted(os.listdir(tmp_path)) for r in whole.csv(f"{tmp_path}/{f}").collect()]
    assert len(want) == 102
    for size in (29, 200, 1 << 20):
        split_by(spark, size)
        try:
            got = sorted(quoted_csv.read_records(spark, f"{tmp_path}/*.csv", ["a", "b", "c"]).collect(), key=lambda r: r._ord)
        finally:
            whole_files(spark)
        assert [tuple(r)[:3] for r in got] == want and [r._ord for r in got] == list(range(102))
        assert {(os.path.basename(r._file), r._line) for r in got if r._line == 0} == {(f"{i}.csv", 0) for i in (1, 2, 3, 5)}


def test_post_ids_of_labelled_posts_do_not_depend_on_splits(spark, tmp_path):
    for user in ("ann", "bob"):
        (tmp_path / f"inference_results_user_{user}.csv").write_text("User,Tweet,Prompt,Response\n" + "".join(f'z,"t{i}\nx",p,r\n' for i in range(50)))
    found = []
    for size in (64, 1 << 20):
        split_by(spark, size)
        try:
            found.append(sorted(tuple(r) for r in tables.read_labelled_posts(spark, str(tmp_path)).collect()))
        finally:
            whole_files(spark)
    assert found[0] == found[1] and [r[-1] for r in sorted(found[0], key=lambda r: r[-1])] == list(range(100))


def test_csv_with_line_breaks_and_both_profile_schemas(spark, tmp_path):
    for name, header in (("new", "user_id,user_profile"), ("old", "UserName,UserProfile")):
        (tmp_path / f"{name}.csv").write_text(header + "\n" + "".join(f'u{i},"line\nwith ""quotes"" {i}"\n' for i in range(9)))
        rows = tables.read_profiles(spark, str(tmp_path / f"{name}.csv")).orderBy("ord").collect()
        assert [(r.ord, r.user_id, r.user_profile) for r in rows] == [(i, f"u{i}", f'line\nwith "quotes" {i}') for i in range(9)]
    with pytest.raises(ValueError, match="missing required"):
        tables.read_interest(spark, str(tmp_path / "new.csv"))


def test_column_rules(spark):
    raw = spark.createDataFrame([("a", "t")], "author string, text string")
    assert tables.post_columns(raw).columns == ["user", "tweet"]
    assert tables.copy_post_columns(raw).columns == ["author", "text", "user", "tweet"]
    both = raw.withColumn("user", F.lit("u")).withColumn("tweet", F.lit("x"))
    assert tables.post_columns(both).columns == ["author", "text", "user", "tweet"]
    named = spark.createDataFrame([("t", "['a']", "h")], "target_interaction string, candidate_pool string, interaction_history string")
    assert tables.ranking_columns(named).first().candidates == "['a']"
    qa = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert tables.yes_no_columns(qa).first().system_prompt is None
    with pytest.raises(ValueError):
        schemas.normalise_profiles(qa)


def test_labelled_posts_take_the_user_from_the_file_name(spark, tmp_path):
    for user in ("ann", "bob.x"):
        (tmp_path / f"inference_results_user_{user}.csv").write_text("User,Tweet,Prompt,Response\n" + f'z,"t1\nx",p,r\nz,t2,p,r\n')
    rows = tables.read_labelled_posts(spark, str(tmp_path)).orderBy("user", "ord").collect()
    assert [(r.user, r.tweet) for r in rows] == [("ann", "t1\nx"), ("ann", "t2"), ("bob.x", "t1\nx"), ("bob.x", "t2")]


def test_items_results_metrics_and_few_zero(spark, tmp_path):
    base = str(tmp_path)
    os.makedirs(f"{base}/books")
    frame = spark.createDataFrame([("A", 1), (None, 2), ("B", 3)], "title string, n int").coalesce(1)
    frame.write.mode("overwrite").parquet(f"{base}/books/items.parquet")
    assert [r.item_description for r in tables.read_items(spark, base, "books").orderBy("item_id").collect()] == ["A", "B"]
    frame.where("title is null").write.parquet(f"{base}/cds/items.parquet")
    with pytest.raises(ValueError, match="empty"):
        tables.read_items(spark, base, "cds")
    sinks.write_results(frame, f"{base}/out", csv=True)
    assert spark.read.parquet(f"{base}/out").count() == spark.read.option("header", True).csv(f"{base}/out_csv").count() == 3
    for tag, step, accuracy in (("yes", 200, 0.9), ("yes", 100, 0.1), ("no", 200, 0.5), ("yes", 200, 0.2)):  # 200 runs twice
        sinks.put_metrics(spark.createDataFrame([(accuracy,)], "accuracy double"), f"{base}/metrics", tag, step)
    history = sinks.metrics_history(spark, f"{base}/metrics", "yes", "accuracy double, tag string, step bigint").collect()
    assert [(r.step, r.accuracy) for r in history] == [(100, 0.1), (200, 0.2)]
    both = spark.createDataFrame([("yes", 100, 0.7), ("no", 300, 0.8)], "tag string, step bigint, accuracy double")
    sinks.put_metrics(both, f"{base}/metrics")
    history = sinks.metrics_history(spark, f"{base}/metrics", "yes", "accuracy double, tag string, step bigint").collect()
    assert [(r.step, r.accuracy) for r in history] == [(100, 0.7), (200, 0.2)]
    assert sinks.metrics_history(spark, f"{base}/metrics", "no", "accuracy double, tag string, step bigint").count() == 2
    (tmp_path / "eval.jsonl").write_text('{"prompt":"p","target":"t","few_zero":"few","task":"direct"}\n{"prompt":"q","target":"t","few_zero":"zero","task":"direct"}\n')
    assert [r.prompt for r in tables.read_few_zero(spark, f"{base}/eval.jsonl", "zero", "direct").collect()] == ["q"]
    assert tables.constant_prompts(spark, "p", 3, 7).agg(F.sum("seed")).first()[0] == 24


@pytest.mark.parametrize("run_lines", [1, 3, 8192])
def test_lines_of_a_split_are_numbered_in_short_runs(spark, tmp_path, run_lines):
    """A split of many lines is cut into runs, and records that go over their ends are whole."""
    (tmp_path / "1.csv").write_text("a,b\n" + "".join(f'{i},"{"x\n" * (i % 5)}{i}"\n' for i in range(40)))
    lines = quoted_csv.lines_of(spark, str(tmp_path / "1.csv"), run_lines)
    assert lines.groupBy("_file", "_block", "_run").count().agg({"count": "max"}).first()[0] <= run_lines
    got = quoted_csv.records_of(spark, str(tmp_path / "1.csv"), run_lines).orderBy("ord").collect()
    assert [(r.line, r.record) for r in got] == [(i, f'{i},"{"x\n" * (i % 5)}{i}"') for i in range(40)]
