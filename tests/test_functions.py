"""Scalar functions and the reply parser on small tables with their edge cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from voicegrain.functions import json_replies, replies, text
from voicegrain.operators import grading, parsing, scrubbing


def values(spark, rows, expression, name="t"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} string")
    return [r[0] for r in frame.select("i", expression.alias("v")).orderBy("i").select("v").collect()]


def test_template_tokens_are_literal_and_filled_in_order(spark):
    got = values(spark, ["$1\\2 TEMPLATE_B"], text.fill_template("x TEMPLATE_A", ("TEMPLATE_A", F.col("t")), ("TEMPLATE_B", "late")))
    assert got == ["x $1\\2 late"]


def test_strip_removes_all_white_space(spark):
    rows = [" a \n", " b ", "\x1cc\x1f", "d e", ""]
    assert values(spark, rows, text.strip(F.col("t"))) == [r.strip() for r in rows]


def test_item_display(spark):
    rows = [("T", "1999.0"), ("T", None), (None, None), ("T", "abc"), ("T", "NaN")]
    frame = spark.createDataFrame(rows, "title string, year string")
    got = [r[0] for r in frame.select(text.item_display(["title", "year"])).collect()]
    assert got == ["Title: T, Year: 1999", "Title: T", None, "Title: T, Year: abc", "Title: T, Year: NaN"]
    assert text.readable_label("detail_desc") == "Detail Desc"


def test_chat_messages(spark):
    rows = ["a b\nUser Profile: x\nQuestion: y", "\nQuestion: y", "one\ntwo", "one", " \ntwo"]
    got = [[tuple(m) for m in v] for v in values(spark, rows, text.chat_messages(F.col("t")))]
    assert got == [
        [("system", "a b"), ("user", "User Profile: x\nQuestion: y")], [("user", "\nQuestion: y")],
        [("system", "one"), ("user", "two")], [("user", "one")], [("user", " \ntwo")],
    ]


def test_yes_no(spark):
    rows = ["YES", " no ", "KNOW", "yes or no", "maybe", "<think>NO</think> yes", "a</think>no</think>yes"]
    assert values(spark, rows, replies.yes_no(F.col("t"))) == ["YES", "NO", "NO", None, None, "YES", "NO"]
    assert values(spark, ["yes!", "no", " x "], replies.yes_no_target(F.col("t"))) == ["YES", "NO", "X"]


def test_match_item_rules_and_empty_reply(spark):
    pool = F.array(*[F.lit(x) for x in ("Red", "Red Car", "Blue")])
    rows = ["red car", "I like BLUE things", "ca", "", "zzz", "x</think> Blue"]
    assert values(spark, rows, replies.match_item(F.col("t"), pool)) == ["Red Car", "Blue", "Red Car", "Red", None, "Blue"]


def test_remove_first_keeps_later_copies(spark):
    frame = spark.createDataFrame([(["a", "b", "a"], "a")], "items array<string>, item string")
    assert frame.select(replies.remove_first(F.col("items"), F.col("item"))).first()[0] == ["b", "a"]


def test_list_reply(spark):
    rows = ["> ['a','b\\'s',] ", 'x [y] assistantfinal ["p", "q"] z', "[a]", "] [\"q\"", "none", "[]"]
    assert values(spark, rows, replies.list_reply(F.col("t"))) == [["a", "b's"], ["p", "q"], None, ["q"], None, []]


def test_rating(spark):
    rows = ["(a) assistantfinal (4 stars, 80%)", "(x) (3.5 star, 70%)", "(4, 5) x", "no", "(4 stars)", "(1,2,3)"]
    stars, share = replies.rating(F.col("t"))
    assert values(spark, rows, F.array(stars, share)) == [[4.0, 80.0], [3.5, 70.0]] + [[None, None]] * 4


def test_judge_scores_curly_quotes_range_and_repeats(spark):
    rows = ["x {0} {’A’: 6, 'B': 11, ‘综合得分’: 7, 'A': 5}", "{'Overall': 3}", "none"]
    assert values(spark, rows, replies.judge_scores(F.col("t"))) == [{"A": 5, "综合得分": 7}, {"Overall": 3}, {}]
    assert values(spark, rows, replies.overall_score(replies.judge_scores(F.col("t")))) == [7, 3, None]


def test_generation_budget(spark):
    rows = [(512, 1024), (2048, 2048), (99999, 65536), (4, 4), (5, 1)]
    frame = spark.createDataFrame(rows, "m int, x int")
    got = [tuple(r) for r in frame.select(replies.generation_budget(F.col("m"), F.col("x")), replies.allowed_input(F.col("m"), F.col("x"))).collect()]
    assert got == [(512, 512), (256, 1792), (4096, 61440), (256, 1), (256, 1)]


def test_summary_answer(spark):
    rows = ["long text here", "x AssistantAnalysis y", "a assistantanalysis  b ", None]
    assert values(spark, rows, replies.summary_answer(F.col("t"), F.lit(4))) == ["long...", "x As...", "b", ""]
    assert values(spark, rows, replies.summary_answer(F.col("t"), F.lit(0)))[0] == "long text here"


def test_scrub_counts_each_kind(spark):
    rows = spark.createDataFrame([("see http://a.b/c?x=1 @joe me@x.org +44 1234 567 890",), (None,), ("",)], "t string")
    out = scrubbing.scrub(rows, "t")
    got = {r.t: (r.scrubbed, r.n_url, r.n_email, r.n_phone, r.n_handle) for r in out.collect()}
    assert got == {rows.first().t: ("see [URL] [HANDLE] [EMAIL] [PHONE]", 1, 1, 1, 1), None: (None,) * 5, "": ("", 0, 0, 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 4  # each kind is replaced once


REPLIES = [
    ('{"a":1}', {"a": 1}, "whole"), ('{"a":1} trailing', {"a": 1}, "balanced"), ('x assistantfinal {"a":"é"}', {"a": "é"}, "whole"),
    ('```json\n{"a":2}\n```', {"a": 2}, "fence"), ("{'a':True}", {"a": True}, "whole"), ('{"a":1,}', {"a": 1}, "whole"),
    ('say {"a":{"b":2}} and [1,2,3,4,5,6,7,8,9,10] x', list(range(1, 11)), "balanced"), ("5", 5, "whole"), ("plain", None, "raw"),
    ("don't {\"a\":1} x", {"a": 1}, "balanced"), ("", None, "raw"), ('{"a":1,"a":2}', {"a": 2}, "whole"),
    ('{"a":1},{"b":2}', {"a": 1}, "balanced"), ('{"a":1}],[{"b":1}', {"a": 1}, "balanced"), ('{"broken":', None, "raw"),
    ("null", None, "raw"), ("```\n```json [1] ```", [1], "balanced"), ('{"q":"}{"}', {"q": "}{"}, "whole"),
    ('{"a":"it\'s"} {\'b\':', {"a": "it's"}, "balanced"), ('ASSISTANTFINAL ["x"]', ["x"], "whole"),
]


def test_parser_finds_the_value_and_its_place(spark):
    frame = spark.createDataFrame([(i, r[0]) for i, r in enumerate(REPLIES)], "i int, response string")
    rows = parsing.read_json(frame, "response").orderBy("i").collect()
    for row, (reply, want, stage) in zip(rows, REPLIES):
        assert row["_read"]["stage"] == stage, reply
        assert (json.loads(row["_read"]["json"]) if stage != "raw" else None) == want, reply


def test_simple_rules(spark):
    names = ["a"]
    frame = spark.createDataFrame([(0, 'x {"a":{"b":2}}'), (1, 'y {"a":1} z'), (2, 'assistantfinal [1]'), (3, 'q {"a": "s"}')], "i int, response string")
    last = [r.parsed.a for r in parsing.parse_by(frame, json_replies.in_last_braces, names).orderBy("i").collect()]
    assert last == [None, "1", None, "s"]
    front = [r.parsed.a for r in parsing.parse_by(frame, json_replies.from_last_brace, names).orderBy("i").collect()]
    assert front == [None, None, None, "s"]


def test_scoring_text(spark):
    cases = [
        ('{"answer":"  hi "}', "hi"), ('{"answer":5,"text":"t"}', "t"), ('{"other":"x"}', ""), ('["a"," b ",3]', "a\nb"), ("5", "5"),
        ("true", "True"), ("plain", "plain"), ("{broken}", ""), ("assistantanalysis foo", "foo"), ("", ""), (None, None),
        ("has summarised_final_answer: x", ""),
    ]
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    got = [r.scoring_text for r in parsing.with_scoring_text(frame).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_unknown_intent_drops_or_fails(spark):
    rows = spark.createDataFrame([("Leisure",), ("Other",)], "intent string")
    assert grading.with_rubric(rows, grading.rubrics(spark)).count() == 1
    with pytest.raises(Exception, match="no rubric"):
        grading.with_rubric(rows, grading.rubrics(spark), strict=True).collect()


def test_python_json_is_read(spark):
    from voicegrain.operators import parsing
    from voicegrain.functions import json_replies
    texts = ['{"a": NaN, "b": "x"}', '{"a": 1, "b": "w", "b": "x"}', 'prose {"b": "\\ud800"} end', '{"a": -Infinity, "b": "x"} tail', '{"b": }']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    got = {r.i: r.parsed for r in parsing.parse_replies(rows, ["a", "b"]).collect()}
    assert [got[i].b for i in range(5)] == ["x", "x", "?", "x", None] and got[0].a == "NaN"
    assert [got[i].found for i in range(5)] == [True] * 4 + [False]
    strict = {r.i: r.parsed for r in parsing.parse_by(rows, json_replies.as_it_is, ["b"]).collect()}
    assert [strict[i].b for i in range(5)] == ["x", "x", None, None, None]
    scored = spark.createDataFrame([('{"score": NaN, "answer": "the good answer"}',)], "response string")
    assert parsing.with_scoring_text(scored).first().scoring_text == "the good answer"


def test_bracket_search_is_linear():
    import time
    from voicegrain.functions.json_replies import balanced_spans
    start = time.time()
    assert balanced_spans("{" * 20_000) == [] and balanced_spans("{ it's " * 5_000) == []
    assert time.time() - start < 10
    assert balanced_spans("a {b {c} d} [e] {f") == ["{b {c} d}", "{c}", "[e]"]


def made_replies(n):
    """Replies from pieces that are JSON, nearly JSON, Python or neither, in all kinds of places."""
    rnd = random.Random(11)
    texts = ['"x"', "'x'", '"it\'s"', "'a: True, b'", '"a,}"', "'{'", '"}"', "'q\\n'", '""', "''", "'é'", '"\\u00e9"', "'say \"hi\"'"]
    words = ["true", "false", "null", "True", "False", "None", "1", "-2", "01", "1.50", "1e3", "NaN", "-Infinity", "12345678901234567890", "maybe"]

    def value(depth):
        kind = rnd.random()
        if depth and kind < 0.12:
            return "[" + ", ".join(value(depth - 1) for _ in range(rnd.randint(0, 3))) + rnd.choice(["", "", ",", " , "]) + "]"
        if depth and kind < 0.24:
            return pairs(depth - 1)
        return rnd.choice(texts if kind < 0.7 else words)

    def pairs(depth):
        quote = rnd.choice(["'", '"'])
        inner = [f"{quote}{rnd.choice('abcab')}{quote}{rnd.choice([':', ': ', ' : '])}{value(depth)}" for _ in range(rnd.randint(0, 3))]
        return "{" + rnd.choice([", ", ","]).join(inner) + rnd.choice(["", "", "", ",", ", ", "\n"]) + rnd.choice(["}", "}", "}", "}", " }", ""])

    frames = ["{}", "{}", "{}", "{}", "```json\n{}\n```", "```{}```", "Here: {} Hope it's fine.", "Look {} and {}", "is it {}?", "1. {}", "the [list] {}",
              "true {}", "({})", "# {}", "```\nnope\n``` then ```json {} ```", "say \"{}\"", "so {}", "x {} [", "{} tail", "a ` {}"]
    out = []
    for _ in range(n):
        out.append(re.sub(r"\{\}", lambda _: pairs(2) if rnd.random() < 0.8 else value(2), rnd.choice(frames)))
    return out + ["", "   ", "true", "nul", "{", "}", "{}", "[]", "{'a': 1, 'a': 2}", '{"a": 1, "a": 2}', "{'a': null}", "so {'a': null, 'b': 'x'} ok"]


def test_replies_are_read_as_the_lenient_parser_reads_them(spark):
    texts = made_replies(6000)
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, response string").repartition(8)
    found = parsing.read_json(frame, "response").select("i", "_text", "_read.json", "_read.stage", F.to_json("_read.value").alias("value")).collect()
    kinds = set()
    for r in found:
        want, stage = json_replies.parse_text(r._text) if r._text else (None, "raw")
        assert r.stage == stage, (texts[r.i], r, want, stage)
        if want is not None:
            assert json.loads(r.value) == json.loads(want) and r.json[:1] == want[:1], (texts[r.i], r, want)
        kinds.add(stage)
    assert kinds == {"whole", "fence", "balanced", "raw"}


def test_common_shapes_do_not_reach_python(spark):
    payload = '{"a": "x y", "b": true, "c": null, "n": 12}'
    python = "{'a': 'x y', 'b': True, 'c': None, 'n': 12}"
    shapes = [payload, "```json\n" + payload + "\n```", python, payload[:-1] + ",}", f"Here is my view: {payload} Hope it helps.",
              payload.replace('"', "'"), f"I say {python} now", "thinking assistantfinal" + payload]
    frame = spark.createDataFrame(list(enumerate(shapes)), "i int, response string")
    text = json_replies.without_markers(F.col("response"))
    piece = json_replies.plain_piece(text)["piece"]
    value = json_replies.strict_json(json_replies.maybe_strict(json_replies.as_strict(piece)))
    rows = frame.select("i", value.isNotNull().alias("read"), json_replies.unreadable(text).alias("hopeless")).orderBy("i").collect()
    assert [r.read or r.hopeless for r in rows] == [True] * len(shapes)
    assert [r.i for r in rows if r.hopeless] == [5]


def test_rules_read_a_text_once_and_share_one_python_pass(spark):
    payload = '{"a": "x", "b": true}'
    texts = [payload, f"so assistantfinal {payload}", f"```json\n{payload}\n```", payload.replace('"', "'"), payload[:-1] + ",}", f"I say {payload} now",
             '{"a": NaN, "b": 1}', 'assistantfinal {"a": 1, "a": 2}', " [1] ", "x {\"a\": {\"b\": 2}}", "{'a': True}", "", "no", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    rules = {"last": json_replies.in_last_braces, "front": json_replies.from_last_brace,
             "final": json_replies.in_final_channel, "whole": json_replies.as_it_is}
    read = parsing.parse_by_rules(frame, rules, ["a", "b"], kinds=("whole",))
    assert read._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert read.columns == ["i", "response", *rules]
    got = {r.i: r for r in read.collect()}
    for name, rule in rules.items():
        for r in parsing.parse_by(frame, rule, ["a", "b"], kinds=name == "whole").collect():
            assert got[r.i][name] == r.parsed, (name, texts[r.i])
    assert [(got[i].last.a, got[i].front.a, got[i].final.a, got[i].whole.a) for i in (0, 1, 2, 3, 6, 7)] == [
        ("x",) * 4, ("x", "x", "x", None), ("x", None, None, None), (None,) * 4, ("NaN",) * 4, ("2", "2", "2", None)]
    assert got[0].whole.kinds.b == "BOOLEAN" and got[13].whole.found is False and got[13].whole.kinds.a is None


def test_prose_without_a_value_is_settled_by_an_expression(spark):
    prose = ["no idea", "None", "nullable", "trueish", "It's \"so\"", "a } b", "x\ny", "Infinity and more"]
    others = ["true", "false\n", "null", "NaN", "Infinity", "-Infinity", "5", '"a"', "so [1]", "see {\"a\": 1}", "a ```1``` b", "", "\u00e9t\u00e9"]
    frame = spark.createDataFrame([(t,) for t in prose + others], "text string")
    settled = {r.text for r in frame.where(F.col("text").rlike(json_replies._ONLY_PROSE)).collect()}
    assert settled == set(prose) and all(json_replies.parse_text(t) == (None, "raw") for t in prose)
