"""The engine's tables (posts, profiles, questions, replies ...) derived from the given tables.

``oracles.py`` defines the same views in SQL, under the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voicegrain.operators.once import compute_once
from voicegrain.operators.ranking import hash_positions, position_in_group
from voicegrain.sources.tables import item_pool


# Declared, so that reading a table costs no look into its files before the query runs
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def wrapped(payload: Column, shape: Column) -> Column:
    """A JSON text the way models write it: clean, marked, fenced, single-quoted, with a trailing
    comma, or inside prose."""
    return (
        F.when(shape == 0, payload)
        .when(shape == 1, F.concat(F.lit("Let me think. assistantfinal "), payload))
        .when(shape == 2, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
        .when(shape == 3, F.replace(payload, F.lit('"'), F.lit("'")))
        .when(shape == 4, F.concat(F.substring(payload, F.lit(1), F.length(payload) - 1), F.lit(",}")))
        .otherwise(F.concat(F.lit("Here is my view: "), payload, F.lit(" Hope it helps.")))
    )


def posts(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("post_id"), F.col("source").alias("user"), F.col("text").alias("tweet"),
        F.col("doc_id").alias("ord"),
    )


def posts_wide(spark, folder) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("post_id"), F.col("user_id").cast("string").alias("user"),
        F.concat("event_type", F.lit(" "), "props").alias("tweet"), F.col("event_id").alias("ord"),
    )


def labelled_posts(spark, folder) -> DataFrame:
    """Posts with a reply that says, in Python's spelling, whether the post is useful."""
    useful = F.when(F.col("ord") % 3 == 0, "False").otherwise("True")
    info = F.when(F.col("ord") % 7 == 0, F.lit("N/A")).otherwise(
        F.concat(F.initcap(F.split_part("tweet", F.lit(" "), F.lit(1))), F.lit(" Fan; user of item "),
                 F.regexp_extract("tweet", "([0-9]+)", 1), F.lit(" ;active"))
    )
    reply = F.concat(
        F.lit('Thinking. assistantfinal{"UsefulInformation": '), useful, F.lit(', "Justification": "seen", "UserInformation": "'),
        info, F.lit('"}'),
    )
    return stored_reply(posts_wide(spark, folder), reply)


def profiles(spark, folder) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("user_id"), F.col("c_custkey").cast("string").alias("user"),
        F.concat("c_name", F.lit(" lives in "), "n_name", F.lit(" and follows "), "c_mktsegment").alias("user_profile"),
    )


def questions(spark, folder) -> DataFrame:
    """User turns answered by the assistant in the next turn, numbered by conversation and turn: ``ord`` and ``position``."""
    turns = table(spark, folder, "conversations")
    longest = turns.agg(F.coalesce(F.max("turn"), F.lit(0)).cast("bigint") + 1).scalar()  # so turns of two conversations never meet
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference_ans"))
    intent = F.element_at(F.array(*[F.lit(i) for i in ("Leisure", "Ask_for_Advice", "Seek_Creativity")]),
                          (F.col("conv_id") % 3 + 1).cast("int"))
    rows = asked.join(said, ["conv_id", "turn"]).select(
        (F.col("conv_id") * longest + F.col("turn")).alias("_place"), "question", "reference_ans",
        intent.alias("user_intent"), F.when(F.col("conv_id") % 5 == 0, "ZH").otherwise("EN").alias("language"),
    )
    return position_in_group(rows, [], "_place").drop("_place").withColumn("ord", F.col("position"))


def items(spark, folder) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_size").cast("string").alias("year"),
    )


def pool(spark, folder) -> DataFrame:
    return hash_positions(item_pool(items(spark, folder), "netflix").select("item_id", "item_description"), "pool", ["item_id"])


def interest_replies(spark, folder) -> DataFrame:
    """One reply per order line; ``row_key`` names the line."""
    lines, orders, part = (table(spark, folder, n) for n in ("lineitem", "orders", "part"))
    flag, pick = F.col("l_returnflag"), (F.col("l_linenumber") % 3).cast("int")
    label = F.element_at(
        F.when(flag == "A", F.array(F.lit('"YES"'), F.lit("true"), F.lit('" yes "')))
        .when(flag == "N", F.array(F.lit('"NO"'), F.lit("false"), F.lit('"No"')))
        .otherwise(F.array(F.lit('"MAYBE"'), F.lit('"UNSURE"'), F.lit("1"))), pick + 1)
    why = F.when(F.col("l_quantity") == 1, "null").otherwise(F.concat(F.lit('"'), "p_name", F.lit(' fits"')))
    payload = F.concat(F.lit('{"Justification": '), why, F.lit(', "IsInterested": '), label, F.lit("}"))
    shape = ((F.col("l_orderkey") + F.col("l_linenumber")) % 6).cast("int")
    rows = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string"),
                        F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("row_key"),
            F.col("o_custkey").cast("string").alias("user_name"), F.col("p_name").alias("item_description"),
            shape.alias("shape"), payload.alias("payload"),
        )
    )
    return stored_reply(rows, wrapped(F.col("payload"), F.col("shape"))).drop("payload")


def stored_reply(rows: DataFrame, reply: Column) -> DataFrame:
    """The stub's reply as a column of its own, as if it had been read from a reply table."""
    return compute_once(rows, "response", reply)


def order_questions(spark, folder) -> DataFrame:
    """Every order asks one of the questions: ``o_orderkey`` and the question's columns."""
    asked = questions(spark, folder)
    total = asked.agg(F.count(F.lit(1))).scalar()
    orders = table(spark, folder, "orders").withColumn("position", F.col("o_orderkey") % total)
    return orders.join(asked, "position")


def annotation(spark, folder) -> DataFrame:
    """A profile (the order's customer) judged against a question."""
    verdict = F.when(F.col("o_orderstatus") == "F", "NO").otherwise("YES")
    rows = order_questions(spark, folder).select(
        "o_custkey", "question",
        F.concat(F.lit('{"MatchUserProfile": "'), verdict, F.lit('"}')).alias("response"),
    )
    people = profiles(spark, folder).select(F.col("ord").alias("o_custkey"), "user_profile")
    return rows.join(people, "o_custkey").drop("o_custkey")


def answers(spark, folder) -> DataFrame:
    """One answer per order, as text or JSON in several shapes; some are null."""
    key = F.col("o_orderkey").cast("string")
    payload = F.concat(F.lit('{"'), F.when(F.col("o_orderkey") % 2 == 0, "summary").otherwise("other"),
                       F.lit('": "View '), key, F.lit(' on it."}'))
    text = F.concat(F.lit("assistantanalysis weighing "), F.lit("assistantanalysis  View "), key, F.lit(" in short: "), "o_orderpriority")
    reply = F.when(F.col("o_orderstatus") == "P", F.lit(None)).when(F.col("o_orderkey") % 7 == 6, text).otherwise(
        wrapped(payload, F.col("o_orderkey") % 7))
    return stored_reply(order_questions(spark, folder), reply).select(
        F.col("o_orderkey").alias("ord"), "question", F.col("reference_ans").alias("reference_answer"),
        F.col("user_intent").alias("intent"), "response",
    )


def yesno_eval(spark, folder) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    n = F.col("n_chars") % 6
    reply = (
        F.when(n == 0, "YES").when(n == 1, " no.").when(n == 2, "yes and no").when(n == 3, "I cannot say")
        .when(n == 4, "<think>no</think> Yes").otherwise("I know it")
    )
    return docs.join(labels, "doc_id").select(
        "doc_id", "source", F.col("text").alias("question"), F.when(F.col("quality") == 1, "yes").otherwise(" No ").alias("answer"),
        reply.alias("response"),
    )


def ranking_eval(spark, folder) -> DataFrame:
    """Per order twelve candidates and a target that is one of them."""
    key = F.col("o_orderkey")
    candidates = F.transform(F.sequence(F.lit(0), F.lit(11)),
                             lambda i: F.concat(F.lit("item "), ((key * 7 + i * 5) % 97).cast("string"), F.lit(" "), F.col("o_orderstatus")))
    target = F.element_at(candidates, (F.col("o_custkey") % 12 + 1).cast("int"))
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", candidates.alias("candidates"), target.alias("target"),
        F.col("o_orderpriority").alias("interaction_history"),
    )


def vectors(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "embeddings")
    return (
        rows.where("label < 5").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")),
        rows.where("label >= 5").select(F.col("vec_id").alias("profile_id"), F.col("embedding").alias("vector")),
    )
