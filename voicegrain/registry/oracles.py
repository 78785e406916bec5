r"""SQL with the same results as ``queries.py``, for DuckDB on the same tables.

The common tables below are the views of ``views.py``. Helper functions write repeated expressions.
"""

from __future__ import annotations

from voicegrain import templates
from voicegrain.lookups import DATASET_TOPICS, DEFAULT_ITEM_TYPE, DEFAULT_TOPIC, PASS_THROUGH_PROMPT, RUBRIC_DIMENSIONS
from voicegrain.functions.text import SCRUB_PATTERNS
from voicegrain.operators.drawing import PRIME_STRIDES
from voicegrain.operators.grading import rubric_text
from voicegrain.registry.queries import EXCLUDE, PER_QUERY, SEED, TOTAL


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **fields: str) -> str:
    """Template with TEMPLATE_ tokens replaced in the given order."""
    out = q(template)
    for token, value in fields.items():
        out = f"replace({out}, 'TEMPLATE_{token}', {value})"
    return out


def strip(text: str) -> str:
    space = r"[\s\p{Z}\x0b\x1c-\x1f\x85]+"
    return f"regexp_replace({text}, '^{space}|{space}$', '', 'g')"


def h(seed, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(keys)}))"


def hnum(seed, *keys: str) -> str:
    return f"('0x' || substr({h(seed, *keys)}, 1, 15))::BIGINT"


def stride(seed, pool: str, *keys: str) -> str:
    usable = f"list_filter({PRIME_STRIDES}, lambda p: ({pool}) % p <> 0)"
    return f"{usable}[({hnum(f'{seed}-stride', *keys)} % len({usable}) + 1)::INT] % ({pool})"


def wrapped(payload: str, shape: str) -> str:
    return f"""CASE {shape} WHEN 0 THEN {payload} WHEN 1 THEN 'Let me think. assistantfinal ' || {payload}
      WHEN 2 THEN E'```json\\n' || {payload} || E'\\n```' WHEN 3 THEN replace({payload}, '"', '''')
      WHEN 4 THEN substr({payload}, 1, length({payload}) - 1) || ',}}'
      ELSE 'Here is my view: ' || {payload} || ' Hope it helps.' END"""


VIEWS = {
    "posts": 'SELECT doc_id AS post_id, source AS "user", text AS tweet, doc_id AS ord FROM documents',
    "posts_wide": """SELECT event_id AS post_id, user_id::VARCHAR AS "user", event_type || ' ' || props AS tweet, event_id AS ord
      FROM events""",
    "user_counts": 'SELECT "user", count(*) AS n_posts, min(ord) AS first_ord FROM posts_wide GROUP BY "user"',
    "labelled": """SELECT *, ord % 3 <> 0 AS useful, CASE WHEN ord % 7 = 0 THEN 'N/A' ELSE
      upper(event_type[1]) || event_type[2:] || ' Fan; user of item ' || regexp_extract(tweet, '([0-9]+)', 1) || ' ;active' END AS info
      FROM (SELECT p.*, e.event_type FROM posts_wide p JOIN events e ON e.event_id = p.post_id)""",
    "profiles": """SELECT c_custkey AS ord, c_name AS user_id, c_custkey::VARCHAR AS "user",
      c_name || ' lives in ' || n_name || ' and follows ' || c_mktsegment AS user_profile
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "questions": """SELECT *, ord AS position FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord FROM (
      SELECT conv_id, turn, text AS question,
      lead(text) OVER w AS reference_ans, lead(role) OVER w AS next_role, role,
      ['Leisure', 'Ask_for_Advice', 'Seek_Creativity'][conv_id % 3 + 1] AS user_intent,
      CASE WHEN conv_id % 5 = 0 THEN 'ZH' ELSE 'EN' END AS language
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE role = 'user' AND next_role = 'assistant')""",
    "pool": f"""SELECT *, row_number() OVER (ORDER BY {h('pool', 'item_id')}, item_id) - 1 AS position FROM (
      SELECT p_partkey AS item_id, 'Title: ' || p_name || ', Year: ' || p_size AS item_description FROM part)""",
    "interest": f"""SELECT *, {wrapped('payload', 'shape')} AS response FROM (
      SELECT *, '{{"Justification": ' || CASE WHEN l_quantity = 1 THEN 'null' ELSE '"' || item_description || ' fits"' END
        || ', "IsInterested": ' || raw_label || '}}' AS payload FROM (
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE::VARCHAR,
        round(l_extendedprice * 100)::BIGINT) AS row_key, o_custkey::VARCHAR AS user_name, p_name AS item_description, l_quantity,
        (l_orderkey + l_linenumber) % 6 AS shape,
        (CASE l_returnflag WHEN 'A' THEN ['"YES"', 'true', '" yes "'] WHEN 'N' THEN ['"NO"', 'false', '"No"']
         ELSE ['"MAYBE"', '"UNSURE"', '1'] END)[l_linenumber % 3 + 1] AS raw_label
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey))""",
    "interest_clean": """SELECT row_key, user_name, item_description, item_description || ' fits' AS justification,
      CASE raw_label WHEN 'true' THEN 'YES' WHEN 'false' THEN 'NO' ELSE upper(trim(replace(raw_label, '"', ''))) END AS is_interested
      FROM interest WHERE shape NOT IN (3, 4) AND l_quantity <> 1 AND raw_label NOT IN ('"UNSURE"', '1')""",
    "order_questions": """SELECT o.*, qs.* FROM orders o JOIN questions qs
      ON o.o_orderkey % (SELECT count(*) FROM questions) = qs.position""",
    "answers": f"""SELECT o_orderkey AS ord, question, reference_ans AS reference_answer, user_intent AS intent, kind, o_orderpriority,
      CASE WHEN o_orderstatus = 'P' THEN NULL WHEN kind = 6 THEN
        'assistantanalysis weighing assistantanalysis  View ' || o_orderkey || ' in short: ' || o_orderpriority
        ELSE {wrapped('payload', 'kind')} END AS response FROM (
      SELECT *, o_orderkey % 7 AS kind, '{{"' || CASE WHEN o_orderkey % 2 = 0 THEN 'summary' ELSE 'other' END
        || '": "View ' || o_orderkey || ' on it."}}' AS payload FROM order_questions)""",
    "places": """SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ord) - 1 AS position FROM posts_wide""",
    "users": f"""SELECT "user", n_posts, row_number() OVER (ORDER BY {h('users', '"user"')}, "user") - 1 AS user_position
      FROM user_counts""",
    "people": 'SELECT ord AS profile_id, "user", user_profile FROM profiles',
    "positives": f"""SELECT profile_id, "user", post_id, tweet, rank FROM (
      SELECT post_id, tweet, "user", row_number() OVER (PARTITION BY "user" ORDER BY {h(SEED, 'post_id')}, post_id) AS rank
      FROM places WHERE position >= {EXCLUDE}) JOIN people USING ("user") WHERE rank <= {TOTAL // 2}""",
    "counted": """SELECT p.*, coalesce(n, 0) AS n_positive FROM people p LEFT JOIN
      (SELECT profile_id, count(*) AS n FROM positives GROUP BY 1) USING (profile_id)""",
    "blocks": f"""SELECT "user", n_posts, coalesce(sum(n_posts) OVER (ORDER BY {h('block', '"user"')}, "user"
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM user_counts""",
    "line": 'SELECT block + position AS place, post_id, "user" AS other, tweet FROM places JOIN blocks USING ("user")',
    "post_negatives": f"""SELECT profile_id, post_id, other, tweet FROM (
      SELECT profile_id, (block + own + (start + no * step) % (everything - own)) % everything AS place FROM (
      SELECT *, {hnum(SEED, 'profile_id')} AS start, {stride(SEED, 'everything - own', 'profile_id')} AS step,
        unnest(range(0, least({TOTAL} - n_positive, everything - own))) AS no FROM (
      SELECT c.profile_id, n_positive, coalesce(n_posts, 0) AS own, coalesce(block, 0) AS block,
        (SELECT sum(n_posts)::BIGINT FROM user_counts) AS everything
      FROM counted c LEFT JOIN blocks b ON b."user" = c."user"))) JOIN line USING (place)""",
    "yesno": """SELECT doc_id, CASE WHEN text LIKE '%YES%' AND text NOT LIKE '%NO%' THEN 'YES'
        WHEN text LIKE '%NO%' AND text NOT LIKE '%YES%' THEN 'NO' END AS said, target FROM (
      SELECT doc_id, upper((['YES', ' no.', 'yes and no', 'I cannot say', ' Yes', 'I know it'])[n_chars % 6 + 1]) AS text,
        CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS target FROM documents JOIN labels USING (doc_id))""",
    "ranking": """SELECT o_orderkey, o_orderpriority, candidates, candidates[o_custkey % 12 + 1] AS target FROM (
      SELECT *, list_transform(range(0, 12), lambda i: 'item ' || (o_orderkey * 7 + i * 5) % 97 || ' ' || o_orderstatus) AS candidates
      FROM orders)""",
    "by_k": r"""SELECT question, intent, reference_answer, n_answers, k, coalesce(list_transform(list_slice(answers, 1, k),
        lambda a: CASE WHEN k > 5 AND length(a) > 20 THEN substr(a, 1, 20) || '...' ELSE a END), []) AS used
      FROM (SELECT question, arg_min(intent, ord) AS intent, arg_min(reference_answer, ord) AS reference_answer,
        count(response) AS n_answers, list(trim(regexp_replace(response, '^.*assistantanalysis', '', 's')) ORDER BY ord)
          FILTER (WHERE response IS NOT NULL) AS answers FROM answers GROUP BY question)
      CROSS JOIN (SELECT unnest([1, 5, 10]) AS k)""",
    "pairs": f"""SELECT user_name AS user_id, length_drawn AS history_length, items[2:length_drawn + 1] AS history,
      unnest([items[1], negative]) AS item, unnest(['YES', 'NO']) AS answer FROM (
      SELECT *, 1 + {hnum(f'{SEED}-length', 'user_name')} % least(100, n_yes - 1) AS length_drawn FROM (
      SELECT user_name, count(*) FILTER (WHERE is_interested = 'YES') AS n_yes, count(*) FILTER (WHERE is_interested = 'NO') AS n_no,
        list(item_description ORDER BY {h(SEED, 'row_key')}) FILTER (WHERE is_interested = 'YES') AS items,
        arg_min(item_description, {h(SEED, 'row_key')}) FILTER (WHERE is_interested = 'NO') AS negative
      FROM interest_clean GROUP BY user_name) WHERE n_yes >= 2 AND n_no > 0)""",
}

RATES = """count(*) AS num_samples, count(*) FILTER (WHERE said = 'YES' AND target = 'YES') AS true_positives,
  count(*) FILTER (WHERE said = 'YES' AND target <> 'YES') AS false_positives,
  count(*) FILTER (WHERE said = 'NO' AND target = 'NO') AS true_negatives,
  count(*) FILTER (WHERE said = 'NO' AND target <> 'NO') AS false_negatives, count(said) AS valid"""


def rates(by: str = "") -> str:
    """Confusion counts and rates of the yesno view."""
    listed = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    f1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END"
    return f"""SELECT {listed} num_samples, true_positives, false_positives, true_negatives, false_negatives,
      round(accuracy, 6) AS accuracy, round(valid_rate, 6) AS valid_response_rate, round(p, 6) AS precision, round(r, 6) AS recall,
      round({f1}, 6) AS f1_score FROM (SELECT *,
      CASE WHEN valid > 0 THEN (true_positives + true_negatives) / valid ELSE 0.0 END AS accuracy,
      CASE WHEN num_samples > 0 THEN valid / num_samples ELSE 0.0 END AS valid_rate,
      CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS p,
      CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS r
      FROM (SELECT {listed} {RATES} FROM said {group}))"""


def order_of(view: str) -> list[str]:
    """A view behind the views it names."""
    import re
    before = [v for v in VIEWS if v != view and re.search(rf'(FROM|JOIN)\s+\(?{v}\b', VIEWS[view])]
    out = []
    for v in before:
        out += [x for x in order_of(v) if x not in out]
    return out + [view]


def select(views: str, body: str, **local: str) -> str:
    """``body`` over the named views and some local ones."""
    names: list[str] = []
    for view in views.split():
        names += [v for v in order_of(view) if v not in names]
    parts = [f"{v} AS ({VIEWS[v]})" for v in names] + [f"{v} AS ({sql})" for v, sql in local.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def batches(rows: str, keys: str, number: str) -> str:
    """Numbered posts in batches, as a numbered list."""
    return f"""SELECT {keys}, {number} // {PER_QUERY} AS batch, count(*) AS n_tweets,
      string_agg('Tweet ' || ({number} % {PER_QUERY} + 1) || ': ' || tweet, E'\\n' ORDER BY {number}) AS listed
      FROM {rows} GROUP BY ALL"""


AUTHOR_PROMPT = fill(templates.AUTHOR, USER_NAME='p."user"', USER_PROFILE="p.user_profile", TWEETS="listed")
USEFUL_PROMPT = fill(templates.USEFUL_POST, USER_NAME='"user"', TWEET="tweet")
TOPIC, ITEM_TYPE = DATASET_TOPICS["netflix"]
PYTHON_LITERAL = "raw_label NOT IN ('true', 'false') AND l_quantity <> 1"  # single quotes leave JSON's true, false, null unread
LABEL = "replace(raw_label, '\"', '')"

SETTINGS = [("small", 512, 1024), ("wide", 2048, 2048), ("long", 4096, 32768)]


def allowed(max_tokens: int, context: int) -> int:
    budget = min(4096, max(256, context // 8)) if max_tokens >= context else min(max_tokens, max(1, context - 1))
    return max(1, context - budget)


SCRUBBED = "tweet"
SCRUB_STEPS = []
for _kind, _pattern, _mark in SCRUB_PATTERNS:
    SCRUB_STEPS.append(f"len(regexp_extract_all({SCRUBBED}, {q(_pattern)}))::BIGINT AS n_{_kind}")
    SCRUBBED = f"regexp_replace({SCRUBBED}, {q(_pattern)}, {q(_mark)}, 'g')"

USER_NEGATIVES = f"""SELECT profile_id, other, n_positive, n_posts FROM (
  SELECT profile_id, n_positive, (own + 1 + (start + no * step) % others) % n_users AS user_position FROM (
  SELECT *, {hnum(SEED, 'profile_id')} AS start, {stride(SEED, 'others', 'profile_id')} AS step,
    unnest(range(0, least(({TOTAL} - n_positive) // {PER_QUERY}, others))) AS no FROM (
  SELECT c.profile_id, n_positive, coalesce(u.user_position, -1) AS own, n_users,
    n_users - CASE WHEN u."user" IS NULL THEN 0 ELSE 1 END AS others
  FROM counted c LEFT JOIN users u ON u."user" = c."user" CROSS JOIN (SELECT count(*) AS n_users FROM users))))
  JOIN (SELECT user_position, "user" AS other, n_posts FROM users) USING (user_position)"""


def posts_of_others(n: str, places: str) -> str:
    return f"""SELECT profile_id, other, post_no, post_id, tweet FROM (
      SELECT *, (start + post_no * step) % n_posts AS position FROM (
      SELECT *, {hnum(SEED, 'profile_id', 'other')} AS start, {stride(SEED, 'n_posts', 'profile_id', 'other')} AS step,
        unnest(range(0, least({n}, n_posts))) AS post_no FROM other_users))
      JOIN (SELECT "user" AS other, position, post_id, tweet FROM {places}) USING (other, position)"""


ORACLES = {
    "posts_normalised": select("posts", "SELECT * FROM posts"),
    "posts_copied": 'SELECT doc_id AS post_id, source AS author, text, source AS "user", text AS tweet FROM documents',
    "item_display": """
      SELECT p_partkey AS item_id, 'netflix' AS dataset, concat_ws(', ', 'Title: ' || p_name,
        CASE WHEN p_size % 10 <> 0 THEN 'Year: ' || p_size END) AS item_description FROM part
      UNION ALL SELECT p_partkey, 'pens', concat_ws(', ', 'Title: ' || p_name, CASE WHEN p_type <> 'ECONOMY' THEN 'Category: ' || p_type END) FROM part
      UNION ALL SELECT p_partkey, 'books', p_name FROM part
      UNION ALL SELECT p_partkey, 'hm', p_brand FROM part WHERE p_brand <> 'Brand#2'""",
    "user_post_counts": select("user_counts", "SELECT * FROM user_counts"),
    "profile_prompts": select("user_counts", f"""SELECT "user", post_id, rank, {USEFUL_PROMPT} AS prompt FROM (
      SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ord) AS rank FROM posts_wide WHERE "user" IN (
        SELECT "user" FROM user_counts WHERE n_posts > 60 ORDER BY {h(SEED, '"user"')}, "user" LIMIT 20)) WHERE rank <= 50"""),
    "user_shard": select("user_counts", f"""SELECT "user", n_posts FROM user_counts ORDER BY {h(SEED, '"user"')}, "user"
      LIMIT 25 OFFSET 40"""),
    "question_filter_sample": select("questions", f"""SELECT ord, question FROM questions
      WHERE user_intent = 'Leisure' AND language = 'EN' ORDER BY {h(SEED, 'ord')}, ord LIMIT 40"""),
    "reply_parse_stage": select("interest", f"""SELECT shape, stage, CASE WHEN stage <> 'raw' THEN {LABEL} END AS label, count(*) AS n FROM (
      SELECT *, CASE shape WHEN 2 THEN 'fence' WHEN 5 THEN 'balanced'
        WHEN 3 THEN CASE WHEN {PYTHON_LITERAL} THEN 'whole' ELSE 'raw' END ELSE 'whole' END AS stage FROM interest) GROUP BY ALL"""),
    "reply_fields": select("interest", f"""SELECT row_key,
      CASE WHEN shape NOT IN (3, 4) THEN {LABEL} END AS last_braces,
      CASE WHEN shape IN (0, 1) THEN {LABEL} END AS from_brace,
      CASE WHEN shape IN (0, 1) THEN {LABEL} END AS final_channel,
      CASE WHEN shape = 0 AND l_quantity <> 1 THEN item_description || ' fits' ELSE 'N/A' END AS batch_justification,
      CASE WHEN shape = 0 THEN {LABEL} ELSE 'N/A' END AS batch_isinterested FROM interest"""),
    "prompt_length_guard": select("posts", f"""SELECT post_id, model, n_tokens, allowed_tokens, CASE WHEN n_tokens > allowed_tokens THEN
      '[SKIPPED: Prompt too long for configured context window (prompt_tokens=' || n_tokens || ', allowed_input_tokens=' || allowed_tokens || ')]'
      END AS skip_reply FROM (SELECT post_id, model, ceil(length({USEFUL_PROMPT}) / 4)::BIGINT AS n_tokens, allowed_tokens::BIGINT AS allowed_tokens
      FROM posts CROSS JOIN (VALUES {', '.join(f"('{m}', {allowed(t, x)})" for m, t, x in SETTINGS)}) s(model, allowed_tokens))"""),
    "chat_messages": select("questions", f"""SELECT ord, CASE WHEN kind < 2 THEN 2 WHEN kind = 2 THEN 1
        WHEN cut > 0 AND head <> '' AND tail <> '' THEN 2 ELSE 1 END::BIGINT AS n_messages,
      CASE WHEN kind < 2 OR (kind = 3 AND cut > 0 AND head <> '' AND tail <> '') THEN 'system' ELSE 'user' END AS first_role,
      CASE kind WHEN 0 THEN 'Answer for the user.' WHEN 1 THEN 'Answer.' WHEN 2 THEN E'\\n' || question ELSE
        CASE WHEN cut > 0 AND head <> '' AND tail <> '' THEN head ELSE question END END AS first_content,
      CASE kind WHEN 0 THEN {strip("'User Profile: likes tea' || E'\\nQuestion: ' || question")} WHEN 1 THEN {strip("'Question: ' || question")}
        WHEN 2 THEN E'\\n' || question ELSE CASE WHEN cut > 0 AND head <> '' AND tail <> '' THEN tail ELSE question END END AS last_content
      FROM (SELECT *, ord % 4 AS kind, strpos(question, E'\\n') AS cut, {strip("split_part(question, E'\\n', 1)")} AS head,
        {strip("substr(question, strpos(question, E'\\n') + 1)")} AS tail FROM questions)"""),
    "batch_inference_stub": select("posts", f"""SELECT prompt_id, CASE WHEN n % 7 = 0 THEN
        '[ERROR: Generation skipped due to recoverable vLLM error]' WHEN n % 11 = 0 THEN '[ERROR: Empty response after inference]'
        ELSE '{{"UsefulInformation": ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS response,
      CASE WHEN n % 7 = 0 THEN 'error' WHEN n % 11 = 0 THEN 'empty' ELSE 'ok' END AS status
      FROM (SELECT post_id AS prompt_id, length({USEFUL_PROMPT}) AS n FROM posts)"""),
    "resume_pending": select("posts", """SELECT post_id AS prompt_id, "user" FROM posts WHERE post_id NOT IN (SELECT doc_id FROM labels)"""),
    "post_batches": select("user_counts", f"""SELECT "user", batch, n_tweets, {fill(templates.USEFUL_POSTS, USER_NAME='"user"', USER_TWEETS='listed')} AS prompt
      FROM (SELECT "user", (rank - 1) // 5 AS batch, count(*) AS n_tweets,
        string_agg('User Tweet ' || ((rank - 1) % 5 + 1) || ': ' || tweet || E'\\n', '' ORDER BY rank) AS listed FROM (
      SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ord) AS rank FROM posts_wide WHERE "user" IN (
        SELECT "user" FROM user_counts WHERE n_posts >= 60 AND n_posts >= 5 ORDER BY first_ord LIMIT 20)) WHERE rank <= 50 GROUP BY ALL)"""),
    "user_descriptions": select("labelled", """SELECT "user", 0::BIGINT AS page, string_agg(tag, '; ' ORDER BY tag) AS descriptions, count(*) AS n_tags
      FROM (SELECT DISTINCT "user", lower(trim(part)) AS tag FROM (SELECT "user", unnest(string_split(info, ';')) AS part FROM labelled WHERE useful))
      WHERE tag NOT IN ('', 'n/a') GROUP BY "user" """),
    "profile_scrub": select("posts", f"SELECT post_id, {SCRUBBED} AS scrubbed, {', '.join(SCRUB_STEPS)} FROM posts"),
    "constant_prompts": f"""SELECT position AS prompt_id, {q(templates.FICTIONAL_PROFILE)} AS prompt, position + {SEED} AS seed
      FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer)""",
    "profile_item_pairs": select("profiles pool", f"""SELECT user_id, item_no, item_description, {fill(
        templates.INTEREST, ITEM_DESCRIPTION='item_description', USER_NAME='user_id', USER_PROFILE='user_profile',
        ITEM_TYPE=q(ITEM_TYPE), TOPIC=q(TOPIC))} AS prompt FROM (
      SELECT *, (start + item_no * step) % m AS position FROM (
      SELECT user_id, user_profile, m, {hnum(SEED, 'user_id')} AS start, {stride(SEED, 'm', 'user_id')} AS step,
        unnest(range(0, least(20, m))) AS item_no FROM profiles CROSS JOIN (SELECT count(*) AS m FROM pool)))
      JOIN pool USING (position)"""),
    "profile_question_pairs": select("profiles questions", f"""SELECT user_id, position, {fill(
        templates.PERSONAL_ANSWER, USER_PROFILE='user_profile', QUESTION='question', REFERENCE_ANSWER='reference_ans')} AS prompt
      FROM profiles p CROSS JOIN questions qs WHERE p.ord >= 10 AND position < 10"""),
    "question_profile_pairs": select("profiles questions", f"""SELECT ord, user_id, {fill(
        templates.QUESTION_FOR_USER, USER_NAME='user_id', USER_PROFILE='user_profile', QUESTION='question')} AS prompt
      FROM (SELECT * FROM questions WHERE user_intent = 'Leisure' AND language = 'EN' ORDER BY {h(SEED, 'ord')}, ord LIMIT 50)
      CROSS JOIN (SELECT user_id, user_profile FROM profiles ORDER BY {h(SEED, 'user_id')}, user_id LIMIT 20)"""),
    "synthetic_histories": select("pool", f"""SELECT history_id, history_size, candidate, {fill(
        templates.HISTORY, TOPIC=q(TOPIC), USER_INTERACTIONS='listed', CANDIDATE_ITEM='candidate')} AS prompt FROM (
      SELECT history_id, history_size, max(item_description) FILTER (WHERE no = history_size) AS candidate,
        list(item_description) FILTER (WHERE no < history_size) AS history,
        string_agg('(' || (no + 1) || ') ' || item_description, E'\\n' ORDER BY no) FILTER (WHERE no < history_size) AS listed FROM (
      SELECT *, (start + no * step) % m AS position FROM (
      SELECT *, {hnum(SEED, 'history_id')} AS start, {stride(SEED, 'm', 'history_id')} AS step, unnest(range(0, history_size + 1)) AS no FROM (
      SELECT c_custkey AS history_id, m, least(2 + {hnum(f'{SEED}-size', 'c_custkey')} % 38, m - 1) AS history_size
      FROM customer CROSS JOIN (SELECT count(*) AS m FROM pool)))) JOIN pool USING (position) GROUP BY ALL)
      WHERE NOT list_contains(history, candidate)"""),
    "finetuned_prompts": select("questions", "SELECT ord, 'You serve ' || user_intent || E'\\n' || question AS prompt FROM questions"),
    "interest_clean": select("interest_clean", "SELECT * FROM interest_clean"),
    "sft_pairs": select("pairs", f"""SELECT user_id, 'netflix' AS dataset, 'base' AS source_variant, history_length, item AS candidate_item,
      replace(replace({q(templates.RECOMMENDER_USER)}, '{{history}}', array_to_string(list_transform(history, lambda x, i: '(' || i || ') ' || x), E'\\n')),
        '{{candidate}}', item) AS question, answer, {q(templates.RECOMMENDER_SYSTEM)} AS system_prompt FROM pairs"""),
    "sft_split": select("pairs", f"""SELECT user_id, answer,
      CASE WHEN row_number() OVER (ORDER BY {h(SEED, 'user_id', 'answer')}) <= round_even(0.9 * count(*) OVER (), 0) THEN 'train' ELSE 'test' END AS split,
      CASE WHEN dense_rank() OVER (ORDER BY {h(SEED, 'user_id')}) <= round_even(0.9 * (SELECT count(DISTINCT user_id) FROM pairs), 0)
        THEN 'train' ELSE 'test' END AS user_split FROM pairs"""),
    "finetuned_sample": select("questions", f"""SELECT ord, 'You serve ' || user_intent || E'\\n' || question AS prompt
      FROM questions ORDER BY {h(SEED, 'ord')}, ord LIMIT 25"""),
    "sft_cut": f"""SELECT doc_id, text AS question, lang AS answer FROM documents WHERE text <> '' AND lang <> ''
      ORDER BY {h(SEED, 'doc_id')}, doc_id LIMIT 150""",
    "default_topic_prompts": select("pool", f"""SELECT item_id, {fill(
        templates.INTEREST, ITEM_DESCRIPTION='item_description', USER_NAME=q('u'), USER_PROFILE=q('p'),
        ITEM_TYPE=q(DEFAULT_ITEM_TYPE), TOPIC=q(DEFAULT_TOPIC))} AS prompt FROM pool"""),
    "repeated_candidates": select("ranking", """SELECT o_orderkey, candidates[-1] || '|' || candidates[-1] AS taken, 2::BIGINT AS n_prompts
      FROM ranking"""),
    "sft_format": f"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN E'Name the language.\\n\\n' ELSE '' END || {strip('text')} || E'\\n\\n' AS prompt,
      'lang ' || lang AS completion, CASE WHEN doc_id % 3 = 2 THEN 3 ELSE 2 END::BIGINT AS n_messages,
      CASE WHEN doc_id % 3 = 2 THEN 'system: Name the language. |' ELSE '' END || 'user:' || text || '|assistant:  lang ' || lang || E'\\n' AS chat
      FROM (SELECT * FROM documents WHERE doc_id % 10 <> 3 AND text <> '' ORDER BY {h(SEED, 'doc_id')} LIMIT 10000)""",
    "author_self_positives": select("positives", f"""SELECT profile_id, batch, n_tweets, {AUTHOR_PROMPT} AS prompt FROM batched
      JOIN people p USING (profile_id)""", batched=batches("(SELECT *, rank - 1 AS no FROM positives)", "profile_id", "no")),
    "author_user_negatives": select("counted users", f"""SELECT profile_id, other, batch, truth, n_tweets, {AUTHOR_PROMPT} AS prompt FROM (
      SELECT *, true AS truth FROM own UNION ALL SELECT *, false AS truth FROM theirs) JOIN people p USING (profile_id)""",
        other_users=USER_NEGATIVES, drawn=posts_of_others(str(PER_QUERY), "places"),
        own=batches('(SELECT *, "user" AS other, rank - 1 AS no FROM positives)', "profile_id, other", "no"),
        theirs=batches("drawn", "profile_id, other", "post_no")),
    "author_post_negatives": select("post_negatives", f"""SELECT profile_id, post_id, other, 1::BIGINT AS n_tweets, {AUTHOR_PROMPT} AS prompt
      FROM (SELECT *, 'Tweet 1: ' || tweet AS listed FROM post_negatives) JOIN people p USING (profile_id)"""),
    "author_useful_only": select("people places labelled", f"""SELECT profile_id, other, post_id, p."user" = other AS truth, x.tweet, l.info AS user_information FROM (
      SELECT profile_id, "user" AS other, post_id, tweet FROM positives UNION ALL SELECT profile_id, other, post_id, tweet FROM drawn) x
      JOIN people p USING (profile_id) JOIN labelled l USING (post_id)""",
        users=f"""SELECT "user", coalesce(n, 0) AS n_posts, row_number() OVER (ORDER BY {h('users', '"user"')}, "user") - 1 AS user_position
          FROM (SELECT DISTINCT "user" FROM labelled) LEFT JOIN (SELECT "user", count(*) AS n FROM labelled WHERE useful GROUP BY 1) USING ("user")""",
        useful_places="""SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ord) - 1 AS position FROM labelled WHERE useful""",
        known='SELECT * FROM people WHERE "user" IN (SELECT "user" FROM labelled)',
        positives=f"""SELECT profile_id, "user", post_id, tweet FROM (
          SELECT pl.*, row_number() OVER (PARTITION BY "user" ORDER BY {h(SEED, 'post_id')}, post_id) AS rank FROM places pl
          WHERE position >= {EXCLUDE} AND ord % 3 <> 0) JOIN known USING ("user") WHERE rank <= {TOTAL // 2}""",
        counted="""SELECT k.*, coalesce(n, 0) AS n_positive FROM known k LEFT JOIN
          (SELECT profile_id, count(*) AS n FROM positives GROUP BY 1) USING (profile_id)""",
        other_users=USER_NEGATIVES, drawn=posts_of_others(f"{TOTAL} - n_positive", "useful_places")),
    "author_accuracy": select("positives post_negatives", """SELECT truth, count(*) AS num_samples, count(said) AS num_valid,
      count(*) FILTER (WHERE said = truth) AS num_correct, round(count(*) FILTER (WHERE said = truth) / count(said), 6) AS accuracy FROM (
      SELECT truth, CASE WHEN lot = 0 THEN NULL ELSE lot < 6 END AS said FROM (SELECT *, (profile_id * 31 + post_id * 17) % 10 AS lot FROM (
      SELECT profile_id, post_id, true AS truth FROM positives UNION ALL SELECT profile_id, post_id, false FROM post_negatives))) GROUP BY truth"""),
    "profile_qa_accuracy": f"""SELECT c_mktsegment, count(*) AS num_samples, count(*) AS num_valid, count(*) FILTER (WHERE said = answer) AS num_correct,
      round(count(*) FILTER (WHERE said = answer) / count(*), 6) AS accuracy FROM (
      SELECT c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'No' ELSE 'Yes' END AS said, CASE WHEN c_acctbal > 5000 THEN 'Yes' ELSE 'No' END AS answer
      FROM (SELECT * FROM customer ORDER BY {h(SEED, 'c_custkey')}, c_custkey LIMIT 1000)) GROUP BY 1""",
    "perspective_first_n": select("profiles questions", f"""SELECT user_id, qs.ord, user_intent AS intent, {fill(
        templates.PERSPECTIVE, USER_PROFILE='user_profile', QUESTION='question')} AS prompt
      FROM questions qs CROSS JOIN (SELECT user_id, user_profile FROM profiles ORDER BY ord LIMIT 10)"""),
    "perspective_related": select("order_questions profiles", f"""SELECT qs.ord, user_profile, n_related, {fill(
        templates.PERSPECTIVE, USER_PROFILE='user_profile', QUESTION='question')} AS prompt FROM (
      SELECT question, user_profile, count(*) OVER (PARTITION BY question) AS n_related,
        row_number() OVER (PARTITION BY question ORDER BY {h(SEED, 'question', 'user_profile')}, user_profile) AS rank FROM (
      SELECT DISTINCT question, user_profile FROM order_questions JOIN profiles p ON p.ord = o_custkey WHERE o_orderstatus <> 'F'))
      JOIN questions qs USING (question) WHERE n_related > 20 AND rank <= 20"""),
    "perspective_repeat": select("questions", f"""SELECT ord, sample_idx, {SEED} + sample_idx * (SELECT count(*) FROM questions) + position AS seed,
      0.7::DOUBLE AS sampling_temperature, {fill(templates.QUESTION, QUESTION='question')} AS prompt
      FROM questions CROSS JOIN (SELECT unnest(range(0, 5)) AS sample_idx)"""),
    "answers_by_k": select("by_k", """SELECT question, intent, reference_answer, n_answers, k::BIGINT AS k, len(used)::BIGINT AS n_used,
      array_to_string(used, E'\\n') AS answers FROM by_k"""),
    "answers_pass_through": select("by_k", f"""SELECT question, k::BIGINT AS k, prompt, CASE WHEN direct THEN used[1] ELSE 'merged ' || length(prompt) END AS response,
      CASE WHEN direct THEN 'direct' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN direct THEN {q(PASS_THROUGH_PROMPT)} ELSE {fill(
        templates.SUMMARY, QUESTION='question', ANSWERS="array_to_string(used, E'\\n')")} END AS prompt
      FROM (SELECT *, k = 1 AND len(used) > 0 AS direct FROM by_k))"""),
    "rubric_prompts": select("answers", f"""SELECT ord, intent, {fill(
        templates.GRADE_BY_REFERENCE, GRADING_CRITERIA='rubric', QUESTION='question',
        TEST_ANSWER="CASE WHEN kind = 6 THEN trim(regexp_replace(response, '^.*assistantanalysis', '', 's')) ELSE response END",
        GPT4_ANSWER='reference_answer')} AS prompt FROM answers JOIN rubrics USING (intent)
      WHERE response IS NOT NULL AND intent IN ('Leisure', 'Seek_Creativity')""",
        rubrics="SELECT * FROM (VALUES " + ", ".join(f"({q(i)}, {q(rubric_text(i, d))})" for i, d in RUBRIC_DIMENSIONS.items()) + ") r(intent, rubric)"),
    "scoring_text": select("answers", """SELECT ord, CASE WHEN kind = 6 THEN 'View ' || ord || ' in short: ' || o_orderpriority
      WHEN ord % 2 = 0 THEN 'View ' || ord || ' on it.' ELSE '' END AS scoring_text FROM answers WHERE response IS NOT NULL"""),
    "judge_scores": select("answers", """SELECT k, coalesce(intent, 'Avg.') AS intent, round(avg(overall), 6) AS mean_score, count(overall) AS n_scored FROM (
      SELECT [1, 5, 10][ord % 3 + 1]::BIGINT AS k, intent, CASE WHEN ord % 12 BETWEEN 1 AND 10 THEN ord % 12 END AS overall FROM answers)
      GROUP BY GROUPING SETS ((k, intent), (k))"""),
    "yesno_metrics": select("yesno", rates(), said="SELECT * FROM yesno"),
    "item_matches": select("ranking", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN (SELECT first(x ORDER BY i) FROM (
        SELECT unnest(candidates) AS x, generate_subscripts(candidates, 1) AS i) WHERE lower(x) = lower(candidates[4]))
      WHEN o_orderkey % 4 = 2 THEN list_filter(candidates, lambda x: contains(x, trim(substr(candidates[4], 2, 5))))[1] END AS item FROM ranking"""),
    "attached_replies": select("posts", f"""SELECT prompt_id, "user", n_chars, CASE WHEN n % 7 = 0 THEN
        '[ERROR: Generation skipped due to recoverable vLLM error]' WHEN n % 11 = 0 THEN '[ERROR: Empty response after inference]'
        ELSE '{{"UsefulInformation": ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}}' END AS response,
      CASE WHEN n % 7 = 0 THEN 'error' WHEN n % 11 = 0 THEN 'empty' ELSE 'ok' END AS status
      FROM (SELECT post_id AS prompt_id, "user", length(tweet) AS n_chars, length({USEFUL_PROMPT}) AS n FROM posts)"""),
    "results_written": select("yesno", "SELECT doc_id, md5(text) AS digest, coalesce(said, 'none') AS said FROM yesno JOIN documents USING (doc_id)"),
    "splits_written": select("pairs", f"""SELECT user_id, answer,
      CASE WHEN row_number() OVER (ORDER BY {h(SEED, 'user_id', 'answer')}) <= round_even(0.9 * count(*) OVER (), 0) THEN 'train' ELSE 'test' END AS split
      FROM pairs"""),
    "first_profiles": select("profiles", "SELECT ord, user_id, user_profile FROM profiles ORDER BY ord LIMIT 30"),
    "evaluation_records": select("yesno", "SELECT doc_id, source, said AS prediction, target, said = target AS is_right FROM yesno JOIN documents USING (doc_id)"),
    "evaluation_totals": select("yesno", rates("source, is_total"), said="""SELECT y.*, source, false AS is_total FROM yesno y JOIN documents USING (doc_id)
      UNION ALL SELECT *, NULL, true FROM yesno"""),
    "hit_rates": select("ranking", """SELECT task, count(*) AS num_samples, round(avg(length(response)), 6) AS avg_response_length,
      round(coalesce(avg(list_contains(candidates[1:5], target)::INT) FILTER (WHERE lot > 0), 0), 6) AS hit_rate_at_top_5,
      round(coalesce(avg(list_contains(candidates[1:10], target)::INT) FILTER (WHERE lot > 0), 0), 6) AS hit_rate_at_top_10,
      round(avg((lot > 0)::INT), 6) AS valid_response_rate,
      count(*) FILTER (WHERE list_filter(candidates, lambda x: lower(x) = lower(candidates[3]))[1] = candidates[3]) AS n_matched FROM (
      SELECT *, CASE lot WHEN 0 THEN 'nothing fits' WHEN 1 THEN '> thinking [x] assistantfinal ' || listed ELSE listed END AS response FROM (
      SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'direct' ELSE 'sequential' END AS task, o_orderkey % 5 AS lot,
        '[''' || array_to_string(candidates[1:10], ''', ''') || ''']' AS listed FROM ranking)) GROUP BY task"""),
    "iterative_hits": select("ranking", """SELECT interaction_history, count(*) AS num_samples,
      round(avg(list_contains(taken[1:5], target)::INT), 6) AS hit_rate_at_top_5, round(avg(list_contains(taken, target)::INT), 6) AS hit_rate_at_top_10,
      round(avg(len(taken)), 6) AS avg_recommendations_per_sample FROM (
      SELECT o_orderpriority AS interaction_history, target, list_reverse(candidates)[1:10] AS taken FROM ranking) GROUP BY 1"""),
    "rating_error": """SELECT l_returnflag, count(*) AS num_samples, count(stars) AS num_valid, round(avg(abs(target - stars)), 6) AS average_prediction_error,
      round(sum(abs(target - stars) * share) / sum(share) FILTER (WHERE stars IS NOT NULL), 6) AS weighted_average_prediction_error FROM (
      SELECT l_returnflag, l_partkey % 5 + 1 AS target, CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity % 5 + 1 END AS stars,
        CASE WHEN l_linenumber % 4 <> 0 THEN trunc(l_discount * 1000) END AS share FROM lineitem) GROUP BY 1""",
    "variant_f1": select("yesno", """SELECT *, f1_score = max(f1_score) OVER (PARTITION BY model, dataset) AS is_best
      FROM (SELECT model, variant, dataset, f1_score FROM scores)""",
        said="""SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model, (doc_id % 3)::VARCHAR AS variant,
          CASE WHEN doc_id % 5 < 3 THEN 'books' ELSE 'news' END AS dataset FROM yesno""", scores=rates("model, variant, dataset")),
    "metrics_history": select("yesno", rates("step") + " ORDER BY step", said="SELECT *, doc_id % 4 * 100 AS step FROM yesno"),
    "semantic_profiles": """SELECT question_id, profile_id, round(similarity, 6) AS similarity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, profile_id) AS rank FROM (
      SELECT a.vec_id AS question_id, b.vec_id AS profile_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity
      FROM embeddings a JOIN embeddings b ON a.label < 5 AND b.label >= 5)) WHERE rank <= 5""",
    "profiles_from_csv": "SELECT doc_id AS user_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents",
    "questions_from_json": select("ranking", """SELECT o_orderkey, target FROM ranking WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0"""),
    "semantic_recall": """SELECT n_questions, n_questions * least(5, n_profiles) AS n_pairs, true AS recall_reached FROM
      (SELECT count(*) FILTER (label < 5) AS n_questions, count(*) FILTER (label >= 5) AS n_profiles FROM embeddings)""",
}
