"""Registered queries of the data-quality operators (problems 1 to 3), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import quarantine as QR
from lexloom.operators import redelivery as RD
from lexloom.operators import relationalize as RL
from lexloom.plans.data import table
from lexloom.plans.oracles import JSON
from lexloom.sources import tweets as J

Q: dict = {}


def q(f):
    Q[f.__name__] = f
    return f


def _records(spark, d):
    r = J.parse_records(table(spark, d, "raw_tweet").select("line_no", "line")).drop("line")
    return r.filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec"))


def _tables(spark, d):
    return RL.relationalize(_records(spark, d), keep=("user",))[1]  # authors are wanted as a table of their own


@q
def p1_found(spark, d):
    t = _tables(spark, d)
    return t["entities_hashtags"].filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?U)^[\s\p{Z}]*\z")).select("line_no", "nest_level", "ord_no", F.col("text").alias("tag"))


@q
def p1_tweets(spark, d):
    t = _tables(spark, d)
    return t["tweet"].select("line_no", "nest_level", "row_key", "parent_key", "id_str", "created_at", "lang", "text", "retweet_count", "favorite_count")


@q
def p1_users(spark, d):
    t = _tables(spark, d)
    return t["user"].select("line_no", "nest_level", "parent_key", "screen_name", "followers_count", "friends_count", "location_name")


@q
def p1_mentions(spark, d):
    t = _tables(spark, d)
    return t["entities_user_mentions"].select("line_no", "nest_level", "parent_key", "ord_no", "screen_name")


@q
def p1_quotes(spark, d):
    """Records that quote and repeat another one: two recursive keys, found in the schema graph."""
    wrap = F.concat(F.lit('{"id_str":"q'), "line_no", F.lit('","text":"t","lang":"x","quoted_status":'), "line", F.lit(',"retweeted_status":'), "line", F.lit("}"))
    r = _lines(spark, d).select("line_no", wrap.alias("line"))
    return RL.relationalize(J.parse_records(r).drop("line"), keep=("user",))[1]["tweet"].select("line_no", "nest_level", "row_key", "parent_key", "id_str")


def _lines(spark, d):
    r = J.parse_records(table(spark, d, "raw_tweet").select("line_no", "line"))
    return r.filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec")).select("line_no", "line")


def _extract(spark, d):
    return table(spark, d, "extract_line").select("line_no", "line"), QR.rule_table(spark)


@q
def p2_found(spark, d):
    return QR.failing(*_extract(spark, d))


@q
def p2_clean(spark, d):
    return QR.clean(*_extract(spark, d)).withColumn("created_at", F.unix_millis("created_at"))


def _messages(spark, d, *payload):
    r = J.parse_records(table(spark, d, "raw_tweet").select("line_no", "batch_id", "received_at", "line"))
    r = r.filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec"))
    return r.select("line_no", "batch_id", "received_at", J.scalar_text("rec", "id_str").alias("id"), *payload)


@q
def p3_found(spark, d):
    return RD.surplus(*RD.deduplicate(_messages(spark, d)))


@q
def p3_messages(spark, d):
    store, _ = RD.deduplicate(_messages(spark, d, "line"), payload=["line"])
    return store.read().select("id", "line_no", "line")


_LEVELS = (
    "WITH RECURSIVE "
    + JSON.strip()
    + """,
lv AS (SELECT line_no, 0 AS nest_level, j FROM j1 WHERE j IS NOT NULL AND json_type(j, '$.delete') IS NULL
  UNION ALL SELECT line_no, nest_level + 1, json_extract(j, '$.retweeted_status') FROM lv WHERE json_type(j, '$.retweeted_status') = 'OBJECT')"""
)
_KEYS = "line_no, nest_level, concat_ws(':', line_no, nest_level)"


def _entries(key: str) -> str:
    return f""",
a AS (SELECT line_no, nest_level, CASE json_type(j, '$.entities.{key}') WHEN 'ARRAY' THEN CAST(json_extract(j, '$.entities.{key}') AS JSON[]) WHEN 'OBJECT' THEN [json_extract(j, '$.entities.{key}')] ELSE [] END AS hs FROM lv),
b AS (SELECT line_no, nest_level, generate_subscripts(hs, 1) - 1 AS ord_no, unnest(hs) AS h FROM a)"""


_FIELD = '"[^"]*(?:""[^"]*)*"|[^\\t"][^\\t]*|'
_CELLS = f"""l AS (SELECT line_no, line, regexp_full_match(line, '(?s)(?:{_FIELD})(?:\\t(?:{_FIELD}))*') AS quoted FROM extract_line),
c AS (SELECT line_no, quoted, [CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN regexp_extract_all(line || chr(9), '({_FIELD})\\t', 1)] AS f FROM l),
v AS (SELECT line_no, f, CASE WHEN NOT quoted THEN 'quoting' WHEN line_is_null OR len(f) <> 8 THEN 'columns'
  WHEN NOT (regexp_full_match(f[1], '0*[1-9][0-9]*') AND list_bool_and([regexp_full_match(x, '[0-9]+') FOR x IN f[4:7]])
    AND regexp_full_match(f[3], '(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9][0-9] ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9] [+-][0-9]{{4}} [0-9]{{4}}')
    AND try_strptime(regexp_replace(substr(f[3], 5), ' [+-][0-9]{{4}} ', ' '), '%b %d %H:%M:%S %Y') IS NOT NULL
    AND NOT regexp_full_match(f[2], '[\\s\\p{{Z}}]*') AND NOT regexp_full_match(f[8], '[\\s\\p{{Z}}]*') AND NOT contains(f[8], chr(65533))) THEN 'value' END AS reason
  FROM (SELECT *, f IS NULL AS line_is_null FROM c))"""
_IDS = (
    JSON.strip()
    + """,
m AS (SELECT r.line_no, r.received_at, r.line, trim(json_extract_string(j, '$.id_str')) AS id FROM j1 JOIN raw_tweet r USING (line_no)
  WHERE j IS NOT NULL AND json_type(j, '$.delete') IS NULL AND json_type(j, '$.id_str') IN ('VARCHAR', 'UBIGINT', 'BIGINT')),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at NULLS LAST, line_no) AS rn FROM m WHERE id <> '')"""
)
SQL = {
    "p1_found": _LEVELS + _entries("hashtags") + " SELECT line_no, nest_level, CAST(ord_no AS INTEGER) AS ord_no, json_extract_string(h, '$.text') AS tag FROM b WHERE trim(json_extract_string(h, '$.text')) <> ''",
    "p1_tweets": _LEVELS + f" SELECT {_KEYS} AS row_key, CASE WHEN nest_level > 0 THEN concat_ws(':', line_no, nest_level - 1) END AS parent_key, json_extract_string(j, '$.id_str') AS id_str, json_extract_string(j, '$.created_at') AS created_at, json_extract_string(j, '$.lang') AS lang, json_extract_string(j, '$.text') AS text, CAST(json_extract_string(j, '$.retweet_count') AS BIGINT) AS retweet_count, CAST(json_extract_string(j, '$.favorite_count') AS BIGINT) AS favorite_count FROM lv",
    "p1_users": _LEVELS + f" SELECT {_KEYS} AS parent_key, json_extract_string(j, '$.user.screen_name') AS screen_name, CAST(json_extract_string(j, '$.user.followers_count') AS BIGINT) AS followers_count, CAST(json_extract_string(j, '$.user.friends_count') AS BIGINT) AS friends_count, json_extract_string(j, '$.user.location.name') AS location_name FROM lv WHERE json_type(j, '$.user') = 'OBJECT'",
    "p1_mentions": _LEVELS + _entries("user_mentions") + f" SELECT {_KEYS} AS parent_key, CAST(ord_no AS INTEGER) AS ord_no, json_extract_string(h, '$.screen_name') AS screen_name FROM b",
    "p1_quotes": "WITH RECURSIVE "
    + JSON.strip()
    + """,
ks AS (SELECT unnest(['quoted_status', 'retweeted_status']) AS step),
lv AS (SELECT line_no, 0 AS nest_level, '0' AS id, CAST(NULL AS VARCHAR) AS up, json_object('id_str', 'q' || line_no, 'quoted_status', CAST(j AS JSON), 'retweeted_status', CAST(j AS JSON)) AS j FROM j1 WHERE j IS NOT NULL AND json_type(j, '$.delete') IS NULL
  UNION ALL SELECT line_no, nest_level + 1, id || '.' || step || '.0', id, json_extract(j, '$.' || step) FROM lv, ks WHERE json_type(json_extract(j, '$.' || step)) = 'OBJECT')
SELECT line_no, nest_level, concat_ws(':', line_no, id) AS row_key, CASE WHEN up IS NOT NULL THEN concat_ws(':', line_no, up) END AS parent_key, json_extract_string(j, '$.id_str') AS id_str FROM lv""",
    "p2_found": f"WITH {_CELLS} SELECT line_no, reason FROM v WHERE reason IS NOT NULL",
    "p2_clean": f"WITH {_CELLS} SELECT line_no, f[1] AS tweet_id, f[2] AS screen_name, epoch_ms(try_strptime(regexp_replace(substr(f[3], 5), ' [+-][0-9]{{4}} ', ' '), '%b %d %H:%M:%S %Y')) AS created_at, CAST(f[4] AS BIGINT) AS followers, CAST(f[5] AS BIGINT) AS friends, CAST(f[6] AS BIGINT) AS retweets, CAST(f[7] AS BIGINT) AS favourites, f[8] AS text FROM v WHERE reason IS NULL".replace("{{", "{").replace("}}", "}"),
    "p3_found": f"WITH {_IDS} SELECT line_no FROM w WHERE rn > 1",
    "p3_messages": f"WITH {_IDS} SELECT id, line_no, line FROM w WHERE rn = 1",
}
