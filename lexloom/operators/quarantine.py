"""Rows that fail to parse (problem 2): cells, a rule table, aggregated errors, clean rows by anti-join.

A line is cut into cells (row, column, value), with two more cells for its
quoting and its number of columns. The cells meet the rule table on the column,
violations are kept, and only these are shuffled to find the first reason per
line. The clean rows are the lines without an error.

A NULL line has no columns and fails as ``columns``; an empty line has one.
Lines are told apart by key and content, so repeated keys do no harm and equal
rows fare alike; a NULL key is a key like others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions.text import let

QUOTING, COLUMNS = -2, -1
_CELL = r'\G("[^"]*+(?:""[^"]*+)*+"|(?!")[^\t]*+)\t'
_TIME = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4} [0-9]{4}\z"


@dataclass(frozen=True)
class Rule:
    col_no: int
    kind: str  #: quoting, width, id, time, count, filled, readable
    reason: str


EXTRACT = ["tweet_id", "screen_name", "created_at", "followers", "friends", "retweets", "favourites", "text"]
EXTRACT_RULES = [
    Rule(QUOTING, "quoting", "quoting"), Rule(COLUMNS, "width", "columns"), Rule(0, "id", "value"), Rule(1, "filled", "value"), Rule(2, "time", "value"),
    Rule(3, "count", "value"), Rule(4, "count", "value"), Rule(5, "count", "value"), Rule(6, "count", "value"), Rule(7, "filled", "value"), Rule(7, "readable", "value"),
]
ORDER = ["quoting", "columns", "value"]


def rule_table(spark: SparkSession, rules: list[Rule] = EXTRACT_RULES) -> DataFrame:
    return spark.createDataFrame([(r.col_no, i, r.kind, r.reason, ORDER.index(r.reason)) for i, r in enumerate(rules)], "col_no int, rule_no int, kind string, reason string, rank int")


def cells_of(line: Column) -> Column:
    """Struct of the unquoted cells and whether the quoting holds; possessive patterns keep long texts off the stack."""

    def parts(whole: Column) -> Column:
        def checked(raw: Column) -> Column:
            used = F.aggregate(raw, F.lit(0), lambda a, c: a + F.length(c) + 1)
            plain = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
            return F.struct(plain.alias("cells"), (used == F.length(whole)).alias("quoted_well"))

        return let(F.regexp_extract_all(whole, F.lit(_CELL), F.lit(1)), checked)

    return let(F.concat(line, F.lit("\t")), parts)


def broken(kind: Column, value: Column, width: int) -> Column:
    """Whether a cell breaks a rule of the given kind."""
    v = F.coalesce(value, F.lit(""))
    blank = v.rlike(r"(?U)^[\s\p{Z}]*\z")
    return (
        F.when(kind == "quoting", v != "true")
        .when(kind == "width", v != str(width))
        .when(kind == "id", ~v.rlike(r"^0*[1-9][0-9]*\z"))
        .when(kind == "count", ~v.rlike(r"^[0-9]+\z"))
        .when(kind == "time", ~v.rlike(_TIME) | D.tweet_ts(v).isNull())
        .when(kind == "filled", blank)
        .when(kind == "readable", F.contains(v, F.lit("�")))
        .otherwise(False)
    )


def parsed(lines: DataFrame, key: str, line: str) -> DataFrame:
    return lines.select(F.col(key).alias("__k"), F.xxhash64(line).alias("__h"), F.explode(F.array(cells_of(F.col(line)))).alias("__c"))


def errors(rows: DataFrame, rules: DataFrame, width: int = 8) -> DataFrame:
    """(__k, __h, reason, broken rules) of the failing lines; the rule table is broadcast (a row per rule)."""
    cs = F.col("__c.cells")
    lead = F.array(F.struct(F.lit(QUOTING).alias("col_no"), F.coalesce(F.col("__c.quoted_well"), F.lit(True)).cast("string").alias("value")), F.struct(F.lit(COLUMNS).alias("col_no"), F.coalesce(F.size(cs), F.lit(0)).cast("string").alias("value")))
    body = F.transform(F.coalesce(cs, F.array().cast("array<string>")), lambda v, i: F.struct(i.cast("int").alias("col_no"), v.alias("value")))
    cells = rows.select("__k", "__h", F.inline(F.concat(lead, body)))
    bad = cells.join(F.broadcast(rules), "col_no").filter(broken(F.col("kind"), F.col("value"), width))
    agg = bad.groupBy("__k", "__h").agg(F.min("rank").alias("rank"), F.sort_array(F.collect_set("rule_no")).alias("rules"))
    return agg.withColumn("reason", F.element_at(F.array(*[F.lit(r) for r in ORDER]), F.col("rank") + 1)).drop("rank")


def failing(lines: DataFrame, rules: DataFrame, key: str = "line_no", line: str = "line", width: int = 8) -> DataFrame:
    """(key, reason) of every failing line, the first reason that applies."""
    n = lines.select(F.col(key).alias("__k"), F.xxhash64(line).alias("__h"))  # equal rows come out as often as they came in
    e = errors(parsed(lines, key, line), rules, width).select(F.col("__k").alias("k2"), F.col("__h").alias("h2"), "reason")
    return n.join(e, n["__k"].eqNullSafe(e["k2"]) & n["__h"].eqNullSafe(e["h2"])).select(F.col("__k").alias(key), "reason")


def clean(lines: DataFrame, rules: DataFrame, key: str = "line_no", line: str = "line", names: list[str] = EXTRACT) -> DataFrame:  # noqa: B006
    """The valid lines, typed: all lines anti-joined with the errors."""
    rows = parsed(lines, key, line)
    e = errors(rows, rules, len(names)).select(F.col("__k").alias("k2"), F.col("__h").alias("h2"))
    ok = rows.join(e, rows["__k"].eqNullSafe(e["k2"]) & rows["__h"].eqNullSafe(e["h2"]), "left_anti")
    c = lambda i: F.get(F.col("__c.cells"), F.lit(i))
    kinds = {"created_at": D.tweet_ts, **{n: (lambda x: x.try_cast("bigint")) for n in ("followers", "friends", "retweets", "favourites")}}
    return ok.select(F.col("__k").alias(key), *[kinds.get(n, lambda x: x)(c(i)).alias(n) for i, n in enumerate(names)])
