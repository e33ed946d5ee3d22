"""JSON message lines as VARIANT records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once per row: a generator keeps later filters and projections from inlining it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_records(lines: DataFrame, column: str = "line", out: str = "rec") -> DataFrame:
    """Adds ``out``, the VARIANT of a line that is one JSON object, else NULL.

    The line is parsed inside ``[line,0]``, so text after the object (which the
    parser alone would ignore) makes it invalid. NULL, empty and non-object
    lines give NULL.
    """
    df = once(lines, F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(",0]"))), "__w")
    one = F.try_variant_get("__w", "$[1]", "int").eqNullSafe(F.lit(0)) & F.expr("variant_get(__w, '$[2]') is null")
    rec = F.expr("variant_get(__w, '$[0]')")
    return once(df, F.when(one & F.startswith(F.schema_of_variant(rec), F.lit("OBJECT")), rec), out).drop("__w")


def field(rec: str, path: str, kind: str = "string") -> Column:
    """A scalar at ``path`` (without ``$.``); NULL where absent, null or not castable."""
    return F.try_variant_get(rec, f"$.{path}", kind)


def scalar_text(rec: str, path: str) -> Column:
    """Text of a string or number at ``path``, trimmed; NULL for other kinds and for blank text."""
    v = F.expr(f"variant_get({rec}, '$.{path}')")
    kind = F.schema_of_variant(v)
    t = F.regexp_replace(F.try_variant_get(rec, f"$.{path}", "string"), r"^\s+|\s+$", "")
    return F.when((kind.isin("STRING", "BIGINT") | kind.startswith("DECIMAL")) & (t != ""), t)


def has(rec: str, path: str) -> Column:
    """The key exists, even with a null value."""
    return F.expr(f"variant_get({rec}, '$.{path}') is not null")


def is_tombstone(rec: str) -> Column:
    return has(rec, "delete")


def hashtag_texts(rec: str) -> Column:
    """Array of the hashtags' texts; a lone object counts as one entry; absent or null gives an empty array."""
    many = F.expr(f"try_variant_get({rec}, '$.entities.hashtags', 'array<variant>')")
    lone = F.expr(f"try_variant_get({rec}, '$.entities.hashtags.text', 'string')")
    empty = F.expr("array()").cast("array<string>")
    texts = F.transform(many, lambda h: F.try_variant_get(h, "$.text", "string"))
    return F.when(many.isNotNull(), texts).when(lone.isNotNull(), F.array(lone)).otherwise(empty)
