"""Dictionaries of any size: each text is joined with the entries it holds.

The functions of ``functions.text`` take a literal list, or a Column. ``with_entries`` makes that
Column from a table: distinct words of distinct texts are joined with the table, so neither the size of the
dictionary nor copies of a text matter, and a row carries only its own entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X


def with_entries(df: DataFrame, text: str, table: DataFrame, word: str, value: str | None, name: str, seen: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """Adds ``name``: a map word -> value of the entries whose word is a token of ``seen(text)``, or without ``value`` the array of these words.

    Of several values for a word the smallest counts. NULL and empty texts, and texts without an entry, get an empty map or array.
    """
    h = F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))
    t = table.filter(F.col(word).isNotNull()).groupBy(F.col(word).alias("__w")).agg(F.min(value or word).alias("__v"))
    toks = df.select(h.alias("__h"), F.col(text).alias("__t")).groupBy("__h").agg(F.first("__t").alias("__t")).select("__h", F.explode(F.array_distinct(X.tokens(seen(F.col("__t"))))).alias("__w"))
    j = toks.join(t, "__w").groupBy("__h")
    own = j.agg(F.map_from_entries(F.collect_list(F.struct("__w", "__v"))).alias("__own")) if value else j.agg(F.collect_list("__w").alias("__own"))  # at most the words of one text
    empty = F.expr("map()").cast("map<string,string>") if value else F.array().cast("array<string>")
    return df.withColumn("__h", h).join(own, "__h", "left").withColumn(name, F.coalesce("__own", empty)).drop("__h", "__own")
