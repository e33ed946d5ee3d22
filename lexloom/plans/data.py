"""How the test tables become the corpus the learning operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions import text as X
from lexloom.operators import corpus as C
from lexloom.session import cut
from lexloom.sources import layouts as L


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per tweet id of the LONG layout with tokens of both views, month and emotion label."""
    t = C.first_per_key(table(spark, d, "tweet_long"), "id", ["created_at", "hashtags", "text", "retweet_flag", "emotion", "emoticons", "unigrams", "opaque", "bigrams"])
    return t.select(
        "id", "created_at", D.month0(F.col("created_at")).alias("month"), "hashtags", "text", "retweet_flag", "emotion", "unigrams",
        X.tokens(F.coalesce("unigrams", F.lit(""))).alias("uni"), X.tokens(F.coalesce("bigrams", F.lit(""))).alias("bi"),
        L.label_of(F.col("emotion"), otherwise=None).alias("label"),
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "tweet_gold").withColumn("label", L.label01(F.col("label")))
    return C.first_per_key(g, "id", ["label", "opaque", "text"]).select("id", F.col("label").alias("gold"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """docs with ``role``: test (has a gold label), train (has an emotion label), pool (the rest)."""
    j = docs(spark, d).join(gold(spark, d), "id", "left")
    role = F.when(F.col("gold").isNotNull(), "test").when(F.col("label").isNotNull(), "train").otherwise("pool")
    return j.withColumn("role", role).withColumn("label", F.coalesce("gold", "label")).drop("gold")


def roles(spark: SparkSession, d: str, once: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, pool, test). With ``once`` they are written first, for plans that use them many times."""
    c = corpus(spark, d).select("id", "month", "uni", "bi", "label", "role")
    c = cut(c) if once else c
    return tuple(c.filter(F.col("role") == r).drop("role") for r in ("train", "pool", "test"))  # type: ignore[return-value]


def slang_map(spark: SparkSession, d: str) -> dict[str, str]:
    return L.small_map(table(spark, d, "slang").withColumn("replacement", F.regexp_replace("replacement", "  +", " ")), "term", "replacement")
