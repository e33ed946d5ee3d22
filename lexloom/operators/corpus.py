"""Corpus jobs: extraction, filters, dedup by key, entity mentions, counts.

NULL texts and NULL keys are dropped where a row needs them; columns with other
names are passed through, so inputs may carry extra ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions import text as X
from lexloom.sources import tweets as J


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (NULLs first). A NULL key is no key: its rows are dropped.

    An aggregate, not a window: copies are combined before the shuffle, so a
    key with very many copies does not land in one task.
    """
    rest = [c for c in df.columns if c != key]
    ordered = [*order, *[c for c in rest if c not in order]]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*ordered)).alias("__m")).select(key, *[F.col(f"__m.{c}").alias(c) for c in rest])


def english_records(lines: DataFrame, column: str = "line") -> DataFrame:
    """English messages (COR-01): retweets are replaced by the original, which must be English too.

    Tombstones, unparsable lines and records that lack one of the eight fields are dropped.
    """
    r = J.parse_records(lines, column).filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec") & (J.field("rec", "lang") == "en"))
    r = J.once(r.select("rec"), F.when(J.has("rec", "retweeted_status"), F.expr("variant_get(rec, '$.retweeted_status')")).otherwise(F.col("rec")), "msg")
    out = r.filter(J.field("msg", "lang") == "en").select(
        J.scalar_text("msg", "id_str").alias("tweet_id"),
        J.field("msg", "user.screen_name").alias("screen_name"),
        J.field("msg", "created_at").alias("created_at"),
        J.field("msg", "user.followers_count", "bigint").alias("followers"),
        J.field("msg", "user.friends_count", "bigint").alias("friends"),
        J.field("msg", "retweet_count", "bigint").alias("retweets"),
        J.field("msg", "favorite_count", "bigint").alias("favourites"),
        X.normalize_ws(J.field("msg", "text")).alias("text"),
    )
    return out.dropna()


def basic_stats(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows by category (AGG-01). An English record without text, and one without language, counts as an exception.

    A retweet flag and hashtags are only formed for English records; odd hashtags leave the count as it is.
    """
    r = J.parse_records(lines, column)
    lang, txt = J.field("rec", "lang"), J.field("rec", "text")
    kind = (
        F.when(F.col("rec").isNull(), "Unable_to_parse")
        .when(J.is_tombstone("rec"), "Deleted")
        .when(lang.isNull(), "NullPointerException")
        .when((lang == "en") & txt.isNull(), "NullPointerException")
        .otherwise(lang)
    )
    counted = r.select(kind.alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).select(F.lit("Total_Rows").alias("category"), "n")
    return counted.unionByName(total)


def with_hashtags(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds ``hashtags``, the texts joined with ``-`` or the word ``null`` (TXT-18)."""
    r = J.parse_records(lines, column).filter(F.col("rec").isNotNull() & ~J.is_tombstone("rec"))
    tags = F.transform(J.hashtag_texts("rec"), lambda t: F.coalesce(t, F.lit("null")))
    return r.withColumn("hashtags", F.when(F.size(tags) == 0, "null").otherwise(F.array_join(tags, "-"))).drop("rec")


def crop(df: DataFrame, emotions: Sequence[str], no_retweets: bool = False) -> DataFrame:
    """Rows with one of the emotions (COR-03/04/05), originals only if asked."""
    out = df.filter(F.col("emotion").isin(*emotions))
    return out.filter("retweet_flag = 0") if no_retweets else out


def min_tokens(df: DataFrame, tokens: Column, least: int = 4) -> DataFrame:
    return df.filter(F.size(tokens) >= least)


def remove_low_freq(df: DataFrame, key: str, text: str, below: int, least: int = 4) -> DataFrame:
    """Lower-case, drop words seen under ``below`` times, keep rows with ``least`` tokens left (COR-06).

    Words are counted with a combiner; the rare words (the long tail, which may
    be large) meet the tokens by a join on the word, and positions restore the order.
    """
    toks = df.filter(F.col(key).isNotNull()).select(key, F.posexplode(X.tokens(F.lower(F.col(text)))).alias("pos", "word"))
    rare = toks.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") < below).select("word")
    kept = toks.join(rare, "word", "left_anti").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return kept.filter(F.size("w") >= least).select(key, F.array_join(F.col("w.word"), " ").alias("text"))


def entity_mentions(df: DataFrame, text: str, entities: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row per token whose lower-case form is an entity (COR-08)."""
    es = X.lit_array([e.lower() for e in entities])
    hits = F.filter(X.tokens(F.lower(F.col(text))), lambda t: F.array_contains(es, t))
    return df.select(*carry, F.explode(hits).alias("entity"))


def sample_per_class(df: DataFrame, label: str, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows of each class (COR-12); the rank limit is pushed below the shuffle."""
    w = W.partitionBy(label).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def word_count(df: DataFrame, text: Column) -> DataFrame:
    """Occurrences by word, combined before the shuffle (AGG-02)."""
    return df.select(F.explode(X.tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def pos_neg_dictionary(df: DataFrame, words: str = "unigrams", emotion: str = "emotion", hashtags: str = "hashtags") -> DataFrame:
    """Counts of a word in positive rows and, negated, in negative rows, without the row's hashtags (AGG-03)."""
    tags = F.coalesce(F.split(F.col(hashtags), "-"), F.array(F.lit("null")))
    d = df.filter(F.col(emotion).isin("positive", "negative")).select(F.col(emotion).alias("__e"), F.explode(F.filter(X.tokens(F.col(words)), lambda t: ~F.array_contains(tags, t))).alias("word"))
    return d.groupBy("word").agg(F.count_if(F.col("__e") == "positive").alias("n_positive"), (-F.count_if(F.col("__e") == "negative")).alias("n_negative"))
