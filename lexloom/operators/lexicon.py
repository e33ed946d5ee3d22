"""Lexicon scoring against part-of-speech marked word scores.

A word without a tag, or not in the lexicon, is no hit; a row without hits scores 0.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import constants as K


def load_lexicon(syn: DataFrame) -> DataFrame:
    """(lemma, pos, score): the sum over ranks of (positive - negative) / rank.

    Comment rows (``#``) and malformed terms are skipped; of repeated
    (lemma, pos, rank) entries the last by synset_id counts.
    """
    rows = syn.filter(~F.col("pos_tag").startswith("#") & F.col("terms").isNotNull()).select(
        F.col("pos_tag").alias("pos"), "synset_id", (F.col("pos_score") - F.col("neg_score")).alias("s"), F.explode(F.split("terms", " ")).alias("term")
    )
    p = F.split("term", "#")
    ranked = rows.select(F.get(p, F.lit(0)).alias("lemma"), "pos", F.get(p, F.lit(1)).try_cast("int").alias("rank"), "synset_id", "s").filter("rank > 0 and s is not null")
    last = ranked.groupBy("lemma", "pos", "rank").agg(F.max(F.struct("synset_id", "s")).getField("s").alias("s"))
    return last.groupBy("lemma", "pos").agg(F.sum(F.col("s") / F.col("rank")).alias("score"))


def sentiment_lemmas(lexicon: DataFrame) -> DataFrame:
    """Lemmas with a non-zero score under any tag (SRC-10)."""
    return lexicon.filter("score <> 0").select("lemma").distinct()


def tags_from_lexicon(lexicon: DataFrame) -> DataFrame:
    """A default tag table (word, tag): the first of JJ, NN, RB, VB under which the lexicon has the word."""
    tag = F.when(F.col("pos") == "a", "JJ").when(F.col("pos") == "n", "NN").when(F.col("pos") == "r", "RB").when(F.col("pos") == "v", "VB")
    return lexicon.groupBy(F.col("lemma").alias("word")).agg(F.min(tag).alias("tag"))


def pos_class(tag: Column) -> Column:
    """Penn tag to lexicon class (LEX-03); other tags give NULL."""
    out = None
    for c, tags in K.POS_CLASSES.items():
        out = F.when(tag.isin(*tags), c) if out is None else out.when(tag.isin(*tags), c)
    return out


def in_context(prev: Column, tag: Column) -> Column:
    """Context rule for a tag (LEX-02): a verb tag after a determiner reads as a noun, a noun tag after ``to`` as a verb."""
    return F.when(prev.isin("the", "a", "an", "this", "that") & tag.startswith("VB"), "NN").when((prev == "to") & tag.startswith("NN"), "VB").otherwise(tag)


def score(df: DataFrame, key: str, text: str, lexicon: DataFrame, tags: DataFrame, carry: list[str] = [], contextual: bool = False, tagger: Callable[[Column], Column] | None = None) -> DataFrame:  # noqa: B006
    """Mean lexicon score of a row's words (LEX-04), the sign turned for ``NOT_`` words; 0 without hits.

    The lexicon and the tag table are joined by word and not hinted: the planner
    broadcasts them only if they are under its threshold. Instead of the table, ``tagger`` may tag whole sentences (LEX-02): it
    maps the array of a row's words, their marks of negation taken off, to the array of their tags; see ``sentence_tagger``.
    """
    if tagger is not None:
        return _score_tagged(df, key, text, lexicon, tagger, carry)
    scored = tags.join(lexicon, F.col("word") == F.col("lemma")).select("word", "tag", "pos", "score")
    words = F.transform(F.filter(F.split(F.col(text), " "), lambda t: t != ""), lambda t, i: F.struct(F.regexp_replace(t, "^NOT_", "").alias("w"), t.startswith("NOT_").alias("neg"), i.alias("i")))
    toks = df.select(key, *carry, words.alias("__w")).select(key, *carry, F.explode_outer("__w").alias("t"), "__w")
    toks = toks.select(key, *carry, F.col("t.w").alias("word"), F.coalesce("t.neg", F.lit(False)).alias("neg"), F.get(F.col("__w"), F.col("t.i") - 1).getField("w").alias("prev"))
    j = toks.join(scored, "word", "left")
    tag = in_context(F.col("prev"), F.col("tag")) if contextual else F.col("tag")
    hit = F.col("score").isNotNull() & (pos_class(tag) == F.col("pos"))
    signed = F.when(hit, F.when(F.col("neg"), -F.col("score")).otherwise(F.col("score")))
    return j.groupBy(key, *carry).agg(F.coalesce(F.avg(signed), F.lit(0.0)).alias("score"))


def sentence_tagger(tag: Callable[[list[str]], list[str | None]]) -> Callable[[Column], Column]:
    """A tagger of whole sentences as an Arrow-batched UDF; ``tag`` gives a Penn tag or None for each word."""

    @F.pandas_udf("array<string>")
    def udf(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else list(tag(list(ws))))

    return udf


def _score_tagged(df: DataFrame, key: str, text: str, lexicon: DataFrame, tagger: Callable[[Column], Column], carry: list[str]) -> DataFrame:
    raw = F.filter(F.split(F.col(text), " "), lambda t: t != "")
    d = df.select(key, *carry, raw.alias("__r")).withColumn("__w", F.transform("__r", lambda t: F.regexp_replace(t, "^NOT_", "")))
    d = d.withColumn("__p", tagger(F.col("__w"))).select(key, *carry, F.explode_outer(F.arrays_zip("__r", "__w", "__p")).alias("t"))
    d = d.select(key, *carry, F.col("t.__w").alias("lemma"), pos_class(F.col("t.__p")).alias("pos"), F.startswith(F.col("t.__r"), F.lit("NOT_")).alias("neg"))
    j = d.join(lexicon, ["lemma", "pos"], "left")
    return j.groupBy(key, *carry).agg(F.coalesce(F.avg(F.when(F.col("neg"), -F.col("score")).otherwise(F.col("score"))), F.lit(0.0)).alias("score"))


def sign(score: Column) -> Column:
    return F.signum(score).cast("int")


def confusion_key(sign: Column, emotion: Column) -> Column:
    """Category of lexicon sign against emotion (LEX-06); a positive score on a negative row is ``False_Negative``."""
    return (
        F.when(sign == 0, F.concat(F.lit("Neutral-"), emotion))
        .when((sign > 0) & (emotion == "positive"), "True_Positive")
        .when((sign > 0) & (emotion == "negative"), "False_Negative")
        .when((sign < 0) & (emotion == "negative"), "True_Negative")
        .when((sign < 0) & (emotion == "positive"), "False_Positive")
    )


def agrees(sign: Column, emotion: Column) -> Column:
    return ((sign > 0) & (emotion == "positive")) | ((sign < 0) & (emotion == "negative"))


def entity_series(scored: DataFrame, text: str, ts: str, entities: list[str]) -> DataFrame:
    """(entity, ts, sentiment) for each entity contained in the text of a row whose sign agrees with its emotion (LEX-08)."""
    hits = F.filter(F.array(*[F.lit(e) for e in entities]), lambda e: F.contains(F.col(text), e))
    s = sign(F.col("score"))
    return scored.filter(agrees(s, F.col("emotion")) & F.col(ts).isNotNull()).select(F.explode(hits).alias("entity"), F.col(ts).alias("ts"), s.alias("sentiment"))
