"""Repair of class imbalance. Negatives (label 0) are assumed to be the minority.

Randomness is a hash of the key, so results are the same on any cluster. Output
rows carry ``copy``, 0 for an original. A class without rows gives no copies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GATE = 0.20


def _h(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))


def half(*parts: Column | str) -> Column:
    """A fair coin from the hash of the parts."""
    return F.substring(_h(*parts), 1, 1) < "8"


def imbalance(df: DataFrame) -> DataFrame:
    """Positives, negatives, |P-N|/(P+N) and whether augmentation is needed (BAL-01)."""
    d = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    dist = F.try_divide(F.abs(F.col("p") - F.col("n")).cast("double"), (F.col("p") + F.col("n")).cast("double"))
    return d.withColumn("distance", dist).withColumn("augment", F.coalesce(F.col("distance") > GATE, F.lit(False)))


def _sizes(df: DataFrame, what: str) -> Column:
    """A scalar over p and n of the input."""
    return df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).select(F.expr(what)).scalar()


def smallest_hashes(df: DataFrame, key: str, n: Column, digits: int = 4) -> DataFrame:
    """Exactly the ``n`` rows with the smallest hash, without a global sort.

    Rows are counted by the first hex digits (at most 16**digits groups); groups
    wholly under the limit are kept as they are, and only the one at the limit is ranked.
    """
    d = df.withColumn("__h", _h(F.col(key))).withColumn("__b", F.substring("__h", 1, digits))
    c = d.groupBy("__b").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))  # at most 16**digits rows
    c = c.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__n", n).filter("__before < __n")
    d = d.join(F.broadcast(c), "__b")
    whole = d.filter("__before + __c <= __n")
    edge = d.filter("__before + __c > __n").withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy("__h", *df.columns))).filter("__before + __r <= __n")
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def undersample(df: DataFrame, key: str = "id") -> DataFrame:
    """As many positives as there are negatives, and all negatives (BAL-02)."""
    pos = smallest_hashes(df.filter("label = 1"), key, _sizes(df, "n"))
    return pos.unionByName(df.filter("label = 0"))


def _copies(neg: DataFrame, rounds: Column, start: int = 1) -> DataFrame:
    return neg.withColumn("__r", rounds).filter(F.col("__r") >= start).withColumn("copy", F.explode(F.sequence(F.lit(start), F.col("__r").cast("int")))).drop("__r")


def oversample(df: DataFrame, key: str = "id") -> DataFrame:
    """All positives and random halves of the negatives until they are as many (BAL-03); under two negatives give none."""
    rounds = _sizes(df, "case when n >= 2 then ceil(p / (n div 2)) end")
    neg = _copies(df.filter("label = 0"), rounds).filter(half(F.col(key), F.col("copy")))
    return df.filter("label = 1").withColumn("copy", F.lit(0)).unionByName(neg)


def resample_both(df: DataFrame, key: str = "id") -> DataFrame:
    """Half of the positives; negatives as they are if more than P/2, else random halves until P/2 (BAL-04).

    At exact equality no negatives come out, as in the original definition.
    """
    pos = df.filter((F.col("label") == 1) & half(F.col(key), "p")).withColumn("copy", F.lit(0))
    rounds = _sizes(df, "case when p div 2 < n then 0 when p div 2 = n or n < 2 then -1 else ceil((p div 2 - n) / (n div 2)) end")
    neg = df.filter("label = 0").withColumn("__r", rounds).filter("__r >= 0")
    neg = neg.withColumn("copy", F.explode(F.when(F.col("__r") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(F.col("__r").cast("int"), F.lit(1)))))).drop("__r")
    return pos.unionByName(neg.filter((F.col("copy") == 0) | half(F.col(key), F.col("copy"))))


def _augment_rounds(df: DataFrame) -> Column:
    return _sizes(df, "case when n > 0 then greatest(ceil(p / n) - 1, 0) end")


def _as_table(spark, words: Sequence[str] | DataFrame) -> DataFrame:
    return words if isinstance(words, DataFrame) else spark.createDataFrame([(w,) for w in sorted(set(words))], "lemma string")


def blankout(df: DataFrame, lemmas: Sequence[str] | DataFrame, key: str = "id", tokens: str = "uni", k: int = 1, least: int = 4) -> DataFrame:
    """Copies of the negatives with one word dropped (BAL-05), enough rounds for the classes to meet.

    The word is the eligible one (no negation, no sentiment lemma) with the
    smallest hash; a copy without an eligible word is lost. Instead of at most
    eleven random draws every position is considered. ``lemmas`` is a list or a table whose
    first column has them; the positions of the negatives are anti-joined with it once, before they are copied.
    """
    if k != 1:
        raise ValueError("one word is dropped per copy")
    table = _as_table(df.sparkSession, lemmas)
    lem = table.select(F.col(table.columns[0]).alias("__t")).filter("__t is not null").distinct()
    base = df.filter((F.col("label") == 0) & (F.size(tokens) >= k + least))
    spots = base.select(F.col(key).alias("__k"), F.posexplode(tokens).alias("__i", "__t")).filter(~F.col("__t").rlike("^(NOT_|not_)|(dont|havent|cant|cannot|arent|aint)$"))
    spots = spots.join(lem, "__t", "left_anti").groupBy("__k").agg(F.collect_set("__i").alias("__ok"))  # at most the words of one row
    neg = _copies(base.join(spots, F.col(key) == F.col("__k")).drop("__k"), _augment_rounds(df))
    h = F.transform("__ok", lambda i: F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string"), i.cast("string"))).alias("h"), i.alias("i")))
    neg = neg.withColumn("__s", F.array_min(h).getField("i"))
    left = F.filter(F.transform(F.col(tokens), lambda t, i: F.when(i != F.col("__s"), F.lower(t))), lambda t: t.isNotNull())
    return neg.withColumn(tokens, left).drop("__s", "__ok")


def synonyms(df: DataFrame, table: Mapping[str, Sequence[str]] | DataFrame, key: str = "id", tokens: str = "uni") -> DataFrame:
    """Copies of the negatives with every word that has neighbours replaced by one of them (BAL-06); unchanged copies are lost.

    ``table`` is a mapping or a table (word, neighbours); each negative is joined with the entries of its words once, before it is copied.
    """
    if not isinstance(table, DataFrame):
        table = df.sparkSession.createDataFrame([(w, list(ns)) for w, ns in sorted(table.items())], "word string, neighbours array<string>")
    base = df.filter("label = 0")
    syn = table.filter((F.size("neighbours") > 0) & F.col("word").isNotNull()).groupBy(F.col("word").alias("__t")).agg(F.min("neighbours").alias("__n"))
    own = base.select(F.col(key).alias("__k"), F.explode(F.array_distinct(tokens)).alias("__t")).join(syn, "__t").groupBy("__k").agg(F.map_from_entries(F.collect_list(F.struct("__t", "__n"))).alias("__m"))  # at most the words of one row
    neg = _copies(base.join(own, F.col(key) == F.col("__k")).drop("__k"), _augment_rounds(df))

    def pick(t: Column, i: Column) -> Column:
        ns = F.try_element_at(F.col("__m"), t)
        d = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string"), i.cast("string"))), 1, 4), 16, 10).cast("int")
        return F.lower(F.coalesce(F.get(ns, F.when(F.size(ns) > 0, F.pmod(d, F.size(ns)))), t))

    return neg.withColumn(tokens, F.transform(F.col(tokens), pick)).drop("__m")


def augment(df: DataFrame, how: str, lemmas: Sequence[str] | DataFrame = (), table: Mapping[str, Sequence[str]] | DataFrame = {}, key: str = "id", tokens: str = "uni") -> DataFrame:  # noqa: B006
    """The training set of an augmented self-training round (BAL-07, BAL-08), with ``copy``, 0 for originals.

    ``how`` is ``blankout`` or ``embeddings`` (all originals and the copies), or ``sampling`` (half of the positives, all
    negatives, and random halves of these until they are P/2). A set whose imbalance is at most GATE, or empty, passes through unchanged.
    """
    whole = df.withColumn("copy", F.lit(0))
    if how not in ("blankout", "embeddings", "sampling"):
        raise ValueError(f"unknown augmentation {how}")
    needed = lambda d: d.withColumn("__need", _sizes(df, f"coalesce(abs(p - n) / (p + n) > {GATE}, false)")).filter("__need").drop("__need")
    if how == "sampling":
        skewed = _sizes(df, f"coalesce(abs(p - n) / (p + n) > {GATE}, false)")
        whole = whole.withColumn("__need", skewed).filter(~F.col("__need") | (F.col("label") != 1) | half(F.col(key), "p")).drop("__need")
        pos = F.sum(F.when((F.col("label") == 1) & half(F.col(key), "p"), 1))
        rounds = df.agg(pos.alias("p"), F.count_if(F.col("label") == 0).alias("n")).select(F.expr("case when n >= 2 and n < p then ceil((p - n) / (n div 2)) end")).scalar()
        extra = _copies(df.filter("label = 0"), rounds).filter(half(F.col(key), F.col("copy")))
    else:
        extra = blankout(df, lemmas, key, tokens) if how == "blankout" else synonyms(df, table, key, tokens)
    return whole.unionByName(needed(extra).select(whole.columns))
