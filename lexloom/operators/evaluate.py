"""Metrics from (label, pred) rows. Rows with a NULL label are left out; no rows give NULL rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame) -> DataFrame:
    d = df.filter("label is not null")
    return d.agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("pred")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    return df.filter("label is not null").groupBy("label", "pred").agg(F.count("*").alias("n"))


def _counts(df: DataFrame) -> DataFrame:
    y, p = F.col("label"), F.col("pred")
    c = [F.count_if((y == a) & (p == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    return df.filter("label is not null").agg(*c)


def f1_by_label(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both labels; F1 is 0 when precision and recall are."""
    rows = F.array(*[F.struct(F.lit(a).alias("label"), F.col(f"n{a}{a}").alias("tp"), (F.col(f"n{a}{a}") + F.col(f"n{a}{1 - a}")).alias("support"), (F.col(f"n{a}{a}") + F.col(f"n{1 - a}{a}")).alias("predicted")) for a in (0, 1)])
    z = _counts(df).select(F.explode(rows).alias("r")).select("r.*")
    pr, rc = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return z.select("label", pr.alias("precision"), rc.alias("recall"), F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0)).alias("f1"), "support")


def weighted_f1(df: DataFrame) -> DataFrame:
    return f1_by_label(df).agg(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted_f1"))


def au_prc(df: DataFrame) -> DataFrame:
    """Area under precision-recall on hard predictions, in closed form; the prevalence if nothing is predicted positive."""
    d = _counts(df).selectExpr("n11 as tp", "n11 + n01 as pp", "n11 + n10 as p", "n00 + n01 + n10 + n11 as n")
    prev = F.try_divide("p", "n")
    r, q = F.try_divide("tp", "p"), F.try_divide("tp", "pp")
    return d.select(F.when(F.col("pp") == 0, prev).otherwise(r * q + (1 - r) * (q + prev) / 2).alias("au_prc"))


def split_audit(split: DataFrame) -> DataFrame:
    """Sizes of HIGH and LOW and the rest that should be 0 (EVA-07); NULL flags count as the rest."""
    return split.agg(F.count("*").alias("n_pool"), F.count_if(F.col("is_high")).alias("n_high"), F.count_if(~F.col("is_high")).alias("n_low")).withColumn("n_missing", F.col("n_pool") - F.col("n_high") - F.col("n_low"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 1).alias("n_positive"), F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label).isNull()).alias("n_null"))
