"""Evaluation by month: all periods in one plan instead of a driver loop.

A period m trains on a window of months and is tested on month m + 1. A period
whose test month is empty has accuracy NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import bayes as B
from lexloom.operators import cotrain as C
from lexloom.operators.selftrain import label_all


def periods(spark: SparkSession, kind: str, last: int = 10) -> DataFrame:
    """(period, lo, hi) of ``single``, ``cumulative`` or ``sliding`` (three months) windows, months counted from 0."""
    start = 2 if kind == "sliding" else 0
    lo = {"single": "period", "cumulative": "0", "sliding": "period - 2"}[kind]
    return spark.range(start, last + 1).select(F.col("id").cast("int").alias("period")).withColumn("lo", F.expr(lo).cast("int")).withColumn("hi", F.col("period"))


def in_window(df: DataFrame, ps: DataFrame) -> DataFrame:
    """Rows repeated for each period whose window holds their month; ``ps`` is a table of periods (a few rows)."""
    return df.join(F.broadcast(ps), (F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi"))).drop("lo", "hi")


def window_models(train: DataFrame, ps: DataFrame, tokens: str) -> B.Model:
    """Counts are made once per month; a window sums its months' counts."""
    return B.windowed(B.train(train, tokens, by=("month",)), ps)


def _accuracy(ps: DataFrame, scored: DataFrame) -> DataFrame:
    a = scored.groupBy("period").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("n_ok"))
    return ps.select("period").join(a, "period", "left").select("period", F.coalesce("n", F.lit(0)).alias("n_test"), F.try_divide("n_ok", "n").alias("accuracy"))


def _test(test: DataFrame) -> DataFrame:
    return test.withColumn("period", F.col("month") - 1)


def evaluate(train: DataFrame, test: DataFrame, ps: DataFrame, tokens: str = "uni", key: str = "id", v: int = B.UNI) -> DataFrame:
    """Labelled windows only (TMP-01/02/03); prequential or hold-out by the choice of ``test`` (TMP-04)."""
    return _accuracy(ps, B.score(_test(test), window_models(train, ps, tokens), tokens, key, ("label",), v=v))


def self_train(train: DataFrame, pool: DataFrame, test: DataFrame, ps: DataFrame, tokens: str = "uni", key: str = "id", v: int = B.UNI, pool_ps: DataFrame | None = None) -> DataFrame:
    """Label the window's pool, retrain, test (TMP-05). ``pool_ps`` gives the pool other windows than the training set."""
    m = window_models(train, ps, tokens)
    lab = label_all(m, in_window(pool, ps if pool_ps is None else pool_ps), tokens, key, v, (tokens,))
    return _accuracy(ps, B.score(_test(test), B.add(m, B.train(lab, tokens, by=("period",))), tokens, key, ("label",), v=v))


def co_train(train: DataFrame, pool: DataFrame, test: DataFrame, ps: DataFrame, key: str = "id", v0: int = B.UNI, v1: int = B.BI, pool_ps: DataFrame | None = None) -> DataFrame:
    """One unthresholded exchange between the views per window (TMP-06): the accuracy of both."""
    models = (window_models(train, ps, "uni"), window_models(train, ps, "bi"))
    m0, m1, _ = C.exchange(train, in_window(pool, ps if pool_ps is None else pool_ps), ("period",), key, models, v0, v1)
    a0 = _accuracy(ps, B.score(_test(test), m0, "uni", key, ("label",), v=v0)).withColumnRenamed("accuracy", "uni_accuracy")
    a1 = _accuracy(ps, B.score(_test(test), m1, "bi", key, ("label",), v=v1)).select("period", F.col("accuracy").alias("bi_accuracy"))
    return a0.join(a1, "period")
