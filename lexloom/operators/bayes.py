"""Relational multinomial Naive Bayes with two classes, optionally one model per period.

Sufficient statistics are counts, so models add: a self-training round adds the
counts of the new rows, a cumulative window sums monthly models. The vocabulary
size ``v`` only enters the denominator; words never seen count with n = 0.
Rows without tokens are scored by the prior alone; rows with a NULL label do not train.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNI, BI = 1_500_000, 3_500_000
LAM = 1.0


@dataclass(frozen=True)
class Model:
    cond: DataFrame  #: by..., token, n0, n1
    prior: DataFrame  #: by..., docs0, docs1, terms0, terms1: one row per period
    by: tuple[str, ...] = ()


_SUMS = ("docs0", "docs1", "terms0", "terms1")


def train(df: DataFrame, tokens: str, label: str = "label", by: tuple[str, ...] = ()) -> Model:
    """Counts by token and class, combined before the one shuffle on the token."""
    y = F.col(label)
    df = df.filter(y.isin(0, 1))
    cond = df.select(*by, y.alias("__y"), F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count_if(F.col("__y") == 0).alias("n0"), F.count_if(F.col("__y") == 1).alias("n1"))
    size = F.coalesce(F.greatest(F.size(tokens), F.lit(0)), F.lit(0)).cast("bigint")
    prior = df.groupBy(*by).agg(
        F.count_if(y == 0).alias("docs0"),
        F.count_if(y == 1).alias("docs1"),
        F.coalesce(F.sum(F.when(y == 0, size)), F.lit(0)).alias("terms0"),
        F.coalesce(F.sum(F.when(y == 1, size)), F.lit(0)).alias("terms1"),
    )
    return Model(cond, prior, by)


def add(*models: Model) -> Model:
    """The model of the united training sets."""
    by = models[0].by
    cond, prior = models[0].cond, models[0].prior
    for m in models[1:]:
        cond, prior = cond.unionByName(m.cond), prior.unionByName(m.prior)
    return Model(
        cond.groupBy(*by, "token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")),
        prior.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _SUMS]),
        by,
    )


def windowed(monthly: Model, periods: DataFrame) -> Model:
    """One model per period from monthly counts; ``periods`` has (period, lo, hi) and at most a few hundred rows."""
    p = F.broadcast(periods)
    hit = (F.col("month") >= F.col("lo")) & (F.col("month") <= F.col("hi"))
    cond = monthly.cond.join(p, hit).groupBy("period", "token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    prior = monthly.prior.join(p, hit).groupBy("period").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return Model(cond, prior, ("period",))


def score(df: DataFrame, model: Model, tokens: str, key: str, carry: tuple[str, ...] = (), v: int = UNI, lam: float = LAM) -> DataFrame:
    """key, by..., carry..., raw0, raw1, p1 and pred for each row; a period without model gives no rows.

    Every token occurrence is left-joined with the counts on the token (the
    planner broadcasts small models), then summed by row; ``carry`` must depend on the key.
    """
    by = model.by
    occ = df.select(key, *by, *carry, F.explode_outer(tokens).alias("token"))
    j = occ.join(model.cond, [*by, "token"], "left")
    seen = F.col("token").isNotNull()
    part = lambda n: F.sum(F.when(seen, F.ln(F.coalesce(F.col(n), F.lit(0)) + lam)).otherwise(0.0))
    s = j.groupBy(key, *by, *carry).agg(part("n0").alias("__s0"), part("n1").alias("__s1"), F.count("token").alias("__len"))
    if by:
        s = s.join(F.broadcast(model.prior), list(by))  # a row per period
        g = {c: F.col(c) for c in _SUMS}
    else:
        one = model.prior.select(F.struct(*_SUMS)).scalar()
        s = s.withColumn("__g", one)
        g = {c: F.col(f"__g.{c}") for c in _SUMS}

    def raw(c: int) -> Column:
        pi = F.ln(g[f"docs{c}"] + lam) - F.ln(g["docs0"] + g["docs1"] + 2 * lam)
        return pi + F.col(f"__s{c}") - F.col("__len") * F.ln(g[f"terms{c}"] + F.lit(lam * v))

    s = s.select(key, *by, *carry, raw(0).alias("raw0"), raw(1).alias("raw1"))
    return s.withColumn("p1", 1 / (1 + F.exp(F.col("raw0") - F.col("raw1")))).withColumn("pred", F.when(F.col("raw1") > F.col("raw0"), 1).otherwise(0))


def confidence() -> Column:
    return F.greatest(F.col("p1"), 1 - F.col("p1"))


def parameters(model: Model, v: int = UNI, lam: float = LAM) -> DataFrame:
    """(token, label, theta) and the priors as rows with token NULL, for a model without periods."""
    g = model.prior.select(F.struct(*_SUMS)).scalar()
    t = model.cond.withColumn("__g", g)
    rows = F.array(*[F.struct(F.lit(c).alias("label"), (F.ln(F.col(f"n{c}") + lam) - F.ln(F.col(f"__g.terms{c}") + lam * v)).alias("theta")) for c in (0, 1)])
    t = t.select("token", F.explode(rows).alias("r")).select("token", "r.label", "r.theta")
    pri = F.array(*[F.struct(F.lit(c).alias("label"), (F.ln(F.col(f"docs{c}") + lam) - F.ln(F.col("docs0") + F.col("docs1") + 2 * lam)).alias("theta")) for c in (0, 1)])
    return t.unionByName(model.prior.select(F.lit(None).cast("string").alias("token"), F.explode(pri).alias("r")).select("token", "r.label", "r.theta"))


def fit_hashed(df: DataFrame, tokens: str = "tokens", label: str = "label", v: int = UNI, lam: float = LAM):
    """The hashed alternative: HashingTF and the library's NaiveBayes as one pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF

    return Pipeline(stages=[HashingTF(numFeatures=v, inputCol=tokens, outputCol="features"), NaiveBayes(smoothing=lam, labelCol=label, modelType="multinomial")]).fit(df)


def default_threshold(p: float) -> float:
    """Raw score difference at which the posterior reaches ``p``."""
    return math.log(p / (1 - p))
