"""Co-training of two views (columns ``uni`` and ``bi`` of one row), each labelling for the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import bayes as B
from lexloom.operators.selftrain import label_all
from lexloom.session import cut


def round_(l0: DataFrame, l1: DataFrame, u0: DataFrame, u1: DataFrame, tau: float = 0.65, key: str = "id", v0: int = B.UNI, v1: int = B.BI) -> DataFrame:
    """One round (COT-02/03): each view's pool rows with pred, p1, is_high; HIGH rows of view 0 train view 1 and vice versa."""
    parts = []
    for view, tok, lab, pool, v in ((0, "uni", l0, u0, v0), (1, "bi", l1, u1, v1)):
        s = B.score(pool, B.train(lab, tok), tok, key, v=v)
        parts.append(s.select(F.lit(view).alias("view"), key, "p1", "pred", (B.confidence() >= tau).alias("is_high")))
    return parts[0].unionByName(parts[1])


def loop(gold: DataFrame, pool: DataFrame, tau: float = 0.65, steps: int = 6, key: str = "id", v0: int = B.UNI, v1: int = B.BI, checkpoint: bool = True) -> tuple[B.Model, B.Model, DataFrame]:
    """Threshold loop (COT-01) with independent pools. Returns both models and the labels given, by step and view.

    Models are frozen per step: both views are scored before either grows.
    """
    m0, m1 = B.train(gold, "uni"), B.train(gold, "bi")
    p0 = p1 = pool.select(key, "uni", "bi")
    done = None
    for k in range(1, steps + 1):
        scored = []
        for tok, m, p, v in (("uni", m0, p0, v0), ("bi", m1, p1, v1)):
            s = B.score(p, m, tok, key, v=v).select(key, "p1", F.col("pred").alias("label"), (B.confidence() >= tau).alias("is_high"))
            j = p.join(s, key)
            scored.append(cut(j) if checkpoint else j)
        high0, high1 = (s.filter("is_high") for s in scored)
        if checkpoint and high0.isEmpty() and high1.isEmpty():
            break
        got = high0.select(F.lit(0).alias("view"), key, "label", F.lit(k).alias("step")).unionByName(high1.select(F.lit(1).alias("view"), key, "label", F.lit(k).alias("step")))
        done = got if done is None else done.unionByName(got)
        p0, p1 = (s.filter("not is_high").select(key, "uni", "bi") for s in scored)
        m0, m1 = B.add(m0, B.train(high1, "uni")), B.add(m1, B.train(high0, "bi"))
        if checkpoint:
            m0, m1 = (B.Model(cut(m.cond), cut(m.prior)) for m in (m0, m1))
    if done is None:
        done = pool.select(F.lit(0).alias("view"), key, F.lit(0).alias("label"), F.lit(0).alias("step")).filter("false")
    return m0, m1, done


def accuracy_by_step(gold: DataFrame, pool: DataFrame, test: DataFrame, tau: float = 0.65, steps: int = 6, key: str = "id", v0: int = B.UNI, v1: int = B.BI, checkpoint: bool = True) -> DataFrame:
    """(step, view, n, accuracy) on ``test`` of both views after each step of the threshold loop that labelled anything (COT-01).

    The labels a view got up to a step are added to its training counts, so the loop runs once.
    """
    done = loop(gold, pool, tau, steps, key, v0, v1, checkpoint)[2]
    if checkpoint:
        done = cut(done)
    last = done.agg(F.max("step")).first()[0] or 0
    out = done.sparkSession.createDataFrame([], "step int, view int, n long, accuracy double")
    for view, tok, v in ((0, "uni", v0), (1, "bi", v1)):
        new = done.filter(F.col("view") == 1 - view).select(key, "label", "step").join(pool.select(key, tok), key)
        m, extra = B.train(gold, tok), B.train(new, tok, by=("step",))
        for k in range(1, last + 1):
            upto = B.Model(extra.cond.filter(F.col("step") <= k).drop("step"), extra.prior.filter(F.col("step") <= k).drop("step"))
            s = B.score(test, B.add(m, upto), tok, key, ("label",), v)
            out = out.unionByName(s.agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy")).select(F.lit(k).alias("step"), F.lit(view).alias("view"), "n", "accuracy"))
    return out


def exchange(gold: DataFrame, pool: DataFrame, by: tuple[str, ...] = (), key: str = "id", models: tuple[B.Model, B.Model] | None = None, v0: int = B.UNI, v1: int = B.BI) -> tuple[B.Model, B.Model, DataFrame]:
    """Growth (COT-04): no threshold, each view labels the whole pool once for the other, both retrain.

    Returns the models and the pool labels (key, by..., uni_label, bi_label).
    """
    m0, m1 = models or (B.train(gold, "uni", by=by), B.train(gold, "bi", by=by))
    lab0 = label_all(m0, pool, "uni", key, v0, ("bi",))
    lab1 = label_all(m1, pool, "bi", key, v1, ("uni",))
    n0, n1 = B.add(m0, B.train(lab1, "uni", by=m0.by)), B.add(m1, B.train(lab0, "bi", by=m1.by))
    both = lab0.select(key, *m0.by, F.col("label").alias("uni_label")).join(lab1.select(key, *m0.by, F.col("label").alias("bi_label")), [key, *m0.by])
    return n0, n1, both


def holdout(gold: DataFrame, pool: DataFrame, key: str = "id", v0: int = B.UNI, v1: int = B.BI) -> B.Model:
    """One direction (COT-05): the bigram model labels the pool, the unigram model is retrained on the union."""
    lab = label_all(B.train(gold, "bi"), pool, "bi", key, v1, ("uni",))
    return B.add(B.train(gold, "uni"), B.train(lab, "uni"))
