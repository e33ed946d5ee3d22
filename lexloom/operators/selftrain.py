"""Self-training. The model of a round is frozen before its predictions are used.

``gold`` and ``pool`` have the key, the token array and (gold) a 0/1 label. An
empty pool gives empty results; an empty gold set predicts from the smoothed prior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators import bayes as B
from lexloom.session import cut


def round_(gold: DataFrame, pool: DataFrame, tokens: str, key: str = "id", tau: float = 0.75, v: int = B.UNI, strict: bool = False) -> DataFrame:
    """One threshold split (SLF-01): every pool row with pred, p1 and is_high, so HIGH and LOW come from one pass."""
    s = B.score(pool, B.train(gold, tokens), tokens, key, v=v)
    c = B.confidence()
    return s.select(key, "p1", "pred", ((c > tau) if strict else (c >= tau)).alias("is_high"))


def label_all(model: B.Model, pool: DataFrame, tokens: str, key: str = "id", v: int = B.UNI, keep: tuple[str, ...] = ()) -> DataFrame:
    """The pool with ``label`` set to the prediction; ``keep`` names the columns kept besides key and model columns."""
    s = B.score(pool, model, tokens, key, v=v).select(key, *model.by, F.col("pred").alias("label"))
    return pool.select(key, *model.by, *keep).join(s, [key, *model.by])


def growth(gold: DataFrame, pool: DataFrame, tokens: str, key: str = "id", v: int = B.UNI) -> B.Model:
    """Label the whole pool, retrain on the union (SLF-03): only the pool's counts are added."""
    m = B.train(gold, tokens, by=())
    return B.add(m, B.train(label_all(m, pool, tokens, key, v, (tokens,)), tokens))


def loop(gold: DataFrame, pool: DataFrame, tokens: str, key: str = "id", tau: float = 0.75, rounds: int = 5, v: int = B.UNI, checkpoint: bool = True) -> tuple[B.Model, DataFrame]:
    """In-memory loop (SLF-02): HIGH rows (strictly above ``tau``) join the training counts, the pool shrinks to LOW.

    Stops early when no row leaves the pool. Returns the last model and every
    row that got a label, with ``round`` (from 1). With ``checkpoint`` the pool
    and the counts are cut to the shared folder each round.
    """
    model = B.train(gold, tokens)
    done = None
    for k in range(1, rounds + 1):
        s = B.score(pool, model, tokens, key, v=v).select(key, "p1", F.col("pred").alias("label"), (B.confidence() > tau).alias("is_high"))
        scored = pool.select(key, tokens).join(s, key)
        if checkpoint:
            scored = cut(scored)
        high = scored.filter("is_high")
        if checkpoint and high.isEmpty():
            break
        got = high.select(key, "label", "p1", F.lit(k).alias("round"))
        done = got if done is None else done.unionByName(got)
        pool = scored.filter("not is_high").select(key, tokens)
        model = B.add(model, B.train(high, tokens))
        if checkpoint:
            model = B.Model(cut(model.cond), cut(model.prior))
    if done is None:
        done = pool.select(key, F.lit(0).alias("label"), F.lit(0.0).alias("p1"), F.lit(0).alias("round")).filter("false")
    return model, done


def coin_labels(df: DataFrame, key: str = "id", salt: str = "coin") -> DataFrame:
    """Random-label baseline (NB-06): a reproducible hash coin instead of a random number."""
    return df.withColumn("label", F.when(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt))), 1, 1) < "8", 0).otherwise(1))
