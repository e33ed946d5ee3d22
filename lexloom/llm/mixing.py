"""Mixing sources to target weights (problem 9): capped water-filling.

Token counts come from a public tokenizer in Arrow batches, once, and are written to the
shared folder. The level L solves sum min(L * weight, size * most repetitions) = total over the
sources: it starts at total / sum of weights, sources that their repeat cap cannot bring to
L * weight are clamped at the cap, and the excess goes to the others in proportion, until
nothing changes. Each round is one aggregate over the table of sources, of which nothing but two sums reaches
the driver. Each document is then used floor(r) times, and once more with probability
r - floor(r) by a seeded hash.

Sources are compared without case and outer blanks. Documents whose source is NULL or has
no target are not in the mix; the report has a row for each such source, with its size,
share 0 and nothing used. A target without documents cannot be met and its weight goes to the
others. NULL texts have size 0.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

TOKENIZERS = "/opt/tokenizers"
BROADCAST_ROWS = 1_000_000  #: most sources whose repetitions are broadcast; beyond it the join shuffles


@lru_cache(maxsize=4)
def encoder(folder: str, name: str):
    """The tokenizer of a ``.tiktoken`` rank file, once per worker."""
    import tiktoken

    pat = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(f"{folder}/{name}") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("local", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


def n_tokens(folder: str = TOKENIZERS, name: str = "byte_bpe_multi_50k.tiktoken"):
    """A UDF that counts the tokens of a text; NULL counts 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoder(folder, name)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return count


def source_of(c: Column) -> Column:
    return F.lower(F.trim(c))


def fill(sources: DataFrame, total: float | None = None) -> DataFrame:
    """Adds ``repeat`` and ``clamped`` to (source, target_share, n_size, max_repeat), one row per source.

    ``total`` is the wanted size of the mix; by default the size of all documents of sources
    with a target. If all sources are clamped the mix is smaller than asked.
    """
    live = (F.col("target_share") > 0) & (F.col("max_repeat") > 0) & (F.col("n_size") > 0)
    src = cut(sources.withColumn("__live", F.coalesce(live, F.lit(False))).withColumn("__most", F.col("n_size") * F.col("max_repeat")))
    on = src.filter("__live")
    if total is None:
        total = on.agg(F.sum("n_size")).first()[0] or 0
    level, before = 0.0, None
    over = lambda x: F.lit(x) * F.col("target_share") > F.col("__most") + 1e-9
    while level != before:
        before = level
        kept, free = on.agg(F.coalesce(F.sum(F.when(over(level), F.col("__most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over(level), F.col("target_share"))), F.lit(0.0))).first()
        level = max(level, (float(total) - float(kept)) / float(free)) if free else level
    r = F.when(~F.col("__live"), 0.0).when(over(level), F.col("max_repeat")).otherwise(F.lit(level) * F.col("target_share") / F.col("n_size"))
    return src.withColumn("repeat", r.cast("double")).withColumn("clamped", F.col("__live") & over(level)).drop("__live", "__most")


def copies(key: Column, repeat: Column, seed: int) -> Column:
    """Whole repetitions, and one more by a seeded hash of the key for the fraction."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    whole = F.floor(repeat)
    return (whole + F.when(u < repeat - whole, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, total: float | None = None, size: Column | None = None, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): the documents in the mix with their number of copies, and per source what was reached.

    ``size`` is a document's size, by default its number of tokens.
    """
    size = n_tokens(folder)(F.col(text)) if size is None else size
    d = cut(docs.select(F.col(key).alias("__k"), source_of(F.col(source)).alias("__s"), F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens")))
    t = targets.select(source_of(F.col("source")).alias("__s"), "target_share", "max_repeat").filter("__s is not null").groupBy("__s").agg(F.sum("target_share").alias("target_share"), F.max("max_repeat").cast("double").alias("max_repeat"))
    have = d.groupBy("__s").agg(F.sum("n_tokens").alias("n_size"), F.count("*").alias("n_docs"))
    plan = t.join(have, "__s", "full").select("__s", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("n_size", F.lit(0)).alias("n_size"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_repeat", F.lit(0.0)).alias("max_repeat"))
    plan = cut(fill(plan, total))
    some = plan.filter("repeat > 0").select("__s", "repeat")
    some = F.broadcast(some) if plan.count() <= BROADCAST_ROWS else some.hint("merge")
    used = d.join(some, "__s").withColumn("copies", copies(F.col("__k"), F.col("repeat"), seed)).filter("copies > 0")
    chosen = used.select(F.col("__k").alias(key), F.col("__s").alias("source"), "n_tokens", "copies")
    got = used.groupBy("__s").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n_used"), F.sum("copies").alias("n_copies"))
    s = plan.join(got, "__s", "left").select(F.col("__s").alias("source"), "target_share", "n_docs", F.col("n_size").alias("n_tokens_source"), "max_repeat", "repeat", "clamped", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("n_used", F.lit(0)).alias("n_tokens_used"))
    all_ = s.agg(F.sum("n_tokens_used")).scalar()
    return chosen, s.withColumn("reached_share", F.coalesce(F.try_divide("n_tokens_used", all_), F.lit(0.0)))
