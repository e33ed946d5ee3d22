"""Evaluation texts leaking into training text (problem 8): spaced-seed hashing.

Tokens are compared without case, punctuation, thread marks and look-alike
characters. A seed is two blocks of four words with a mask that ignores none or one
word between them; both masks hash the eight words alike, so a window of an item with
an ignored word meets one of the corpus with or without it: a changed word (1 and 1), a
dropped one (1 and 0) and an added one (0 and 1) are all tolerated inside a seed. Hashes
of all windows of corpus and items are joined, and every hit is verified by chaining
exact runs with a bounded share of edits.

Completeness: let n >= 14 item words have at most one in ten changed, dropped or added,
the first and the last of them intact. If no seed hit, no intact run had eight words and
no two runs beside one edit had four each, so the runs were at most 7, 3, 7, 3, ...: 10 words with
one edit, 17 with two, 20 with three, but 13, 18 and 27 are intact. So some seed hits. Eight
contiguous words alone would miss every passage of 14 to 16 words with an edit in its middle.
An edit that doubles a word or drops one of two equal neighbours lets the exact
runs on its sides overlap; the later one is trimmed.

NULL and empty texts hold nothing. Repeated documents are all reported; equal texts are
verified once. Items under ``least`` words cannot be found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import let
from lexloom.llm.lookalike import mapped
from lexloom.session import cut

HALF, GAPS = 4, (0, 1)  #: words of each block, and ignored words between the blocks
LEAST, ONE_IN = 14, 10
SALT = 32
BROADCAST_ROWS = 2_000_000  #: most rows of item hashes or of hits (some 16 bytes each) that are broadcast; beyond it the joins shuffle
# Marks that continue a thread.
MARKS = r"\[?\(?cont\.?\)?\]|\(?\b\d{1,2}\s?/\s?\d{1,2}\b\)?|\bthread\s?:|\(cont\.?\)"


def words(text: Column) -> Column:
    """Array of comparable words; apostrophes join, other punctuation separates."""
    s = F.lower(mapped(text))
    s = F.when(s.rlike("cont|thread|[0-9] ?/"), F.regexp_replace(s, MARKS, " ")).otherwise(s)
    s = F.translate(s, "'’`´", "")
    s = F.trim(F.regexp_replace(s, r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.filter(F.split(s, " "), lambda w: w != "")


def seeds(tokens: Column, gaps: Sequence[int] = GAPS) -> Column:
    """Hashes of all windows under all masks; a hash tells the words, not the mask."""
    at = lambda n: F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def of(blocks: Column) -> Column:
        return F.concat(*[F.transform(at(F.size(blocks) - HALF - g), lambda i: F.xxhash64(F.get(blocks, i), F.get(blocks, i + HALF + g))) for g in gaps])  # noqa: B023

    hashed = lambda t: let(F.transform(t, lambda w: F.xxhash64(w)), lambda h: F.transform(at(F.size(h) - HALF + 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(HALF)])))
    return let(hashed(tokens), of)


def leaked(doc: Sequence[str], item: Sequence[str], least: int = LEAST, one_in: int = ONE_IN) -> bool:
    """Whether ``doc`` holds ``least`` or more consecutive words of ``item`` with at most one in ``one_in`` edited."""
    where = defaultdict(list)
    for i, w in enumerate(item):
        where[w].append(i)
    runs: list[list[int]] = []  # item start, item end, doc start, doc end
    open_: dict[int, list[int]] = {}
    for j, w in enumerate(doc):
        now: dict[int, list[int]] = {}
        for i in where.get(w, ()):
            r = open_.get(i - 1)
            if r is not None:
                r[1], r[3] = i + 1, j + 1
            else:
                r = [i, i + 1, j, j + 1]
                runs.append(r)
            now[i] = r
        open_ = now
    if not runs:
        return False
    most = max(1, len(item) // one_in)
    runs.sort(key=lambda r: (r[3], r[1]))
    ends: dict[int, list[int]] = defaultdict(list)  # doc end: runs
    best: list[dict[int, int]] = []  # per run: edits: earliest item start
    for k, (i0, i1, j0, j1) in enumerate(runs):
        b = {0: i0}
        for je in range(j0 - most, j0 + most + 1):
            for p in ends.get(je, ()):
                pi1, pj1 = runs[p][1], runs[p][3]
                gi, gj = i0 - pi1, j0 - pj1
                trim = max(0, -gi, -gj)  # words of this run that its predecessor has already
                gi, gj = gi + trim, j0 + trim - pj1
                if trim < j1 - j0 and 0 <= gi <= most and 0 <= gj <= most and (gi or gj):
                    cost = max(gi, gj)
                    for e, st in best[p].items():
                        if e + cost <= most and st < b.get(e + cost, 1 << 30):
                            b[e + cost] = st
        for e, st in b.items():
            n = i1 - st
            if n >= least and e * one_in <= n:
                return True
        best.append(b)
        ends[j1].append(k)
    return False


@F.pandas_udf(T.BooleanType())
def verified(doc: pd.Series, item: pd.Series) -> pd.Series:
    return pd.Series([leaked(list(a), list(b)) for a, b in zip(doc, item)], dtype=bool)


def bounded(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and hinted for broadcast if it has at most BROADCAST_ROWS rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def candidates(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", gaps: Sequence[int] = GAPS) -> DataFrame:
    """(key, text_id, item_id) with any window in common; nothing but the hits is shuffled when the items are few."""
    tid = F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))
    a = docs.select(key, tid.alias("text_id"), F.explode(let(words(F.col(text)), lambda w: seeds(w, gaps))).alias("h"))
    b = items.select("item_id", F.explode(F.array_distinct(let(words(F.col("text")), lambda w: seeds(w, gaps)))).alias("h"))
    return a.join(bounded(b), "h").select(key, "text_id", "item_id").distinct()


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", gaps: Sequence[int] = GAPS) -> DataFrame:
    """(key, item_id) of every leak.

    The hits are written first. Each different text with a hit is verified once: while the hits are few they go to the
    documents, so no text is shuffled; else one document of each text is shuffled to its hits, and the verdicts are
    spread over SALT parts of each text, since one text may have very many copies.
    """
    hits = cut(candidates(docs, items, key, text, gaps))
    few = hits.count() <= BROADCAST_ROWS
    once_ = hits.groupBy("text_id", "item_id").agg(F.min(key).alias("__rep"))
    d = docs.select(F.col(key).alias("__rep"), F.col(text).alias("__t"))
    j = d.join(F.broadcast(once_), "__rep") if few else d.hint("merge").join(once_, "__rep")
    j = j.withColumn("__w", words(F.col("__t"))).join(bounded(items.select("item_id", words(F.col("text")).alias("__i"))), "item_id")
    ok = j.filter(verified(F.col("__w"), F.col("__i"))).select("text_id", "item_id").distinct()
    if few:
        return hits.join(F.broadcast(ok), ["text_id", "item_id"], "left_semi").select(key, "item_id")
    ok = ok.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return hits.withColumn("__s", F.pmod(F.xxhash64(key), F.lit(SALT)).cast("int")).join(ok, ["text_id", "item_id", "__s"], "left_semi").select(key, "item_id")


def by_item(found: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents that hold a passage of it."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
