"""Visually identical text with different characters (problem 5).

1. Every text gets a 128-bit hash of its skeleton: look-alike characters mapped,
   accents and invisible characters dropped, by native string functions. Canonically
   equivalent spellings share it, so only texts whose skeleton another text has can
   look like one; all others are a class of their own, and their text is not shuffled.
2. The mapped forms of these few are grouped under the accent- and case-sensitive
   UNICODE collation, which treats canonically equivalent accents as equal and ignores
   invisible characters. It also equates digits of different scripts, which do not look
   alike; their skeletons differ, so such texts stay apart.
3. Each class gets a deterministic canonical member, one of its own texts: the one with
   the fewest letters foreign to its main script, then the fewest odd characters
   (full-width, invisible, decomposed), then the shortest, then the smallest id. It is joined back.

NULL texts form no class. Empty and all-invisible texts are one class. Exact copies
are one row until the end.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut

# Letters drawn like a Latin letter (Cyrillic, Greek, Armenian, Cherokee).
CYRILLIC = "аеорсухіѕјһԁԛԝӏАВЕКМНОРСТУХІЅЈҮԚԜёЁїЇ"
AS_LATIN = "aeopcyxisjhdqwlABEKMHOPCTYXISJYQWëËïÏ"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνρυϲϳ"
GREEK_AS_LATIN = "oABEZHIKMNOPTYXvpucj"
OTHER = "օսհոցզՕՍᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ"
OTHER_AS_LATIN = "ouhngqOUDRTAJEWMHYGZ4RWVSLCPKB"
# Blanks, hyphens and quotes in one form.
BLANKS = "               　"
HYPHENS = "‐‑"
INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿︎️"
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
FULL_AS = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
# Mathematical and letter-like forms of ASCII letters and digits, by their compatibility decomposition.
MATH = "".join(chr(c) for r in (range(0x2100, 0x2150), range(0x1D400, 0x1D800)) for c in r if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n.isascii() and n != chr(c))
MATH_AS = unicodedata.normalize("NFKC", MATH)

FROM = CYRILLIC + GREEK + OTHER + BLANKS + HYPHENS + FULL + MATH
TO = AS_LATIN + GREEK_AS_LATIN + OTHER_AS_LATIN + " " * len(BLANKS) + "-" * len(HYPHENS) + FULL_AS + MATH_AS
assert len(FROM) == len(TO)


def _skeletons() -> tuple[str, str]:
    """Every character whose skeleton is another one: look-alikes, and letters with accents as their base letter."""
    like = dict(zip(FROM, TO))
    out = {}
    for c in [*FROM, *(chr(i) for r in (range(0xC0, 0xAC00), range(0xF900, 0xFE00), range(0x1F000, 0x30000)) for i in r)]:
        m = unicodedata.normalize("NFD", like.get(c, c))[0]
        if (m := like.get(m, m)) != c:
            out[c] = m
    return "".join(out), "".join(out.values())


SKELETON_FROM, SKELETON_TO = _skeletons()
_PLAIN = r"^\p{ASCII}*$"
_DROPPED = r"[\p{M}\p{C}\u1100-\u11FF\uA960-\uA97F\uAC00-\uD7FF]"  # marks, invisible characters, Hangul (composed or not)
BLOCK = 1_000  #: rows of a class or of a text's copies that one task pairs with as many others


def _ligatures(text: Column) -> Column:
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def mapped(text: Column) -> Column:
    """The text with look-alike characters mapped; invisible characters removed, accents left as they are."""
    return F.when(text.rlike(_PLAIN), text).otherwise(F.translate(_ligatures(text), FROM + INVISIBLE, TO))


def skeleton(text: Column) -> Column:
    """Equal for all texts whose mapped forms are canonically equivalent but for invisible characters, and for some others."""
    odd = F.translate(_ligatures(text), SKELETON_FROM, SKELETON_TO)
    return F.regexp_replace(F.when(text.rlike(_PLAIN), text).otherwise(odd), _DROPPED, "")


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]", ""))


def foreign(text: Column) -> Column:
    """Letters that are not of the text's main script: that of most letters which no other script has, else of most letters."""
    letters, cyr = _count(text, r"\p{L}"), _count(text, r"\p{IsCyrillic}")
    own_cyr, own_lat = _count(F.translate(text, CYRILLIC, ""), r"\p{IsCyrillic}"), _count(F.translate(text, AS_LATIN, ""), r"\p{IsLatin}")
    lat = _count(text, r"\p{IsLatin}")
    russian = (own_cyr > own_lat) | ((own_cyr == own_lat) & (cyr > lat))
    return letters - F.when(russian, cyr).otherwise(lat)


def odd(text: Column) -> Column:
    """Characters with a plainer form that looks the same, whatever their script: full-width, mathematical, blanks, invisible, marks."""
    plainer = F.translate(text, BLANKS + HYPHENS + FULL + MATH + INVISIBLE + "".join(a for a, _ in LIGATURES), "")
    return F.length(text) - F.length(F.regexp_replace(plainer, r"\p{M}", ""))


def _id(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "utf-8")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, members).

    texts: text_id, n_docs (equal copies), class_id, n_texts, class_docs and ``text``, one row per distinct
    text of a class with several texts; class_id is the text_id (the MD5) of the canonical member.
    members: key, text_id of every document with a text. Texts missing from ``texts`` are their own class.
    """
    d = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("text"))
    sk = skeleton(F.col("text"))
    members = d.select("__k", _id(F.col("text")).alias("text_id"), F.struct(F.xxhash64(F.lit(1), sk).alias("a"), F.xxhash64(F.lit(2), sk).alias("b")).alias("sk"))
    ids = members.groupBy("text_id").agg(F.first("sk").alias("sk"), F.min("__k").alias("__rep"), F.count("*").alias("n_docs"))
    several = ids.groupBy("sk").agg(F.count("*").alias("n")).filter("n > 1").select("sk")
    cand = ids.join(several, "sk", "left_semi").select("text_id", "n_docs", "__rep", "sk")
    # one document of each candidate text brings it, so a text with many copies is fetched once; texts are never broadcast
    t = d.hint("merge").join(cand, F.col("__k") == F.col("__rep")).select("text_id", "text", "n_docs", "sk").withColumn("form", F.collate(mapped(F.col("text")), "UNICODE"))
    rank = F.struct(foreign(F.col("text")).alias("f"), odd(F.col("text")).alias("o"), F.length("text").alias("n"), "text_id")
    canon = t.groupBy("sk", "form").agg(F.min(rank).getField("text_id").alias("class_id"), F.count("*").alias("n_texts"), F.sum("n_docs").alias("class_docs")).filter("n_texts > 1")
    texts = cut(t.hint("merge").join(canon, ["sk", "form"]).select("text_id", "text", "n_docs", "class_id", "n_texts", "class_docs"))  # used several times below
    return texts, members.select(F.col("__k").alias(key), "text_id")


def _hex(c: str) -> Column:
    return F.lower(F.hex(c))


def canonical(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, class_id, n_links, canonical_text, changed: every document with the one form of its class.

    n_links is the number of documents that look the same and are written differently. The canonical
    text is that of a member; ``changed`` marks the documents that differ from it.
    """
    texts, members = classes(docs, key, text)
    best = texts.filter(F.col("text_id") == F.col("class_id")).select("class_id", F.col("text").alias("best"))
    t = texts.join(best.hint("merge"), "class_id").select("text_id", "class_id", (F.col("class_docs") - F.col("n_docs")).alias("n_links"), F.when(F.col("text_id") != F.col("class_id"), F.col("best")).alias("best"))
    d = docs.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("__t"), _id(F.col(text)).alias("text_id"))
    j = d.hint("merge").join(t, "text_id", "left")
    return j.select(key, _hex("class_id").alias("c"), _hex("text_id").alias("i"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("best", "__t").alias("canonical_text"), F.col("best").isNotNull().alias("changed")).select(
        key, F.coalesce("c", "i").alias("class_id"), "n_links", "canonical_text", "changed"
    )


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def _block_of(c: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(c), _blocks(n)).cast("int")


def pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (a < b) of documents that look the same and are not equal.

    Different texts are paired first, then expanded to documents, so equal
    copies are never compared with each other: the work is that of the result.
    Large classes and popular texts are cut into blocks, and each pair of blocks is a group of its own.
    """
    texts, members = classes(docs, key, text)
    t = texts.select("text_id", "class_id", "n_docs", "n_texts", _block_of("text_id", F.col("n_texts")).alias("b"))
    every = F.explode(F.sequence(F.lit(0), _blocks(F.col("n_texts")) - 1))
    a = t.select("class_id", F.col("b").alias("i"), every.alias("j"), "text_id", "n_docs")
    b = t.select("class_id", every.alias("i"), F.col("b").alias("j"), F.col("text_id").alias("other_id"), F.col("n_docs").alias("other_docs"))
    tp = a.join(b, ["class_id", "i", "j"]).filter("text_id < other_id").select("text_id", "other_id", "n_docs", "other_docs")

    def expand(tp: DataFrame, on: str, n: str, to: str) -> DataFrame:
        m = members.join(texts.select("text_id", "n_docs"), "text_id").select(F.col(key).alias(to), F.col("text_id").alias(on), _block_of(key, F.col("n_docs")).alias("b"))
        return tp.withColumn("b", F.explode(F.sequence(F.lit(0), _blocks(F.col(n)) - 1))).join(m, [on, "b"]).drop("b", on)

    j = expand(expand(tp, "text_id", "n_docs", "x"), "other_id", "other_docs", "y")
    return j.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
