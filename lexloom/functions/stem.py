"""English Snowball stemmer (Porter's second English algorithm, as published) as an Arrow-batched UDF."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the algorithm: words with a stem of their own, words that stay after step 1a, starts of region 1, suffixes by step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STARTS = ("gener", "commun", "arsen")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize"]
VALID_LI = "cdeghkmnrt"

_VOWEL = "[aeiouy]"
_REGION = re.compile(rf"{_VOWEL}[^aeiouy]")
_SHORT = re.compile(rf"(?:[^aeiouy]{_VOWEL}[^aeiouywxY]|^{_VOWEL}[^aeiouy])$")


def _regions(w: str) -> tuple[int, int]:
    """Where regions 1 and 2 start."""
    head = next((len(s) for s in STARTS if w.startswith(s)), None)
    if head is None:
        m = _REGION.search(w)
        head = m.end() if m else len(w)
    m = _REGION.search(w, head)
    return head, m.end() if m else len(w)


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def _step1(w: str, r1: int) -> str:
    s = _longest(w, ("eedly", "eed", "ingly", "ing", "edly", "ed"))
    if s is None:
        return w
    at = len(w) - len(s)
    if s.startswith("eed"):
        return w[:at] + "ee" if at >= r1 else w
    if not re.search(_VOWEL, w[:at]):
        return w
    w = w[:at]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(w) < 3:
        return w
    w = w.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in UNCHANGED:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"'(?:s'?)?$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(rf"{_VOWEL}.", w[:-1]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    w = _step1(w, r1)
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    s = _longest(w, (*STEP2, "ogi", "li"))
    if s and len(w) - len(s) >= r1:
        head = w[: -len(s)]
        if s in STEP2:
            w = head + STEP2[s]
        elif s == "ogi" and head.endswith("l"):
            w = head + "og"
        elif s == "li" and head[-1:] in VALID_LI and head:
            w = head
    s = _longest(w, (*STEP3, "ative"))
    if s and len(w) - len(s) >= r1:
        if s in STEP3:
            w = w[: -len(s)] + STEP3[s]
        elif len(w) - len(s) >= r2:
            w = w[: -len(s)]
    s = _longest(w, (*STEP4, "ion"))
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1]))) or (w.endswith("ll") and len(w) - 1 >= r2):
        w = w[:-1]
    return w.replace("Y", "y")


def stem_one(t: str) -> str:
    return "NOT_" + stem(t[4:]) if t.startswith("NOT_") else stem(t)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(col: pd.Series) -> pd.Series:
    """Stems of an array of tokens; NULL stays NULL, negation marks are kept."""
    return col.map(lambda a: None if a is None else [None if t is None else stem_one(t) for t in a])
