"""Missing or wrong language labels (problem 6): multilingual mixture inference.

Each language has character n-gram and word likelihoods, fitted on the clean
sample sentences and then on a bounded sample of documents whose label and
content agree. A document is a mixture: expectation-maximisation estimates its
language proportions from the words' likelihoods, and languages are added to its
set while the penalised likelihood rises, or for the gain of one run of words
over the best path so far, whatever the length of the text. Words are then assigned by the best
path through the fitted mixture: starts and switches go to a language by its proportion. That
gives the segments; the confidence is the mean posterior of a segment's words under the
mixture (of a document: its words' for its main language).

Words exclude hashtags, mentions, links, e-mail addresses and numbers; proper
names are about equally likely everywhere and join their neighbours. NULL and
wordless texts have no language (NULL) and no segments.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import lookalike as L

SAMPLE = 16_000  #: most labelled documents used for the fit
ORDER, LEAST_WORDS = 5, 4
SWITCH, PENALTY, LOCAL = 8.0, 6.0, 11.0  #: LOCAL: what a run must gain over its two switches
OTHERS = 0.05  #: share of the mixture that the languages not chosen keep
_INV = {ord(c): None for c in L.INVISIBLE}
_BASE = _INV | {ord(a): b for a, b in zip(L.BLANKS + L.HYPHENS + L.FULL, " " * len(L.BLANKS) + "-" * len(L.HYPHENS) + L.FULL_AS)} | {ord(a): b for a, b in L.LIGATURES} | {ord("’"): "'"}
_TO_LATIN = {ord(a): b for a, b in zip(L.CYRILLIC + L.GREEK, L.AS_LATIN + L.GREEK_AS_LATIN)}
_TO_CYR = {ord(b): a for a, b in reversed(list(zip(L.CYRILLIC, L.AS_LATIN))) if a in "аеорсухАВЕКМНОРСТХУёЁ"} | {ord(a): b for a, b in zip("οΑΒΕΗΚΜΝΟΡΤΥΧ", "оАВЕНКМNОРТУХ") if b != "N"}
_ODD = set("ѕіјһԁԛԝӏЅЈІҮԚԜїЇ" + L.GREEK)  # look-alikes that no Russian text has
_SKIP = re.compile(r"\w*://\S+|\S*@\S+|[#＃]\w+|&\w+;")
_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")


def words(text: str | None) -> list[str]:
    """Lower-case words in text order; a word's look-alike letters are brought to its main script."""
    if not text:
        return []
    t = unicodedata.normalize("NFC", text.translate(_BASE))
    t = _SKIP.sub(" ", t)
    if t.isascii():
        return [w.lower() for w in _WORD.findall(t)]
    russian = sum("Ѐ" <= c <= "ӿ" and ord(c) not in _TO_LATIN for c in t)
    foreign = russian == 0 or sum(c in _ODD for c in t) > russian
    out = []
    for w in _WORD.findall(t):
        if not w.isascii():
            only = any("Ѐ" <= c <= "ӿ" and ord(c) not in _TO_LATIN for c in w)
            odd = any(c in _ODD for c in w)
            latin = any(c < "ɐ" for c in w)
            w = w.translate(_TO_CYR if only or not (odd or foreign or latin) else _TO_LATIN)
        out.append(w.lower())
    return out


@dataclass
class Model:
    langs: tuple[str, ...]
    grams: dict[str, np.ndarray]  #: character n-gram: log-probability of its last character by language
    floor: np.ndarray
    vocab: dict[str, np.ndarray]  #: word: log-probability by language
    unseen: np.ndarray
    cache: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, w: str) -> np.ndarray:
        v = self.cache.get(w)
        if v is None:
            v = self._word(w)
            if len(self.cache) < 200_000:
                self.cache[w] = v
        return v

    def _word(self, w: str) -> np.ndarray:
        s = f" {w} "
        total = np.zeros(len(self.langs))
        for i in range(1, len(s)):
            for n in range(ORDER, 0, -1):
                if i - n + 1 < 0:
                    continue
                g = self.grams.get(s[i - n + 1 : i + 1])
                if g is not None:
                    total += g
                    break
            else:
                total += self.floor
        known = self.vocab.get(w)
        v = 0.5 * total + 0.5 * (known if known is not None else self.unseen + total - np.max(total))
        return np.maximum(v, v.max() - 12.0)  # one word never decides alone

    def matrix(self, ws: Sequence[str]) -> np.ndarray:
        return np.array([self.word(w) for w in ws])


def fit(texts: list[tuple[str, list[str]]], langs: tuple[str, ...]) -> Model:
    """``texts``: (language, words)."""
    k = len(langs)
    at = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    vocab: dict[str, np.ndarray] = {}
    for lang, ws in texts:
        i = at[lang]
        for w in ws:
            vocab.setdefault(w, np.zeros(k))[i] += 1
    for w, c in vocab.items():
        s = f" {w} "
        c = np.sqrt(c)  # a frequent word is not more typical of a language's spelling
        for i in range(1, len(s)):
            for n in range(1, ORDER + 1):
                if i - n + 1 >= 0:
                    g = s[i - n + 1 : i + 1]
                    counts.setdefault(g, np.zeros(k))
                    counts[g] += c
    total = sum((c for g, c in counts.items() if len(g) == 1), np.zeros(k))
    context: dict[str, np.ndarray] = {}
    for g, c in counts.items():
        if len(g) > 1:
            context.setdefault(g[:-1], np.zeros(k))
            context[g[:-1]] += c
    probs: dict[str, np.ndarray] = {}
    base = 1.0 / 200
    for g in sorted(counts, key=len):
        if len(g) == 1:
            probs[g] = (counts[g] + 0.5 * base * total.clip(1) * 0.02) / (total.clip(1) * 1.01)
        else:
            lower = probs.get(g[1:], np.full(k, base))
            probs[g] = (counts[g] + 2.0 * lower) / (context[g[:-1]] + 2.0)
    n_words = sum(vocab.values(), np.zeros(k)).clip(1)
    return Model(
        langs,
        {g: np.log(p.clip(1e-9)) for g, p in probs.items()},
        np.full(k, math.log(1e-4)),
        {w: np.log((c + 0.02) / n_words) for w, c in vocab.items()},
        np.log(0.02 / n_words),
    )


def proportions(like: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Proportions of languages by EM from the words' likelihoods (words x languages)."""
    n, k = like.shape
    p = np.full(k, 1.0 / k)
    for _ in range(rounds if k > 1 else 0):
        p = p * ((1.0 / (like @ p).clip(1e-300)) @ like) / n
    return p


def mixture(ll: np.ndarray, rounds: int = 12, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """Language set and proportions of a document from its words' log-likelihoods (words x languages).

    Starts from the best single language and adds the language that raises the likelihood most,
    while the gain exceeds ``penalty`` times the logarithm of the number of words; proportions by EM.
    """
    n = len(ll)
    like = np.exp(ll - ll.max(axis=1, keepdims=True))

    def em(s: list[int]) -> tuple[float, np.ndarray]:
        x = like[:, s]
        p = proportions(x, rounds)
        return float(np.log((x @ p).clip(1e-300)).sum()), p

    chosen = [int(ll.sum(axis=0).argmax())]
    value, p = em(chosen)
    cost = penalty * math.log(max(n, 3))
    while len(chosen) < ll.shape[1] and len(chosen) < max(1, n // LEAST_WORDS):
        rest = [j for j in range(ll.shape[1]) if j not in chosen]
        have = ll[:, chosen].max(axis=1)
        rest = [j for j in rest if np.maximum(ll[:, j] - have, 0).sum() > cost and (ll[:, j] > have).sum() >= LEAST_WORDS]  # else no gain can reach the cost
        if not rest:
            break
        top = max(((em([*chosen, j]), j) for j in rest), key=lambda t: t[0][0])
        if top[0][0] - value <= cost:
            break
        chosen.append(top[1])
        value, p = top[0]
    # a language that others explain by now is dropped again
    for j in list(chosen):
        if len(chosen) > 1:
            less = [i for i in chosen if i != j]
            v, q = em(less)
            if value - v <= cost:
                chosen, value, p = less, v, q
    return chosen, p


def path(ll: np.ndarray, chosen: list[int], p: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word: a text starts in, and a switch goes to, a language with its proportion ``p``; each switch costs ``switch`` besides."""
    if len(chosen) == 1:
        return np.full(len(ll), chosen[0])
    x = ll[:, chosen]
    into = np.log(p.clip(1e-3))
    n, k = x.shape
    back = np.zeros((n, k), dtype=np.int64)
    cur = x[0] + into
    for i in range(1, n):
        j = int(cur.argmax())
        jump = cur[j] - switch + into
        back[i] = np.where(cur >= jump, np.arange(k), j)
        cur = np.maximum(cur, jump) + x[i]
    out = np.zeros(n, dtype=np.int64)
    out[-1] = int(cur.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return np.array(chosen)[out]


def posterior(ll: np.ndarray, chosen: list[int], p: np.ndarray) -> np.ndarray:
    """Posterior of each word's language under the fitted mixture; all languages together keep a share of OTHERS."""
    q = np.full(ll.shape[1], OTHERS / ll.shape[1])
    q[chosen] += (1 - OTHERS) * p
    post = np.exp(ll - ll.max(axis=1, keepdims=True)) * q
    return post / post.sum(axis=1, keepdims=True)


def runs_of_others(ll: np.ndarray, chosen: list[int], local: float = LOCAL) -> list[int]:
    """``chosen`` and the languages of which a run of LEAST_WORDS or more words gains over the best path more than its two switches and ``local`` cost.

    LEAST_WORDS words of the run must lean to the language.
    """
    chosen = list(chosen)
    n = len(ll)
    while n >= LEAST_WORDS and len(chosen) < ll.shape[1]:
        have = ll[np.arange(n), path(ll, chosen, np.ones(len(chosen)))]
        top, add = 2 * SWITCH + local, None
        for j in range(ll.shape[1]):
            d = ll[:, j] - have
            if j in chosen or np.maximum(d, 0).sum() <= top:
                continue
            s = np.concatenate([[0.0], np.cumsum(d)])
            low = np.minimum.accumulate(s[: n - LEAST_WORDS + 1])
            b = int((s[LEAST_WORDS:] - low).argmax())
            a = int(s[: b + 1].argmin())
            gain = s[b + LEAST_WORDS] - s[a]
            if gain > top and (d[a : b + LEAST_WORDS] > 0).sum() >= LEAST_WORDS:
                top, add = gain, j
        if add is None:
            break
        chosen.append(add)
    return chosen


def analyse(text: str | None, m: Model) -> tuple[str | None, float, list[tuple[str, int, int, float]], dict[str, float]]:
    """(language, confidence, segments (language, first word, words, confidence), proportions) of a text."""
    ws = words(text)
    if not ws:
        return None, 0.0, [], {}
    ll = m.matrix(ws)
    chosen, p = mixture(ll)
    more = runs_of_others(ll, chosen)
    if len(more) > len(chosen):
        chosen, p = more, proportions(np.exp(ll - ll.max(axis=1, keepdims=True))[:, more])
    lang = path(ll, chosen, p)
    post = posterior(ll, chosen, p)
    runs: list[list[int]] = []
    for i, x in enumerate(lang):
        if runs and runs[-1][0] == x:
            runs[-1][2] += 1
        else:
            runs.append([int(x), i, 1])
    kept: list[list[int]] = []
    for r in runs:  # short runs make no segment; what they part stays one
        if r[2] >= LEAST_WORDS:
            if kept and kept[-1][0] == r[0]:
                kept[-1][2] = r[1] + r[2] - kept[-1][1]
            else:
                kept.append(r)
    segs = [(m.langs[x], a, n, round(float(post[a : a + n, x].mean()), 4)) for x, a, n in kept]
    main = max(set(lang.tolist()), key=lambda x: (int((lang == x).sum()), -x))
    return m.langs[main], round(float(post[lang == main, main].mean()), 4), segs, {m.langs[j]: round(float(q), 4) for j, q in zip(chosen, p)}


def label_code(c: Column) -> Column:
    """First two letters of a label in lower case; NULL if missing (NULL, empty, ``und``)."""
    t = F.lower(F.trim(c))
    return F.when((t != "") & (t != "und"), F.substring(t, 1, 2))


def train(samples: DataFrame, docs: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE) -> Model:
    """Model from clean sentences (lang, text) and at most ``most`` labelled documents that agree with it, spread over the languages."""
    from pyspark.sql import Window as W

    def sample(d: DataFrame, by: str, n: int, *order: Column | str) -> DataFrame:
        return d.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("r") <= n)

    clean = samples.select("lang", "text").filter("lang is not null and text is not null")
    k = max(1, clean.select("lang").distinct().count())
    rows = [(r[0], words(r[1])) for r in sample(clean, "lang", max(1, most // k), F.xxhash64("text"), "text").select("lang", "text").collect()]
    langs = tuple(sorted({r[0] for r in rows}))
    m = fit(sorted(rows), langs)
    if docs is None or not langs:
        return m
    code = label_code(F.col(lang))
    d = docs.select(key, F.col(text).alias("t"), code.alias("l")).filter(F.col("l").isin(*langs) & F.col("t").isNotNull())
    d = sample(d, "l", max(1, most // len(langs)), F.xxhash64(key), key)
    extra = []
    for r in sorted(d.select("l", "t").collect()):
        got, _, segs, _ = analyse(r.t, m)
        if got == r.l and len({s[0] for s in segs}) == 1:
            extra.append((r.l, words(r.t)))
    return fit(sorted(rows) + extra, langs)


def detect(docs: DataFrame, m: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, carry..., lang, confidence, proportions, segments of each document, in one pass without shuffle."""

    @F.pandas_udf("struct<lang:string,confidence:double,proportions:map<string,double>,segments:array<struct<seg_no:int,lang:string,first_word:int,n_words:int,confidence:double>>>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        rows = [analyse(t, m) for t in texts]
        return pd.DataFrame(
            {
                "lang": [r[0] for r in rows],
                "confidence": [r[1] for r in rows],
                "proportions": [r[3] for r in rows],
                "segments": [[{"seg_no": i + 1, "lang": s[0], "first_word": s[1], "n_words": s[2], "confidence": s[3]} for i, s in enumerate(r[2])] for r in rows],
            }
        )

    return docs.select(key, *carry, F.explode(F.array(udf(F.col(text)))).alias("__r")).select(key, *carry, "__r.*")


def relabelled(detected: DataFrame, label: str) -> DataFrame:
    """Segments of the documents whose label is missing or wrong or whose segments differ in language."""
    n = F.size(F.array_distinct(F.col("segments.lang")))
    right = F.coalesce(label_code(F.col(label)) == F.col("segments")[0].getField("lang"), F.lit(False))
    return detected.filter((F.size("segments") > 0) & ((n > 1) | ~right))


