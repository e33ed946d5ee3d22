"""Text normalisation as native Column expressions (no Python in the hot path).

Every function maps NULL to NULL and the empty text to the empty text (or an
empty array). All are linear in the length of the text: token rewrites read a
token's neighbours by index instead of growing an accumulator.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import constants as K


def lit_map(d: Mapping[str, str]) -> Column:
    if not d:
        return F.expr("map()").cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lit_array(xs: Sequence[str] | Column) -> Column:
    if isinstance(xs, Column):  # the row's own part of a longer list, see operators.dictionaries
        return xs
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(s: Column) -> Column:
    """Non-empty tokens between single blanks."""
    return F.filter(F.split(s, " "), lambda t: t != "")


def normalize_ws(s: Column) -> Column:
    """Trim and collapse white space (TXT-01)."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def slang_replace(s: Column, slang: Mapping[str, str] | Column) -> Column:
    """Replace tokens by exact lookup; the result is split again only by later steps (TXT-02)."""
    m = slang if isinstance(slang, Column) else lit_map(slang)
    return F.array_join(F.transform(F.split(s, " "), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def drop_mentions(s: Column) -> Column:
    """Drop tokens that contain ``@`` or its full-width form (TXT-04)."""
    return F.array_join(F.filter(F.split(s, " "), lambda t: ~t.rlike("[@＠]")), " ")


def squeeze_repeats(s: Column) -> Column:
    """Shorten runs of lower-case letters (TXT-05): vowels to one, consonants to two, x untouched."""
    s = F.regexp_replace(s, r"([auijy])\1+", "$1")
    s = F.regexp_replace(s, r"([oe])\1{2,}", "$1")
    return F.regexp_replace(s, r"([bcdfghklmnpqrstvwz])\1{2,}", "$1$1")


def clear_text(s: Column) -> Column:
    """Delete links and ``#``, map ``. ! ? _`` to blanks, trim (TXT-03)."""
    s = F.regexp_replace(s, r"https?://\S+\s?", "")
    s = F.regexp_replace(s, r"http?://\S+\s?", "")
    s = F.regexp_replace(s, "#", "")
    return F.trim(F.translate(s, ".!?_", "    "))


def commas_to_blanks(s: Column) -> Column:
    """Commas become blanks (TXT-19), so a text can be a field of a comma-separated line."""
    return F.translate(s, ",", " ")


def _hits(s: Column, items: Sequence[str]) -> Column:
    return let(s, lambda v: F.filter(lit_array(sorted(items)), lambda e: F.contains(v, e)))


def happy(s: Column, items: Sequence[str] = tuple(K.HAPPY)) -> Column:
    """The distinct happy emoticons contained in the text, sorted (TXT-06)."""
    return F.when(s.isNotNull(), _hits(s, items))


def sad(s: Column, items: Sequence[str] = tuple(K.SAD)) -> Column:
    return F.when(s.isNotNull(), _hits(s, items))


def emotion(h: Column, s: Column) -> Column:
    """Emotion from the numbers of happy and sad emoticons (TXT-07)."""
    return (
        F.when((h == 0) & (s == 0), "neutral")
        .when((h > 0) & (s == 0), "positive")
        .when((s > 0) & (h == 0), "negative")
        .when(h > s, "semi_positive")
        .when(s > h, "semi_negative")
        .when(s == h, "unknown")
    )


def _negator(t: Column) -> Column:
    return t.rlike("(n't|not)$") | t.isin("nor", "neither")


def _no_negators(words: Sequence[str], what: str) -> None:
    bad = [w for w in words if w.endswith(("n't", "not")) or w in ("nor", "neither")]
    if bad:
        raise ValueError(f"{what} may not look like negators: {bad}")


def _at(a: Column, i: Column) -> Column:
    """Element at 0-based index, NULL outside."""
    return F.get(a, i)


def negate_verbs(s: Column, verbs: Sequence[str] | Column = tuple(K.VERBS)) -> Column:
    """A negator before a known verb becomes ``NOT_verb``; another gets ``n't`` spelled ``not`` (TXT-08).

    A verb consumed by its negator leaves an empty token. Verbs that look like
    negators are refused (left out of a Column of verbs), so a consumed token never acts as a negator and the
    left-to-right rewrite equals this index form.
    """
    if isinstance(verbs, Column):
        vs = F.filter(verbs, lambda t: ~_negator(t))
    else:
        _no_negators(verbs, "verbs")
        vs = lit_array(verbs)
    verb = lambda t: F.array_contains(vs, t)

    def one(a: Column, t: Column, i: Column) -> Column:
        nxt, prev = _at(a, i + 1), _at(a, i - 1)
        return (
            F.when(_negator(t) & nxt.isNotNull(), F.when(verb(nxt), F.concat(F.lit("NOT_"), nxt)).otherwise(F.replace(t, F.lit("n't"), F.lit("not"))))
            .when((i > 0) & _negator(prev) & verb(t), "")
            .otherwise(t)
        )

    return let(F.split(s, " "), lambda a: F.array_join(F.transform(a, lambda t, i: one(a, t, i)), " "))


def negate_adjectives(s: Column, antonyms: Sequence[tuple[str, str]] | Column = tuple(K.ANTONYMS)) -> Column:
    """``not good`` becomes ``bad``; a word such as ``very`` between is blanked (TXT-10).

    ``antonyms`` are pairs, or a map Column with both directions.
    """
    skip = lit_array(K.INTENSIFIERS)
    if isinstance(antonyms, Column):
        am = F.map_filter(antonyms, lambda k, v: ~_negator(k) & ~k.isin(*K.INTENSIFIERS))
    else:
        m: dict[str, str] = {}
        for x, y in antonyms:
            m[x] = y
            m[y] = x
        _no_negators(list(m), "adjectives")
        if set(m) & set(K.INTENSIFIERS):
            raise ValueError("adjectives may not be intensifiers")
        am = lit_map(m)
    neg = lambda t: F.coalesce(_negator(t), F.lit(False))
    far = lambda a, i: F.array_contains(skip, _at(a, i + 1)) & _at(a, i + 2).isNotNull()

    def one(a: Column, t: Column, i: Column) -> Column:
        reach = F.when(far(a, i), _at(a, i + 2)).otherwise(_at(a, i + 1))
        return (
            F.when(neg(t), F.coalesce(F.try_element_at(am, F.coalesce(reach, F.lit(""))), t))
            .when((i > 0) & neg(_at(a, i - 1)) & F.coalesce(far(a, i - 1), F.lit(False)), "")
            .when((i > 0) & neg(_at(a, i - 1)) & F.map_contains_key(am, t), "")
            .when((i > 1) & neg(_at(a, i - 2)) & F.coalesce(far(a, i - 2), F.lit(False)) & F.map_contains_key(am, t), "")
            .otherwise(t)
        )

    return let(F.split(s, " "), lambda a: F.array_join(F.transform(a, lambda t, i: one(a, t, i)), " "))


def strip_non_ascii(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\x00-\x7F]", "")


def letters_only(s: Column) -> Column:
    """Everything but letters, separators and ``_`` becomes a blank (TXT-13); ``_`` keeps negation tags whole."""
    return F.regexp_replace(s, r"[^\p{L}\p{Z}_]", " ")


def drop_short_words(s: Column) -> Column:
    """Drop words of one or two characters (TXT-12); meant for ASCII text."""
    return F.regexp_replace(s, r"\b[\w']{1,2}\b", "")


def remove_stopwords(s: Column, words: Sequence[str] | Column = tuple(K.STOPWORDS)) -> Column:
    """Drop tokens that are stop-words; repeated other words stay (TXT-14)."""
    w = lit_array(words)
    return F.array_join(F.filter(F.split(s, " "), lambda t: ~F.array_contains(w, t)), " ")


def bigrams(toks: Column) -> Column:
    """Adjacent pairs ``w1_w2``; fewer than two tokens give an empty array (TXT-15)."""


    def pairs(a: Column) -> Column:
        n = F.greatest(F.size(a) - 1, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), lambda x, y: F.concat(x, F.lit("_"), y))

    return let(toks, pairs)


def preprocess(text: Column, slang: Mapping[str, str] | Column, verbs: Sequence[str] = tuple(K.VERBS), antonyms: Sequence[tuple[str, str]] = tuple(K.ANTONYMS), stopwords: Sequence[str] = tuple(K.STOPWORDS), counting_only: bool = False) -> tuple[Column, Column]:
    """The whole chain (TXT-20): the text in which emoticons are counted, and the cleaned text.

    ``counting_only`` gives the variant of the word counter, without lower-casing,
    the first slang pass and stop-words.
    """
    s = text if counting_only else slang_replace(F.lower(text), slang)
    s = normalize_ws(squeeze_repeats(drop_mentions(clear_text(s))))
    s = normalize_ws(slang_replace(s, slang))
    marked = s
    s = normalize_ws(negate_verbs(s, verbs))
    s = normalize_ws(negate_adjectives(s, antonyms))
    s = normalize_ws(drop_short_words(letters_only(strip_non_ascii(s))))
    if not counting_only:
        s = normalize_ws(remove_stopwords(s, stopwords))
    return marked, s
