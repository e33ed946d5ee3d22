"""Personal information inside free text (problem 4): detection, and typed format-preserving placeholders.

Patterns find e-mail addresses, phone and identity numbers and street
addresses, on a copy of the text in which look-alike characters are plain and
whose positions map back to the original. Names are a known given name or
initial with a known family name; as name lists are incomplete, they are
extended from the corpus: a word that stands beside known names in most of its
occurrences, with several different partners, is a name. All documents are read
once for this: their words and word pairs are counted, with partial counts in each task, and the
rounds of learning join these counts with the growing list. Known given names that are mostly used as common
words need a known family name beside them and never serve as evidence.

``protect`` finds the pieces of a row and makes their placeholders in one pass: numbers become
another number of their format by a keyed Feistel permutation (``formats``), valid if they are
valid, so equal values stay linked; e-mail addresses, streets and names carry a keyed tag of 96 bits.
Dates are left alone unless ``dates`` is set, which permutes ISO dates from 1900 to 2099.

NULL and empty texts hold nothing; NULL stays NULL when redacting. Repeated
documents are all reported. Overlapping finds are resolved in the order e-mail,
identity number, phone, street, name, so each character belongs to one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import formats
from lexloom.llm import lookalike as L
from lexloom.llm.feistel import permute_date
from lexloom.session import cut

MAX_WORDS = 500_000  #: most name words that travel with the tasks; beyond it each document is joined with those it holds
BROADCAST_ROWS = 500_000  #: most name words that are broadcast to the counts of pairs; beyond it the join shuffles
_TR: dict[int, str | None] = {ord(a): b for a, b in zip(L.FROM, L.TO)} | {ord(c): None for c in L.INVISIBLE} | {ord(a): b for a, b in L.LIGATURES} | {ord("’"): "'"}
del _TR[ord("ё")], _TR[ord("Ё")]


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text with plain characters and, unless it was plain, the original position of each."""
    if text.isascii():
        return text, None
    out, idx = [], []
    for i, c in enumerate(text):
        r = _TR.get(ord(c), c)
        if r:
            out.append(r)
            idx.extend([i] * len(r))
    return "".join(out), idx


# ---- patterns -----------------------------------------------------------------------------
_HOST = r"[A-Za-z0-9](?:[\w-]*\w)?"
EMAIL = re.compile(
    rf"(?<![\w.+@-])\w[\w.+-]*(?:(?:@| @ ){_HOST}(?:\.{_HOST})+|\s?(?:\(at\)|\[at\]|\{{at\}})\s?{_HOST}(?:(?:\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?|\.){_HOST})+|\sat\s{_HOST}(?:\sdot\s{_HOST})+)",
    re.I,
)
_D = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
PHONE = re.compile(
    r"(?<![\w+.,/-])(?:"
    r"\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d(?:[ .\-/]?\d){6,12}"
    r"|00[ .-]?\d{1,3}(?:[ .\-]\d{2,4}){2,4}"
    r"|\(\d{3,4}\) ?\d{3}[ .-]?\d{3,4}"
    r"|[2-9]\d{2}([-. ])[2-9]\d{2}\1\d{4}"
    r"|0\d([ .])\d{2}(?:\2\d{2}){3}"
    r"|0\d{4} \d{6}|0\d{2,4}[ /-]\d{3,6}(?:[ -]\d{2,6})?|0\d{9,10}|[2-9]\d{2}[2-9]\d{6}"
    rf"|{_D}(?:[ -]{_D}){{6,12}}"
    r")(?![\w]|[.,/-]\d)",
    re.I,
)
ID = re.compile(
    r"(?<![\w+.,/-])(?:"
    r"\d{3}([- ]?)\d{2}\1\d{4}"
    r"|[A-Z]{2}( ?)\d{2}\2\d{2}\2\d{2}\2[A-D]"
    r"|X[A-Z]?\d{7}|[A-Z]\d{3}[A-Z]\d{4}|[A-Z]{2}\d{7}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]"
    r"|[1-9]( ?)\d{2}\3\d{2}\3\d{2}\3\d{3}\3\d{3}\3\d{2}"
    r")(?![\w]|[.,/-]\d)",
    re.I,
)
_NUM = r"\d{1,4}[a-z]?"
STREET = re.compile(
    rf"(?<![\w.,:/-])(?:{_NUM},? (?:Old |New |Upper |Lower )?(?P<en>[^\W\d_][\w'-]+) (?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Close|Crescent|Court|Drive|Way|Terrace|Place)\b"
    rf"|{_NUM},? (?:bis |ter )?(?:rue|avenue|boulevard|allée|chemin|impasse) (?:de |du |des |de la )?(?P<fr>[^\W\d_][\w'-]+)"
    rf"|(?:calle|avenida|avda\.?|plaza|paseo|camino|rua|travessa|via|viale|piazza|corso) (?:de |del |de la |da |do |della )?(?P<es>[^\W\d_][\w'-]+),? {_NUM}"
    rf"|(?P<de>[^\W\d_]+(?:straße|strasse|weg|allee|gasse|platz|straat|laan)) {_NUM}"
    rf"|(?:улица|ул\.) (?P<ru>[^\W\d_][\w'-]+),? {_NUM})(?!\w)",
    re.I,
)
_W = r"[^\W\d_](?:[^\W\d_]|['-](?=[^\W\d_]))*"
WORD = re.compile(_W)
_PAIR = re.compile(rf"(?=(?<![\w@#'.+-])({_W}|[^\W\d_]\.)( |\n|, )(?:([^\W\d_]\.) )?({_W})(?![\w@+]|[._-]\w))")
_GIVEN_NEXT = re.compile(rf", ({_W})")
_LOCAL = re.compile(r"(?<![\w.])([a-z]{2,})[._]([a-z']{2,})\d*\s?(?:@|\(at\)|\[at\]| at )", re.I)
_DATE = re.compile(r"(?<![\w./-])(19\d\d|20\d\d)-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?![\w/-]|\.\d)")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z']+")


def _key(w: str) -> str:
    return w.lower()


@dataclass(frozen=True)
class Names:
    given: frozenset[str]
    family: frozenset[str]
    common: frozenset[str]  #: given names mostly used as other words
    streets: frozenset[str]
    near: frozenset[str] = frozenset()  #: words that are given names directly before a known family name


def _street_ok(m: re.Match, streets: frozenset[str]) -> bool:
    name = next(x for x in m.groups() if x)
    return name[0].isupper() or _key(name) in streets or m["de"] is not None


def count_evidence(texts: Iterator[str | None]) -> Counter:
    """Counts keyed by (role, word, partner, next, caps).

    Roles: t a word; p a pair, m a pair around an initial; c a pair ``word, partner``; s a street name. next is the word after ``word partner,``.
    """
    c: Counter = Counter()
    for text in texts:
        if not text:
            continue
        s, _ = plain(text)
        low = s.lower()
        for w in WORD.findall(low):
            c["t", w, "", "", False] += 1
        for m in _LOCAL.finditer(low):
            c["p", m[1], m[2], "", False] += 1
        for m in _PAIR.finditer(low):
            if m[2] == ", ":
                c["c", m[1], m[4], "", False] += 1
            else:
                n = _GIVEN_NEXT.match(low, m.end(4))
                caps = s[m.start(1)].isupper() and s[m.start(4)].isupper() and not s[m.start(1) : m.end(4)].isupper()
                c["m" if m[3] else "p", m[1], m[4], n[1] if n else "", caps] += 1
        for m in STREET.finditer(s):
            if name := m["en"]:
                c["s", _key(name), "", "", False] += 1
    return c


_FLAGS = ("given", "family", "base", "common", "near", "street")


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(role, word, partner, next, caps, n) over all documents, written once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["role", "word", "partner", "next", "caps"]
        total: Counter = Counter()
        for b in batches:
            total.update(count_evidence(iter(b["t"])))
            if len(total) > 300_000:
                yield pd.DataFrame([(*x, n) for x, n in total.items()], columns=[*cols, "n"])
                total = Counter()
        yield pd.DataFrame([(*x, n) for x, n in total.items()], columns=[*cols, "n"])

    e = docs.select(F.col(text).alias("t")).mapInPandas(count, "role string, word string, partner string, next string, caps boolean, n long")
    return cut(e.groupBy("role", "word", "partner", "next", "caps").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, names: DataFrame, text: str = "text", rounds: int = 2, share: float = 0.5, weak: float = 0.04, partners: int = 2) -> DataFrame:
    """The name list extended from all documents: word, given, family, base (given in ``names``), common, near, street.

    A word becomes a family (given) name if at least ``share`` of its occurrences stand beside
    a known given (family) name, with ``partners`` different ones; or all occurrences do and any is capitalised. Initials alone
    are no evidence. A word with a share of ``weak`` or more counts as a given name directly before
    a known family name only (near).
    """
    e = evidence(docs, text)
    start = names.filter("name is not null").groupBy(F.lower("name").alias("word")).agg(F.bool_or(F.col("kind") == "given").alias("given"), F.bool_or(F.col("kind") == "family").alias("family"))
    no = F.lit(False)
    known = cut(start.select("word", F.coalesce("given", no).alias("given"), F.coalesce("family", no).alias("family"), F.coalesce("given", no).alias("base"), no.alias("common"), no.alias("near"), no.alias("street")))
    for _ in range(rounds + 1):
        few = known.count() <= BROADCAST_ROWS
        side = lambda c: (lambda k: F.broadcast(k) if few else k)(known.select(F.col("word").alias(c), F.struct("given", "family", "common").alias(f"_{c}")))  # noqa: B023, E731
        j = e.join(side("word"), "word", "left").join(side("partner"), "partner", "left").join(side("next"), "next", "left")
        is_ = lambda c, f: F.coalesce(F.col(f"_{c}.{f}"), F.lit(False))
        role, initial = F.col("role"), F.col("word").endswith(".")
        sure = lambda c: is_(c, "given") & ~is_(c, "common")
        pair = role.isin("p", "m") & ~(is_("next", "given") & is_("partner", "family"))
        about = lambda cond, w, r, p: F.when(cond, F.struct(F.col(w).alias("word"), F.lit(r).alias("role"), F.col(p).alias("partner")))
        got = F.array(
            about(role == "t", "word", "t", "partner"), about(role == "s", "word", "s", "partner"),
            about(pair & (initial | sure("word")), "partner", "f", "word"), about(pair & ~initial & sure("word") & F.col("caps"), "partner", "F", "word"),
            about(pair & ~initial & (role == "p") & is_("partner", "family"), "word", "g", "partner"), about(pair & ~initial & (role == "p") & is_("partner", "family") & F.col("caps"), "word", "G", "partner"),
            about((role == "c") & sure("partner"), "word", "c", "partner"), about((role == "c") & is_("word", "family"), "partner", "g", "word"),
        )
        c = j.select("n", F.explode(F.filter(got, lambda x: x.isNotNull())).alias("x")).groupBy("x.word", "x.role", "x.partner").agg(F.sum("n").alias("n"))
        num = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n"))), F.lit(0))
        w = c.groupBy("word").agg(
            num("t").alias("total"), num("f").alias("f"), num("F").alias("f_caps"), num("g").alias("g"), num("G").alias("g_caps"), num("c").alias("comma"), num("s").alias("s"),
            *[F.count_if((F.col("role") == r) & ~F.col("partner").endswith(".")).alias(f"p{r}") for r in "fg"],
        ).filter((F.length("word") > 1) & (F.col("total") > 0))
        all_f, all_g = F.col("f") + F.col("comma"), F.col("g")
        is_f = ((F.col("pf") >= partners) & (all_f >= share * F.col("total"))) | ((F.col("f_caps") > 0) & (F.col("pf") > 0) & (all_f >= F.col("total")) & (F.col("total") <= 3 * F.col("pf")))
        is_g = ((F.col("pg") >= partners) & (all_g >= share * F.col("total"))) | ((F.col("g_caps") > 0) & (all_g >= F.col("total")) & (F.col("total") <= 3 * F.col("pg")))
        is_weak = (F.col("pg") >= partners) & (all_g >= weak * F.col("total"))
        is_s = (F.col("s") >= 2) & (F.col("s") >= share * F.col("total"))
        w = w.select("word", F.col("total").alias("_n"), F.col("g").alias("_ng"), is_f.alias("_f"), is_g.alias("_g"), is_weak.alias("_w"), is_s.alias("_s"))
        k = known.join(w, "word", "full").select("word", *[F.coalesce(x, no).alias(x) for x in (*_FLAGS, "_f", "_g", "_w", "_s")], "_n", "_ng")
        k = k.withColumn("family", F.col("family") | (F.col("_f") & ~F.col("base")))
        k = k.withColumn("given", F.col("given") | (F.col("_g") & ~F.col("family")))
        k = k.withColumn("common", F.coalesce(F.col("base") & (F.col("_n") >= 5) & (F.col("_ng") < 0.15 * F.col("_n")), no)).withColumn("near", F.col("_w") & ~F.col("given") & ~F.col("family")).withColumn("street", F.col("_s"))
        known = cut(k.filter("given or family or near or street").select("word", *_FLAGS))
    return known


def _as_names(rows: list) -> Names:
    pick = lambda f: frozenset(r["word"] for r in rows if r[f])
    return Names(pick("given"), pick("family"), pick("common"), pick("street"), pick("near"))


def learn_names(docs: DataFrame, names: DataFrame, text: str = "text", **kw: float) -> Names | DataFrame:
    """The extended name list on the driver if it has at most MAX_WORDS words, else as a table, which ``protect`` joins."""
    known = learn(docs, names, text, **kw)  # type: ignore[arg-type]
    return _as_names(known.collect()) if known.count() <= MAX_WORDS else known


def find(text: str | None, names: Names, field: str = "text") -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pieces in a text, in text order, without overlaps."""
    if not text:
        return []
    s, idx = plain(text)
    out: list[tuple[str, int, int]] = []
    if field == "screen_name":
        return [(k, 0, len(text))] if (k := _handle_kind(s.strip(), names)) else []
    taken = bytearray(len(s))

    def add(kind: str, a: int, b: int) -> None:
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\1" * (b - a)
            out.append((kind, a, b))

    low = s.lower()
    digits = any(c.isdigit() for c in s)
    if "@" in s or "at" in low:
        for m in EMAIL.finditer(s):
            add("email", *m.span())
    if digits:
        for m in ID.finditer(s):
            if sum(c.isdigit() for c in m[0]) >= 6:
                add("id_number", *m.span())
    if digits or " oh " in low or "zero" in low or "five" in low or "seven" in low:
        for m in PHONE.finditer(s):
            n = sum(c.isdigit() for c in m[0])
            if n == 0 or 9 <= n <= 15:
                add("phone", *m.span())
    if digits:
        for m in STREET.finditer(s):
            if _street_ok(m, names.streets):
                add("street", *m.span())
    for m in _PAIR.finditer(low):
        a, sep, mid, b = m[1], m[2], m[3], m[4]
        end = m.end(4)
        if sep == ", ":
            if a in names.family and b in names.given and b not in names.common and not mid:
                if t := re.match(r" [^\W\d_]\.(?= )", low[end:]):
                    end += t.end()
                add("name", m.start(1), end)
        elif b in names.family and (a in names.given or (a in names.near and not mid) or (a.endswith(".") and not mid)):
            if (n := _GIVEN_NEXT.match(low, end)) and n[1] in names.given and a not in names.given:
                continue
            add("name", m.start(1), end)
    out.sort(key=lambda x: x[1])
    if idx is not None:
        out = [(k, idx[a], idx[b - 1] + 1) for k, a, b in out]
    return out


def _handle_kind(s: str, names: Names) -> str | None:
    if EMAIL.fullmatch(s):
        return "email"
    if ID.fullmatch(s) and sum(c.isdigit() for c in s) >= 6:
        return "id_number"
    if PHONE.fullmatch(s):
        return "phone"
    if re.search(r"\d", s):
        return None
    parts = [p.lower() for x in re.split(r"[._ -]+", s) for p in _PART.findall(x)]
    if len(parts) in (2, 3):
        a, b = parts[0], parts[-1]
        if (a in names.given and b in names.family) or (b in names.given and a in names.family):
            return "name"
    whole = re.sub(r"[^a-z']", "", s.lower())
    if parts and len(parts) == 1:
        for k in range(3, len(whole) - 2):
            if (whole[:k] in names.given and whole[k:] in names.family) or (whole[:k] in names.family and whole[k:] in names.given):
                return "name"
    return None


def replacement(kind: str, piece: str, secret: bytes) -> str:
    """A typed placeholder. Numbers are permuted within their format; other kinds carry a keyed tag, so equal values stay linked."""
    if kind == "date":
        return f"[DATE {permute_date(date.fromisoformat(piece), secret).isoformat()}]"
    p, _ = plain(piece)
    if kind in ("phone", "id_number") and (new := formats.pseudonym(kind, p, secret)):
        return f"[{kind.upper()} {new}]"
    tag = hashlib.blake2b(" ".join(re.findall(r"\w+", p.lower())).encode(), key=secret, digest_size=12).hexdigest()
    return f"[{kind.upper()} {tag}]"


def _is_date(s: str) -> bool:
    try:
        date.fromisoformat(s)
    except ValueError:
        return False
    return True


def protect_text(text: str | None, names: Names, secret: bytes, field: str = "text", dates: bool = False) -> tuple[str | None, list[dict]]:
    """The text with placeholders, and what they stand for: field_name, kind, piece, placeholder and whether a number is valid in its format."""
    if not text:
        return text, []
    spans = find(text, names, field)
    if dates:
        used = [(a, b) for _, a, b in spans]
        spans = sorted(spans + [("date", *m.span()) for m in _DATE.finditer(text) if _is_date(m[0]) and not any(a < m.end() and m.start() < b for a, b in used)], key=lambda x: x[1])
    out, got, at = [], [], 0
    for k, a, b in spans:
        new = replacement(k, text[a:b], secret)
        got.append({"field_name": field, "kind": k, "piece": text[a:b], "placeholder": new, "valid": formats.is_valid(k, plain(text[a:b])[0]) if k in ("phone", "id_number") else None})
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:], got


def redact_text(text: str | None, names: Names, secret: bytes, field: str = "text", dates: bool = False) -> str | None:
    return protect_text(text, names, secret, field, dates)[0]


def _words_of(text: str | None, field: str) -> set[str]:
    """The words of a text that ``find`` may look up."""
    if not text:
        return set()
    low = plain(text)[0].lower()
    out = {w for m in _PAIR.finditer(low) for w in (m[1], m[4])} | {w for w in WORD.findall(low)} | set(re.findall(r"[^\W\d_][\w'-]*", low))
    if field == "screen_name":
        whole = re.sub(r"[^a-z']", "", low)
        out |= {p.lower() for x in re.split(r"[._ -]+", text) for p in _PART.findall(x)} | {x for k in range(1, len(whole)) for x in (whole[:k], whole[k:])}
    return out


def _with_own_names(docs: DataFrame, names: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Adds ``__names``: of the name table the words that the row holds. Rows are joined by word, so no list of names travels."""

    @F.pandas_udf("array<string>")
    def udf(*cols: pd.Series) -> pd.Series:
        return pd.Series([sorted(set().union(*[_words_of(v, f) for f, v in zip(fields, vals)])) for vals in zip(*cols)])

    w = docs.select(key, F.explode(udf(*fields)).alias("word")).join(names, "word")
    own = w.groupBy(key).agg(F.collect_list(F.struct("word", *_FLAGS)).alias("__names"))  # at most the words of one row
    return docs.join(own, key, "left")


def protect(docs: DataFrame, names: Names | DataFrame, secret: bytes, key: str = "doc_id", fields: tuple[str, ...] = ("text", "screen_name"), dates: bool = False) -> DataFrame:
    """The documents with every piece replaced in ``fields``, and ``pieces``: what was replaced (instead of a column of that name). Other columns are unchanged.

    One pass; with a list of names nothing is shuffled, with a table of names (a longer list) its words are joined, by a unique ``key``.
    """
    cols = list(fields)
    if isinstance(names, DataFrame):
        docs, given = _with_own_names(docs, names, key, fields), None
        cols.append("__names")
    else:
        given = names
    one = "struct<field_name:string,kind:string,piece:string,placeholder:string,valid:boolean>"

    @F.pandas_udf(f"struct<{','.join(f'f{i}:string' for i in range(len(fields)))},pieces:array<{one}>>")
    def udf(*cols: pd.Series) -> pd.DataFrame:
        rows = []
        for vals in zip(*cols):
            n = given if given is not None else _as_names(list(vals[-1]) if vals[-1] is not None else [])
            got = [protect_text(v, n, secret, f, dates) for f, v in zip(fields, vals)]
            rows.append((*[g[0] for g in got], [x for g in got for x in g[1]]))
        return pd.DataFrame(rows, columns=[*[f"f{i}" for i in range(len(fields))], "pieces"])

    done = docs.select("*", F.explode(F.array(udf(*cols))).alias("__r"))  # the generator keeps the pass from being run once per field
    return done.select(*[F.col(f"__r.f{fields.index(c)}").alias(c) if c in fields else F.col(c) for c in docs.columns if c not in ("__names", "pieces")], F.col("__r.pieces").alias("pieces"))


def pieces(protected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field_name, kind, piece) of protected documents, distinct."""
    p = F.transform("pieces", lambda x: F.struct(x["field_name"].alias("field_name"), x["kind"].alias("kind"), x["piece"].alias("piece")))
    return protected.select(key, F.inline(F.array_distinct(p))).distinct()
