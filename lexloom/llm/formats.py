"""Number formats: what is valid in each, and pseudonyms that stay valid in it.

A piece is reduced to its letters and digits and matched with the formats in order. A format
keeps a prefix (country code, trunk zero, area of use), permutes the rest, and has rules for
which values are valid: ranges, and check characters. A valid value becomes another valid one,
with its check characters computed anew; a value of the format that is not valid becomes another
such one. Both are permutations, by cycle walking, so the key reverses them.

Whether a number is valid does not decide whether it is personal: people write wrong numbers, and
invented ones are wrong by design. It decides how it is permuted, and is reported.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from lexloom.llm.feistel import permute_text

# Country calling codes of one and of two digits; all others have three, in these ranges.
ONE_DIGIT = ("1", "7")
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
THREE_DIGITS = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
# Fixed value: check letters of Spanish identity numbers by remainder of 23.
LETTERS_23 = "TRWAGMYFPDXBNJZSQVHLCKE"
DIGIT_WORDS = ["oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]


def calling_code(digits: str) -> int:
    """Length of the country calling code at the start; 0 if there is none."""
    if digits[:1] in ONE_DIGIT:
        return 1
    if digits[:2] in TWO_DIGITS:
        return 2
    return 3 if digits[:2] in THREE_DIGITS else 0


def american(d: str) -> bool:
    """A ten-digit North American number: area and exchange from 200, neither a service code."""
    return d[0] in "23456789" and d[3] in "23456789" and d[1:3] != "11" and d[4:6] != "11"


def _international(prefix: int) -> Callable[[str], bool]:
    def ok(d: str) -> bool:
        n = calling_code(d[prefix:])
        rest = d[prefix + n :]
        return bool(n) and 6 <= len(rest) and len(d) - prefix <= 15 and (d[prefix] != "1" or (len(rest) == 10 and american(rest)))

    return ok


def _spanish(d: str) -> str:
    return LETTERS_23[int(d.replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23]


@dataclass(frozen=True)
class Format:
    kind: str
    name: str
    shape: re.Pattern  #: of the letters and digits
    keep: Callable[[str], int]  #: leading characters that stay
    ok: Callable[[str], bool] = lambda d: True
    check: Callable[[str], str] | None = None
    n_check: int = 0

    def valid(self, d: str) -> bool:
        return self.ok(d) and (self.check is None or self.check(d[: -self.n_check]) == d[-self.n_check :])


def _f(kind: str, name: str, shape: str, keep: int | Callable[[str], int] = 0, **kw: object) -> Format:
    return Format(kind, name, re.compile(shape), keep if callable(keep) else lambda d: keep, **kw)  # type: ignore[arg-type]


FORMATS = [
    _f("id_number", "social security", r"\d{9}", ok=lambda d: d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"),
    _f("id_number", "national insurance", r"[A-Z]{2}\d{6}[A-D]", 2, ok=lambda d: d[0] not in "DFIQUV" and d[1] not in "DFIOQUV" and d[-1] in "ABCD"),
    _f("id_number", "Spanish", r"\d{8}[A-Z]|[XYZ]\d{7}[A-Z]", lambda d: int(d[0] in "XYZ"), check=_spanish, n_check=1),
    _f("id_number", "French", r"[1-9]\d{14}", 1, ok=lambda d: d[0] in "12" and "01" <= d[3:5] <= "12", check=lambda d: f"{97 - int(d) % 97:02d}", n_check=2),
    _f("id_number", "document", r"[A-Z0-9]+", lambda d: len(re.match("[A-Z]*", d)[0])),  # type: ignore[index]
    _f("phone", "international", r"\+\d+", lambda d: 1 + calling_code(d[1:]), ok=_international(1)),
    _f("phone", "American with 001", r"001\d{10}", 3, ok=_international(2)),
    _f("phone", "with 00", r"00\d{7,13}", lambda d: 2 + calling_code(d[2:]), ok=_international(2)),
    _f("phone", "national with 0", r"0\d+", 1, ok=lambda d: 9 <= len(d) <= 12 and d[1] != "0"),
    _f("phone", "American", r"\d{10}", ok=american),
    _f("phone", "other", r"\d+", ok=lambda d: 6 <= len(d) <= 15),
]


def compact(piece: str) -> str:
    """The ASCII letters (as capitals) and digits, with a leading ``+``."""
    return "".join(c for i, c in enumerate(piece.upper()) if c.isascii() and (c.isalnum() or (c == "+" and not i)))


def format_of(kind: str, piece: str) -> Format | None:
    d = compact(piece)
    return next((f for f in FORMATS if f.kind == kind and f.shape.fullmatch(d)), None)


def is_valid(kind: str, piece: str) -> bool:
    f = format_of(kind, piece)
    return f is not None and f.valid(compact(piece))


def pseudonym(kind: str, piece: str, key: bytes, back: bool = False) -> str | None:
    """Another value of the piece's format, its separators and capitals kept; None if it has no format."""
    words = piece.lower().replace("-", " ").replace("zero", "oh").split()
    if kind == "phone" and words and all(w in DIGIT_WORDS for w in words):
        d = permute_text("".join(str(DIGIT_WORDS.index(w)) for w in words), key, back)
        new = iter(DIGIT_WORDS[int(c)] for c in d)
        return re.sub(r"[A-Za-z]+", lambda m: next(new), piece)
    f = format_of(kind, piece)
    if f is None:
        return None
    d = compact(piece)
    keep, good = f.keep(d), f.valid(d)
    body, tail = (d[keep : len(d) - f.n_check], f.n_check) if good and f.check else (d[keep:], 0)
    if len(body) < 2:
        return None
    x = body
    while True:
        x = permute_text(x, key, back)
        new = d[:keep] + x
        if tail:
            new += f.check(new)  # type: ignore[misc]
        if f.shape.fullmatch(new) and f.valid(new) == good:
            break
    it = iter(new)
    return "".join((n if c.isupper() or not c.isalpha() else n.lower()) if c.isascii() and (c.isalnum() or (c == "+" and not i)) and (n := next(it)) else c for i, c in enumerate(piece))
