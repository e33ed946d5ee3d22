"""Format-preserving keyed permutations (Feistel networks) for numbers and dates.

A value's digits and letters are permuted within their own format: digits stay
digits, letters keep their case, everything else keeps its place. Equal values
give equal pseudonyms under one key, and the key reverses them.
"""

from __future__ import annotations

import hashlib
from datetime import date, timedelta

ROUNDS = 10
_EPOCH, _DAYS = date(1900, 1, 1), 73_049  # 1900-01-01 to 2099-12-31


def _f(key: bytes, rnd: int, domain: str, value: int, mod: int) -> int:
    h = hashlib.blake2b(f"{domain}|{rnd}|{value}".encode(), key=key, digest_size=16).digest()
    return int.from_bytes(h, "big") % mod


def permute_int(value: int, a: int, b: int, key: bytes, domain: str, back: bool = False) -> int:
    """A permutation of range(a * b), by alternating modular Feistel rounds over value = left * b + right."""
    left, right = divmod(value, b)
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if r % 2 == 0:
            left = (left + sign * _f(key, r, domain, right, a)) % a
        else:
            right = (right + sign * _f(key, r, domain, left, b)) % b
    return left * b + right


def _radix(c: str) -> tuple[int, int] | None:
    """(radix, base code point) of a character that is permuted."""
    for lo, hi in (("0", "9"), ("A", "Z"), ("a", "z")):
        if lo <= c <= hi:
            return ord(hi) - ord(lo) + 1, ord(lo)
    return None


def permute_text(text: str, key: bytes, back: bool = False, fixed: int = 0) -> str:
    """Permutes the ASCII digits and letters after the first ``fixed`` of them; under two such characters nothing changes.

    The domain is the format of the permuted characters alone, so one number written with
    other separators gets the same digits.
    """
    spots = [(i, *r) for i, c in enumerate(text) if (r := _radix(c))][fixed:]
    if len(spots) < 2:
        return text
    cutoff = len(spots) // 2
    values, mods = [], []
    for part in (spots[:cutoff], spots[cutoff:]):
        v, m = 0, 1
        for i, radix, base in part:
            v, m = v * radix + ord(text[i]) - base, m * radix
        values.append(v)
        mods.append(m)
    domain = "".join("9" if r == 10 else "A" for _, r, _ in spots)
    x = permute_int(values[0] * mods[1] + values[1], mods[0], mods[1], key, domain, back)
    out = list(text)
    for i, radix, base in reversed(spots):
        x, d = divmod(x, radix)
        out[i] = chr(base + d)
    return "".join(out)


def permute_date(d: date, key: bytes, back: bool = False) -> date:
    """A permutation of the days 1900 to 2099, by cycle walking; other days are refused."""
    n = (d - _EPOCH).days
    if not 0 <= n < _DAYS:
        raise ValueError("dates from 1900 to 2099")
    while True:
        n = permute_int(n, 271, 270, key, "date", back)  # 73,170 >= _DAYS
        if n < _DAYS:
            return _EPOCH + timedelta(days=n)
