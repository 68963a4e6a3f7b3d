"""Format-preserving pseudonyms for personal data.

Values are found by pattern, validated (Luhn, mod 97, octets, calendar, numbering rules) and replaced by
a keyed permutation of their own format: a Feistel network over the numbers that the format can write,
walked until the result is valid again.  The permutation depends on the key and the kind of value, not on
the document, so equal values stay equal everywhere, different ones stay different, and the key's owner
can undo it (``restore``).

| kind | stays | is permuted |
|---|---|---|
| card (13-19 digits, Luhn) | first digit, separators | other digits; the check digit is computed anew |
| iban (mod 97) | country, spacing | account part; check digits anew |
| ssn (3-2-4) | dashes | all digits, within the valid areas |
| phone (+ and 8-15 digits, (3) 3-4, or 0 and 8-9 digits in groups) | country code, leading 0, punctuation | all other digits |
| ip (four octets) | dots | the 32-bit number, first octet 1-223 |
| date (year-month-day, day.month.year, day/month/year; 1900-2099) | notation | the day |
| email | domain, punctuation | letters (Latin ones with accents too) and digits before the @ |
| key (AKIA and 16 signs), password (after ``password=`` and the like) | the lead | letters and digits |

Defined cases: a null text stays null, an empty one empty, both with no values; texts without values stay
byte for byte; repeated rows give equal results; an empty table stays empty; a column ``pseudonyms`` is
replaced by ``pseudonymise``, all others keep their values; ``replaced`` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import add_columns, aside, texts

ROUNDS = 8
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
# Latin letters with accents; the multiplication and division signs among them are no letters
_LOWER_MORE, _UPPER_MORE = ("".join(chr(c) for c in range(a, b) if chr(c).isalpha()) for a, b in ((0xDF, 0x100), (0xC0, 0xDF)))
# Calling codes of one digit and of two; all others have three.
_CODES_OF_ONE = ("1", "7")
_CODES_OF_TWO = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
    "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)


class Permutation:
    """A keyed permutation of ``range(size)`` for every size."""

    def __init__(self, key: bytes, kind: str, back: bool = False):
        self.key, self.kind, self.back = key[:64], kind.encode()[:16], back

    def _step(self, r: int, value: int, size: int, modulus: int) -> int:
        data = b"%d|%d|%d" % (r, size, value)
        wide = (modulus.bit_length() + 7) // 8 + 8
        out = b"".join(hashlib.blake2b(data + b"|%d" % k, key=self.key, person=self.kind).digest() for k in range((wide + 63) // 64))
        return int.from_bytes(out[:wide], "big") % modulus

    def _network(self, x: int, size: int) -> int:
        a = isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        left, right = divmod(x, b)  # left < a, right < b
        for r in range(ROUNDS - 1, -1, -1) if self.back else range(ROUNDS):
            sign = -1 if self.back else 1
            if r % 2 == 0:
                left = (left + sign * self._step(r, right, size, a)) % a
            else:
                right = (right + sign * self._step(r, left, size, b)) % b
        return left * b + right

    def __call__(self, x: int, size: int, valid: Callable[[int], bool] = lambda x: True) -> int:
        """Walks on until the number is in range and valid; ``x`` itself must be."""
        while True:
            x = self._network(x, size)
            if x < size and valid(x):
                return x


def _alphabets(signs: str, hexadecimal: bool = False) -> list[str]:
    return [_HEX] * len(signs) if hexadecimal else [next(s for s in (_DIGITS, _LOWER, _UPPER, _LOWER_MORE, _UPPER_MORE) if c in s) for c in signs]


def _rank(signs: str, sets: list[str]) -> int:
    n = 0
    for c, s in zip(signs, sets, strict=True):
        n = n * len(s) + s.index(c)
    return n


def _signs(n: int, sets: list[str]) -> str:
    out = []
    for s in reversed(sets):
        n, k = divmod(n, len(s))
        out.append(s[k])
    return "".join(reversed(out))


def _permuted(perm: Permutation, signs: str, valid: Callable[[str], bool] = lambda s: True, hexadecimal: bool = False) -> str:
    sets = _alphabets(signs, hexadecimal)
    return _signs(perm(_rank(signs, sets), prod(map(len, sets)), lambda n: valid(_signs(n, sets))), sets) if signs else signs


def _refill(shape: str, signs: str, keep: Callable[[str], bool]) -> str:
    """``shape`` with its signs (those ``keep`` holds for) replaced in order."""
    new = iter(signs)
    return "".join(next(new) if keep(c) else c for c in shape)


def _is_digit(c: str) -> bool:
    return c in _DIGITS


def _is_sign(c: str) -> bool:
    return c in _DIGITS or c in _LOWER or c in _UPPER


def _is_letter_or_digit(c: str) -> bool:
    return _is_sign(c) or c in _LOWER_MORE or c in _UPPER_MORE


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(payload)))
    return str(-total % 10)


def _card(value: str, perm: Permutation) -> str | None:
    digits = "".join(filter(_is_digit, value))
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + _permuted(perm, digits[1:-1])
    return _refill(value, body + luhn_digit(body), _is_digit)


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(value: str, perm: Permutation) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _permuted(perm, plain[4:])
    check = 98 - _iban_rest(plain[:2] + "00" + body)
    return _refill(value, f"{plain[:2]}{check:02d}{body}", lambda c: c != " ")


def _ssn(value: str, perm: Permutation) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = value.replace("-", "")
    return _refill(value, _permuted(perm, digits, valid), _is_digit) if valid(digits) else None


def _phone(value: str, perm: Permutation) -> str | None:
    digits = "".join(filter(_is_digit, value))
    lead = 0
    if value.startswith("+"):
        lead = 1 if digits[0] in _CODES_OF_ONE else 2 if digits[:2] in _CODES_OF_TWO else 3
        if not 8 <= len(digits) <= 15:
            return None
    elif value[0] == "0":
        lead = 1
    first = digits[lead]
    # a number that may not start with 0 or 1 still doesn't
    valid = (lambda d: d[0] not in "01") if first not in "01" else (lambda d: d[0] in "01")
    return _refill(value, digits[:lead] + _permuted(perm, digits[lead:], valid), _is_digit)


def _ip(value: str, perm: Permutation) -> str | None:
    octets = [int(o) for o in value.split(".")]
    if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in value.split(".")) or not 1 <= octets[0] <= 223:
        return None
    n = perm(int.from_bytes(bytes(octets), "big"), 1 << 32, lambda x: 1 <= x >> 24 <= 223)
    return ".".join(map(str, n.to_bytes(4, "big")))


_FIRST_DAY, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _date(value: str, perm: Permutation) -> str | None:
    sign = next(c for c in value if not c.isdigit())
    parts = value.split(sign)
    y, m, d = parts if sign == "-" else parts[::-1]
    try:
        day = (date(int(y), int(m), int(d)) - _FIRST_DAY).days
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = _FIRST_DAY + timedelta(days=perm(day, _DAYS))
    wide = 2 if len(m) == 2 and len(d) == 2 else 1
    out = [f"{new.year:04d}", f"{new.month:0{wide}d}", f"{new.day:0{wide}d}"]
    return sign.join(out if sign == "-" else out[::-1])


def _email(value: str, perm: Permutation) -> str | None:
    local, _, domain = value.rpartition("@")
    return f"{_refill(local, _permuted(perm, ''.join(filter(_is_letter_or_digit, local))), _is_letter_or_digit)}@{domain}"


def _key(value: str, perm: Permutation) -> str | None:
    return value[:4] + _permuted(perm, value[4:])


def _password(value: str, perm: Permutation) -> str | None:
    lead, sign, secret = re.split(r"([=:]\s?)", value, maxsplit=1)
    signs = "".join(filter(_is_sign, secret))
    return lead + sign + _refill(secret, _permuted(perm, signs, hexadecimal=bool(signs) and set(signs) <= set(_HEX)), _is_sign)


#: Kind, pattern, replacement; of patterns that start at one place the first wins.
KINDS: tuple[tuple[str, str, Callable[[str, Permutation], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9À-ÖØ-öø-ÿ._%+-])[A-Za-z0-9À-ÖØ-öø-ÿ][A-Za-z0-9À-ÖØ-öø-ÿ._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),
    ("key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", _key),
    ("password", r"(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi_?[Kk]ey)[=:]\s?[A-Za-z0-9_+/.-]*[0-9][A-Za-z0-9_+/-]*", _password),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("date", r"(?<![\d.-])(?:(?:19|20)\d\d-\d\d?-\d\d?|\d\d?\.\d\d?\.(?:19|20)\d\d|\d\d?/\d\d?/(?:19|20)\d\d)(?![\d-])", _date),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _ip),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", r"(?<![\dA-Za-z])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])", _card),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,5}){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,2}[ -]\d{3,4}[ -]\d{3,4})(?!\d)", _phone),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS), re.ASCII)
_REPLACE = {k: f for k, _, f in KINDS}
#: No value is without one of these signs; it lies in the value's first run without spaces, or one space before it.
_HINT, _HINT_OR_KEY = re.compile(r"[0-9@=:]"), re.compile(r"[0-9@=:]|AKIA")
#: Characters that can stand in a value before such a sign.
_REACH = 80


class Pseudonyms:
    """Replaces values in texts; ``back`` undoes it."""

    def __init__(self, key: bytes, back: bool = False):
        if not key:
            raise ValueError("an empty key hides nothing")
        self.perms = {k: Permutation(key, k, back) for k in _REPLACE}
        self.value = lru_cache(50_000)(self._value)

    def _value(self, kind: str, value: str) -> str | None:
        return _REPLACE[kind](value, self.perms[kind])

    def _at(self, text: str, place: int) -> tuple[tuple[str, str] | None, int]:
        """The first kind that holds at this place, with its pseudonym, and the value's end."""
        if m := _FIND.match(text, place):
            for kind in [m.lastgroup, *(k for k in _ALONE if k != m.lastgroup)]:
                if (o := _ALONE[kind].match(text, place)) and (new := self.value(kind, o[0])) is not None:
                    return (kind, new), o.end()
        return None, place

    def __call__(self, text: str | None) -> tuple[str | None, list[dict]]:
        """The text with pseudonyms, and these as (kind, value) in order."""
        parts, found, last, at = [], [], 0, 0
        hints = _HINT_OR_KEY if text and "AKIA" in text else _HINT
        while text and (hint := hints.search(text, at)):
            start = hint.start()
            while start > at and start > hint.start() - _REACH and not text[start - 1].isspace():
                start -= 1
            for place in range(start, hint.end()):
                new, end = self._at(text, place)
                if new is not None:
                    parts += [text[last:place], new[1]]
                    found.append({"kind": new[0], "value": new[1]})
                    last = at = end
                    break
            else:
                at = hint.end()
        return ("".join([*parts, text[last:]]) if found else text), found


_ALONE = {k: re.compile(p, re.ASCII) for k, p, _ in KINDS}


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pseudonyms``: the new values in order, with their kinds."""

    def rows(batch: pa.RecordBatch) -> list[pa.Array]:
        nonlocal worker
        worker = worker or Pseudonyms(key)
        new = [worker(t) for t in texts(batch)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        return [pa.array([t for t, _ in new], pa.string()), pa.array([f for _, f in new], kind)]

    worker: Pseudonyms | None = None
    docs, back = aside(docs, "_text")
    out = add_columns(docs, "_text string, pseudonyms array<struct<kind:string,value:string>>", rows)
    return out.withColumn("text", F.col("_text")).drop("_text").withColumnsRenamed(back)


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and all its own columns."""
    docs, back = aside(docs, "pseudonyms")
    return pseudonymise(docs, key).select(*docs.columns).withColumnsRenamed(back)


def counts(pseudonymised: DataFrame) -> DataFrame:
    """Documents and occurrences for each kind and pseudonym: who is linked with whom, without names."""
    return (
        pseudonymised.select("doc_id", F.explode("pseudonyms").alias("p")).groupBy("doc_id", "p").agg(F.count("*").alias("n"))
        .groupBy("p.kind", "p.value").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_occurrences"))
    )


def restore(text: str | None, key: bytes) -> str | None:
    """The text before ``pseudonymise`` with this key."""
    return Pseudonyms(key, back=True)(text)[0]
