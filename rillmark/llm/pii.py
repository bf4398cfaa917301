"""Format-preserving pseudonyms: validated numbers and dates are permuted, by a keyed Feistel network, within their format.

Found and validated: payment card numbers (13 to 19 digits, Luhn), IBANs (mod 97), telephone numbers (+ and 7 to 15 digits, of
which the country code stays, or (ddd) ddd-dddd, which is read as one of country code 1), US social security numbers, IPv4 addresses, calendar dates (ISO, or day and month with the year last) and
the local parts of e-mail addresses. With slashes the month is read
first where that gives a month. A value is read without its separators, permuted in the set of all valid values of its
kind and shape, and written back with its separators: equal values get equal pseudonyms in every document, different ones
different pseudonyms, and a pseudonym passes the validation again. Without the key it can't be undone; with it, it can.

The work is a map over rows; a task remembers the pseudonyms of frequent values.

Defined cases: an empty table gives an empty result; null texts stay null and empty ones empty; very long texts are read whole; digit strings that fail validation stay; a date between 1900 and
2099 stays between these, others stay as they are; repeated rows are each returned; other columns pass through, and columns
that are called n_replaced or replaced are replaced.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
KINDS = ("card", "iban", "phone", "ssn", "ipv4", "date", "email")

_FOUND = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?=[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<iso>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-]))"
    r"|(?P<dmy>(?<![\d./-])\d{1,2}(?P<sep>[./-])\d{1,2}(?P=sep)\d{4}(?![\d/-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){3,11}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d))"
)
_MAYBE = re.compile(r"\d\D{0,3}\d|@")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


# The country calling codes of two digits (ITU-T E.164). 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


class Permutation:
    """A keyed permutation of 0 .. n-1 for each tweak: a Feistel network over two equal halves that cover n, walked until the value is below n."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, k: int, value: int, half: int) -> int:
        size = (half + 7) // 8 + 8
        digest = blake2b(b"%d:%d:%d:" % (k, half, value) + tweak, key=self.key, digest_size=min(size, 64)).digest()
        return int.from_bytes(digest) & ((1 << half) - 1)

    def __call__(self, value: int, n: int, tweak: str, undo: bool = False) -> int:
        if n < 2:
            return value
        half = max((n - 1).bit_length() + 1, 2) // 2
        mask, mark = (1 << half) - 1, tweak.encode()
        while True:
            a, b = value >> half, value & mask
            if undo:
                for k in reversed(range(ROUNDS)):
                    a, b = b ^ self._round(mark, k, a, half), a
            else:
                for k in range(ROUNDS):
                    a, b = b, a ^ self._round(mark, k, b, half)
            value = (a << half) | b
            if value < n:
                return value


def country_code(digits: str) -> str:
    """The country calling code that an international number begins with."""
    return digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]


def luhn_digit(body: str) -> str:
    """The check digit that follows these digits."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _mixed_radix(text: str, permute, kind: str) -> str:
    """Digits become digits, letters letters of their case, all others stay; permuted as one number."""
    radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in text]
    zero = ["0" if c.isdigit() else "a" if c.islower() else "A" for c in text]
    value, n = 0, 1
    for c, r, z in zip(text, radix, zero, strict=True):
        if r > 1:
            value, n = value * r + ord(c) - ord(z), n * r
    value, out = permute(value, n, kind + ":" + "".join(z if r > 1 else c for c, r, z in zip(text, radix, zero, strict=True))), []
    for c, r, z in reversed(list(zip(text, radix, zero, strict=True))):
        value, digit = divmod(value, r) if r > 1 else (value, 0)
        out.append(chr(ord(z) + digit) if r > 1 else c)
    return "".join(reversed(out))


def _ssn(value: int) -> str:
    area, rest = divmod(value, 99 * 9999)
    area += 1 + (area >= 665)
    return f"{area:03}{1 + rest // 9999:02}{1 + rest % 9999:04}"


def pseudonym(kind: str, text: str, permute) -> str | None:
    """The pseudonym of a value without separators, or None if it isn't valid. permute is a Permutation or its inverse."""
    if kind == "card":
        if luhn_digit(text[:-1]) != text[-1]:
            return None
        body = f"{permute(int(text[:-1]), 10 ** (len(text) - 1), f'card{len(text)}'):0{len(text) - 1}}"
        return body + luhn_digit(body)
    if kind == "iban":
        if _iban_number(text[4:] + text[:4]) % 97 != 1:
            return None
        body = _mixed_radix(text[4:], permute, text[:2])
        return f"{text[:2]}{98 - _iban_number(body + text[:2] + '00') % 97:02}{body}"
    if kind == "ssn":
        area, group, serial = int(text[:3]), int(text[3:5]), int(text[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        return _ssn(permute(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn"))
    if kind == "phone":
        code, value = text.split(" ")
        return f"{permute(int(value), 10 ** len(value), f'phone{code}:{len(value)}'):0{len(value)}}"
    if kind == "ipv4":
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        value = permute(int.from_bytes(bytes(octets)), 1 << 32, "ipv4")
        return ".".join(map(str, value.to_bytes(4)))
    if kind == "date":
        year, month, day = map(int, text.split("-"))
        try:
            ordinal = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= ordinal <= LAST_DAY:
            return None
        return datetime.date.fromordinal(FIRST_DAY + permute(ordinal - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date")).isoformat()
    return _mixed_radix(text, permute, "email")


def _refilled(shape: str, digits: str) -> str:
    """The shape with its letters and digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def replace_values(text: str, one) -> tuple[str, list[str]]:
    """The text with all validated values replaced by one(kind, value), and the kinds of what was replaced."""
    kinds: list[str] = []

    def swap(m: re.Match) -> str:
        group, found = m.lastgroup, m[0]
        if group == "sep":
            group = "dmy"
        kind = "date" if group in ("iso", "dmy") else group
        bare = re.sub(r"[^A-Za-z0-9]", "", found)
        if kind == "email":
            new = one(kind, found[:-1])
        elif kind == "ipv4":
            new = one(kind, found)
        elif group == "iso":
            new = one(kind, found)
        elif group == "dmy":
            sep = m["sep"]
            first, second, year = found.split(sep)
            month_first = sep == "/" and int(first) <= 12 or int(second) > 12
            day, month = (second, first) if month_first else (first, second)
            new = one(kind, f"{year}-{int(month):02}-{int(day):02}")
            if new:
                y, mth, d = new.split("-")
                a, b = (mth, d) if month_first else (d, mth)
                new = sep.join((a, b, y) if len(first) == len(second) == 2 else (str(int(a)), str(int(b)), y))
        elif kind == "phone":
            # The country code stays, so that the value stays a number of its country, however it is written; (ddd) ddd-dddd is one of code 1.
            digits = re.sub(r"\D", "", found)
            code = country_code(digits) if found[0] == "+" else ""
            value = digits[len(code) :]
            new = one(kind, f"{code or '1'} {value}") if 7 <= len(digits) <= 15 and len(value) >= 4 else None
            if new:
                it = iter(code + new)
                kinds.append(kind)
                return "".join(next(it) if c.isdigit() else c for c in found)
        else:
            new = one(kind, bare)
        if not new:
            return found
        kinds.append(kind)
        if kind == "email":
            return new + "@"
        return new if kind in ("ipv4", "date") else _refilled(found, new)

    return _FOUND.sub(swap, text), kinds


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with text replaced, n_replaced (long) and replaced (array of kinds with their counts, as kind:count, in order of KINDS)."""
    names = [*[c for c in docs.columns if c not in ("n_replaced", "replaced")], "n_replaced", "replaced"]
    base = docs.select(*names[:-2])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", n_replaced long, replaced array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permute = Permutation(key)
        one = lru_cache(1 << 16)(lambda kind, value: pseudonym(kind, value, permute))
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                new, found = replace_values(text, one) if text and _MAYBE.search(text) else (text, [])
                texts.append(new)
                counts.append(len(found))
                kinds.append([f"{k}:{found.count(k)}" for k in KINDS if k in found])
            made = {"text": pa.array(texts, pa.string()), "n_replaced": pa.array(counts, pa.int64()), "replaced": pa.array(kinds, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return base.mapInArrow(work, schema)
