"""Format-preserving pseudonyms for personal data by a keyed Feistel permutation.

A value that passes its kind's validation (Luhn's check digit, octets of an address, a calendar date) is permuted within its
own format under a secret key: digits stay digits, letters letters, a card number keeps a valid check digit, a date stays
a date. Equal values get equal pseudonyms in every document, so links remain; with the key the permutation can be undone.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

ROUNDS = 10
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: A mailbox of fewer symbols is short. Dates are permuted among the days from the first to the last of these.
SHORT_NAME = 4
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

# What each kind of personal data looks like.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "secret_upper": r"(?<![0-9A-Za-z])[0-9A-F]{32,64}(?![0-9A-Za-z])",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+?\d{0,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])(?:\+\d{1,3}[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d+])\+\d{8,15}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # its last number isn't where an address or a decimal begins
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])(?!(?:(?<=[ -]\d)|(?<=[ -]\d\d)|(?<=[ -]\d\d\d))\.\d)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)  # digits of other scripts are no alphabet here
_CAN_HOLD = re.compile(r"[0-9@]|[A-F]{32}|[a-f]{32}")


class Feistel:
    """A permutation of the numbers below a size, for each size and tweak another one."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, other: int, size: int) -> int:
        text = f"{tweak}|{i}|{other}|{size}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big") % size

    def permute(self, x: int, left: int, right: int, tweak: str, back: bool = False) -> int:
        """x below left * right, as two halves that are shifted in turn by a keyed function of the other."""
        a, b = divmod(x, right)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                b = (b + sign * self._round(tweak, i, a, right)) % right
            else:
                a = (a + sign * self._round(tweak, i, b, left)) % left
        return a * right + b

    def symbols(self, text: str, alphabets: list[str], tweak: str, back: bool = False) -> str:
        """Each character stays within its alphabet; the whole is permuted."""
        half, x, left, right = len(text) // 2, 0, 1, 1
        for i, (c, alphabet) in enumerate(zip(text, alphabets, strict=True)):
            x = x * len(alphabet) + alphabet.index(c)
            left, right = (left * len(alphabet), right) if i < half else (left, right * len(alphabet))
        y, out = self.permute(x, left, right, f"{tweak}{len(text)}", back), []
        for alphabet in reversed(alphabets):
            y, i = divmod(y, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out))

    def within(self, x: int, size: int, tweak: str, back: bool = False) -> int:
        """x below size: steps out of the range are walked on until they end within."""
        side = 1
        while side * side < size:
            side += 1
        while (x := self.permute(x, side, side, tweak, back)) >= size:
            pass
        return x


def luhn(digits: str) -> int:
    """What the check sum of a number lacks to a multiple of ten."""
    return -sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _classed(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c


def _email(v: str, f: Feistel, back: bool) -> str:
    """The mailbox is permuted; one of a few symbols together with the host's first name, for by itself it has few images."""
    name, host = v.split("@")
    label, dot, rest = host.partition(".") if len(name) < SHORT_NAME else ("", "", host)
    new = f.symbols(name + label, [_classed(c) for c in name + label], f"email{len(name)}", back)
    return f"{new[: len(name)]}@{new[len(name) :]}{dot}{rest}"


def _digits(v: str, f: Feistel, tweak: str, back: bool, fixed: int = 0) -> str:
    """Permute the digits of a value but the first few; what stands between them stays."""
    digits = [c for c in v if c.isdigit()]
    new = iter(digits[:fixed] + list(f.symbols("".join(digits[fixed:]), [DIGITS] * (len(digits) - fixed), tweak, back)))
    return "".join(next(new) if c.isdigit() else c for c in v)


def _phone(v: str, f: Feistel, back: bool) -> str:
    n = sum(c.isdigit() for c in v)
    return _digits(v, f, "phone", back, max(0, n - 10))  # the country's code stays


def _card_span(v: str) -> tuple[int, int] | None:
    """The first and end place of the card number among numbers with a space or hyphen between them; None if there is none.

    Of the valid runs of whole numbers one of equal groups goes first, then one of 4, 6 and 5 digits, then the longest.
    """
    groups, found = [m.span() for m in re.finditer("[0-9]+", v)], []
    for i, (begin, _) in enumerate(groups):
        for j in range(i + 1, len(groups) + 1):
            lengths = [e - b for b, e in groups[i:j]]
            digits = "".join(v[b:e] for b, e in groups[i:j])
            if 13 <= len(digits) <= 19 and not luhn(digits) and int(digits):
                found.append((len(set(lengths)) > 1, lengths != [4, 6, 5], -len(digits), begin, groups[j - 1][1]))
    return min(found)[3:] if found else None


def _card(v: str, f: Feistel, back: bool) -> str | None:
    if _card_span(v) != (0, len(v)):
        return None
    while True:
        digits = [c for c in v if c.isdigit()]
        body = f.symbols("".join(digits[:-1]), [DIGITS] * (len(digits) - 1), "card", back)
        new = iter(body + str(luhn(body + "0")))
        v = "".join(next(new) if c.isdigit() else c for c in v)
        if _card_span(v) == (0, len(v)):  # else a shorter one within it would be read on the way back
            return v


def _ip(v: str, f: Feistel, back: bool) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    y = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 16, 1 << 16, "ip", back)
    return ".".join(map(str, y.to_bytes(4, "big")))


@lru_cache
def _days(late: bool) -> tuple[list[datetime.date], dict[datetime.date, int]]:
    """The days that are permuted among themselves, those up to a month's 12th or those after it, and the place of each."""
    every = (FIRST_DAY + datetime.timedelta(i) for i in range((LAST_DAY - FIRST_DAY).days + 1))
    days = [d for d in every if (d.day > 12) == late]
    return days, {d: i for i, d in enumerate(days)}


def _date(v: str, f: Feistel, back: bool) -> str | None:
    """Equal days have equal pseudonyms in every notation; single digits come back as two.

    With slashes the month comes first where only that is a date. Days after the 12th stay so, and are read the same way again.
    """
    sign = next(c for c in v if not c.isdigit())
    x, y, z = map(int, v.split(sign))
    ways = {"{0:04d}-{1:02d}-{2:02d}": (x, y, z)} if sign == "-" else {"{2:02d}" + sign + "{1:02d}" + sign + "{0:04d}": (z, y, x)}
    if sign == "/":
        ways["{1:02d}/{2:02d}/{0:04d}"] = (z, x, y)
    for way, parts in ways.items():
        try:
            day = datetime.date(*parts)
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            days, place = _days(day.day > 12)
            new = days[f.within(place[day], len(days), f"date{day.day > 12}", back)]
            return way.format(new.year, new.month, new.day)
    return None


def _is_ssn(v: str) -> bool:
    return v[:3] not in ("000", "666") and v[4:6] != "00" and v[7:] != "0000"


def _ssn(v: str, f: Feistel, back: bool) -> str | None:
    if not _is_ssn(v):
        return None
    while not _is_ssn(v := _digits(v, f, "ssn", back)):
        pass
    return v


REPLACE: dict[str, Callable[[str, Feistel, bool], str | None]] = {
    "email": _email,
    "secret": lambda v, f, back: f.symbols(v, [HEX] * len(v), "secret", back),
    "secret_upper": lambda v, f, back: f.symbols(v, [HEX.upper()] * len(v), "secret", back),
    "date": _date,
    "ip": _ip,
    "phone": _phone,
    "ssn": _ssn,
    "card": _card,
}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with its personal data permuted, and how many values that were. A value that fails its validation stays."""
    if not _CAN_HOLD.search(text):
        return text, 0
    feistel, n = Feistel(key), 0

    out, done, at = [], 0, 0
    while m := _ANY.search(text, at):
        (begin, at), value = m.span(), m[0]
        if m.lastgroup == "card":  # other numbers can stand before and behind it
            first, end = _card_span(value) or (0, re.search("[0-9]+", value).end())
            begin, at, value = begin + first, begin + end, value[first:end]
        new = REPLACE[m.lastgroup](value, feistel, back)
        if new is not None:
            out += [text[done:begin], new]
            done, n = at, n + 1
    return "".join([*out, text[done:]]), n


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with pseudonyms in text_col, and with the number of replaced values in count_col if one is named.

    Nothing is shuffled and every row stays, with its other columns as they are; a null text stays null with a count of 0.
    A column that already has the name of count_col is replaced. An empty table gives an empty result.
    """
    docs = docs.drop(count_col) if count_col else docs
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *([StructField(count_col, LongType())] if count_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(None, 0) if t is None else pseudonymise(t, key) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([t for t, _ in done], b.column(at).type)
            if count_col:
                columns.append(pa.array([n for _, n in done], pa.int64()))
            yield pa.record_batch(columns, [*b.schema.names, *([count_col] if count_col else [])])

    return docs.mapInArrow(run, schema)
