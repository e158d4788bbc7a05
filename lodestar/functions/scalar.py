"""Scalar functions and operators of the dialect as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidDatetime

# Texts that a cast to boolean takes, after trimming and in any case.
TRUE_TEXTS = ("t", "true", "y", "yes", "on", "1")
FALSE_TEXTS = ("f", "false", "n", "no", "off", "0")


def int_div(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Integer division that truncates towards zero and keeps an integer type; by zero it raises."""
    return F.call_function("div", a, b).cast(kind)


def like(text: Column, pattern: str, fold: bool = False) -> Column:
    """LIKE with % and _; a backslash makes the next character literal, and a pattern that ends in one matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return F.when(text.isNotNull(), F.lit(False))
            i += 1
            out.append("\\" + pattern[i] if pattern[i] in "%_\\" else pattern[i])
        else:
            out.append(c)
        i += 1
    return (F.lower(text) if fold else text).like("".join(out).lower() if fold else "".join(out))


def ilike(text: Column, pattern: str) -> Column:
    return like(text, pattern, fold=True)


def nocase(text: Column) -> Column:
    """What COLLATE NOCASE compares."""
    return F.lower(text)


def substr(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; 0 counts as 1; a negative start counts from the end but not past the first character."""
    start = F.lit(start) if isinstance(start, int) else start
    begin = F.when(start < 0, F.greatest(start, -F.length(text)) + F.length(text) + 1).otherwise(F.greatest(start, F.lit(1)))
    if length is None:
        return F.substring(text, begin, F.length(text))
    return F.substring(text, begin, F.greatest(F.lit(length) if isinstance(length, int) else length, F.lit(0)))


def concat(*parts: Column) -> Column:
    """|| of texts: null if any is."""
    return F.concat(*parts)


def hex_text(text: Column) -> Column:
    return F.hex(text.cast("binary"))


def float_text(x: Column) -> Column:
    """A double as text, without an exponent or a fraction of zero: its shortest digits with the point where it belongs."""
    text = x.cast("string")
    sign, e = F.when(text.startswith("-"), "-").otherwise(""), F.instr(text, "E")
    power = F.substring(text, e + 1, F.length(text)).try_cast("int")
    shown = F.replace(F.replace(F.substring(text, F.lit(1), e - 1), F.lit("-"), F.lit("")), F.lit("."), F.lit(""))  # one digit before the point
    digits = F.when(F.length(shown) == 2, F.rtrim(shown, F.lit("0"))).otherwise(shown)
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    spread = F.concat(sign, F.when(power >= 0, large).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)))
    short = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    inf = F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(inf, F.when(e > 0, spread).otherwise(short))


def timestamp_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def shifted(ts: Column, **amounts: int) -> Column:
    """A timestamp moved by years, months, days, hours, mins or secs; a month's end is kept within the month."""
    months = amounts.pop("years", 0) * 12 + amounts.pop("months", 0)
    return ts + F.make_ym_interval(F.lit(0), F.lit(months)) + F.make_dt_interval(*(F.lit(amounts.get(k, 0)) for k in ("days", "hours", "mins", "secs")))


def _now() -> Column:
    """The statement's time, the same in all its rows; the session's zone is UTC."""
    return F.current_timestamp().cast("timestamp_ntz")


# Dates and times as text, as far as they are read; what follows a plus sign is not.
DATE_TIME = r"^\s*(\d{1,6})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?Z*(?:\+.*)?)?\s*$"


def timestamp_of_text(text: Column) -> Column:
    """A timestamp from a date, with a time behind a space or a T or without; days beyond a month's end run on. Others raise."""
    part = lambda i: F.regexp_extract(text, DATE_TIME, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")), F.lit("0")).cast("int")
    y, m, d, h, mi, sec = (number(i) for i in range(1, 7))
    good = text.rlike(DATE_TIME) & m.between(1, 12) & d.between(1, 31) & (h <= 23) & (mi <= 59) & (sec <= 60)
    seconds = sec.cast("decimal(18,6)") + F.concat(F.lit("0."), F.rpad(F.substring(part(7), 1, 6), 6, "0")).cast("decimal(18,6)")
    begin = F.date_add(F.make_date(y, m, F.lit(1)), d - 1).cast("timestamp_ntz")
    return F.when(text.isNull(), None).when(good, begin + F.make_dt_interval(F.lit(0), h, mi, seconds)).otherwise(F.raise_error(F.concat(F.lit("invalid date/time: "), text)).cast("timestamp_ntz"))


def _moved(when: Column | str, modifiers: tuple[str | None, ...], is_text: bool) -> Column:
    if isinstance(when, str):
        when, is_text = F.lit(when), True
    if is_text:
        when = F.when(F.lower(when) == "now", _now()).otherwise(timestamp_of_text(F.when(F.lower(when) != "now", when)))
    for modifier in modifiers:
        if modifier is None:
            return F.lit(None).cast("timestamp_ntz")
        amount, _, unit = modifier.strip().partition(" ")
        unit = unit.strip().rstrip("s")
        if unit not in UNITS or not amount.lstrip("+-").isdigit():
            raise InvalidDatetime(f"unsupported date modifier {modifier!r}")
        when = shifted(when, **{UNITS[unit]: int(amount)})
    return when


#: Units of modifiers, and what shifted() calls them.
UNITS = {"second": "secs", "minute": "mins", "hour": "hours", "day": "days", "month": "months", "year": "years"}


def datetime(when: Column | str, *modifiers: str | None, is_text: bool = False) -> Column:
    """datetime(when, modifiers): when is a timestamp, a text (is_text), or 'now'; modifiers like "-30 days" apply in turn.

    Null if anything is; an unknown modifier raises while the plan is built, a text that is no date when it runs.
    """
    return timestamp_text(_moved(when, modifiers, is_text))


def date(when: Column | str, *modifiers: str | None, is_text: bool = False) -> Column:
    """As datetime, without the time."""
    return date_text(_moved(when, modifiers, is_text))


def _trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def bool_of_text(text: Column) -> Column:
    """A boolean from the texts above; any other raises."""
    t = F.lower(_trimmed(text))
    bad = F.raise_error(F.concat(F.lit("invalid boolean: "), text)).cast("boolean")
    return F.when(text.isNull(), F.lit(None)).when(t.isin(*TRUE_TEXTS), True).when(t.isin(*FALSE_TEXTS), False).otherwise(bad)


def bool_of_int(x: Column) -> Column:
    return x != 0


def int_of_float(x: Column) -> Column:
    """Truncates towards zero."""
    return x.cast("bigint")


def int_of_text(text: Column, kind: str = "bigint") -> Column:
    """A whole number with a sign or without; anything else, a fraction too, raises."""
    t = _trimmed(text)
    return F.when(text.isNull() | t.rlike(r"^[+-]?\d+$"), t.cast(kind)).otherwise(F.raise_error(F.concat(F.lit("invalid integer: "), text)).cast(kind))


def float_of_text(text: Column) -> Column:
    """A double from text; one that is no number raises."""
    t = _trimmed(text)
    return F.when(text.isNull() | t.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"), t.cast("double")).otherwise(F.raise_error(F.concat(F.lit("invalid number: "), text)).cast("double"))


def uuid_of_text(text: Column) -> Column:
    """The canonical form of up to 32 hex digits, with hyphens anywhere or none; anything else raises."""
    digits = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    canonical = F.regexp_replace(F.lpad(digits, 32, "0"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(text.isNull() | digits.rlike("^[0-9a-f]{1,32}$"), canonical).otherwise(F.raise_error(F.lit("invalid uuid")).cast("string"))


def uuid_text(uuid: Column) -> Column:
    """A UUID as text: its 32 hex digits."""
    return F.replace(uuid, F.lit("-"), F.lit(""))


def json_of_text(text: Column) -> Column:
    """JSON is kept as it was written."""
    return text


def random_blob(n: int) -> Column:
    """n random characters, at most 2**20; another value in each row and run."""
    return F.randstr(min(max(n, 0), 1 << 20))
