"""String operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Superscript, subscript and circled digits that count as digits but not as decimals.
DIGITS = r"^[\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089]+$"


def isalnum(x): return x.rlike(r"^[\p{N}\p{L}]+$")  # noqa: E704
def isalpha(x): return x.rlike(r"^\p{L}+$")  # noqa: E704
def isdecimal(x): return x.rlike(r"^\p{Nd}+$")  # noqa: E704
def isdigit(x): return x.rlike(DIGITS)  # noqa: E704
def isnumeric(x): return x.rlike(r"^\p{N}+$")  # noqa: E704
def isspace(x): return x.rlike(r"^\s+$")  # noqa: E704
def islower(x): return (F.lower(x) == x) & (F.upper(x) != x)  # noqa: E704
def isupper(x): return (F.upper(x) == x) & (F.lower(x) != x)  # noqa: E704


def capitalize(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2**31 - 1)))


def flagged(pattern: str, case: bool = True, flags: int = 0) -> str:
    """Python flags as an inline group of a Java pattern."""
    on = ("" if case and not flags & re.IGNORECASE else "i") + ("m" if flags & re.MULTILINE else "") + ("s" if flags & re.DOTALL else "")
    return f"(?{on}){pattern}" if on else pattern


def contains(x, pat: str, case: bool = True, flags: int = 0, regex: bool = True) -> Column:
    if regex or not case:
        return x.rlike(flagged(pat if regex else re.escape(pat), case, flags))
    return x.contains(pat)


def match(x, pat: str, case: bool = True, flags: int = 0) -> Column:
    return x.rlike(flagged(rf"\A(?:{pat})", case, flags))


def fullmatch(x, pat: str, case: bool = True, flags: int = 0) -> Column:
    return x.rlike(flagged(rf"\A(?:{pat})\z", case, flags))


def get(x, i: int) -> Column:
    return F.nullif(F.substring(x, i + 1, 1), F.lit("")) if i >= 0 else F.when(F.length(x) >= -i, F.substring(x, i, 1))


def pad(x, width: int, side: str = "left", fill: str = " ") -> Column:
    n = F.greatest(F.length(x), F.lit(width))
    if side == "left":
        return F.lpad(x, n, F.lit(fill))
    if side == "right":
        return F.rpad(x, n, F.lit(fill))
    half = F.floor((n - F.length(x)) / 2) + F.length(x)
    return F.rpad(F.lpad(x, half.cast("int"), F.lit(fill)), n, F.lit(fill))


def strip(x, chars: str | None = None) -> Column:
    return F.btrim(x, F.lit(chars if chars is not None else " \t\n\r\f\v"))


def lstrip(x, chars: str | None = None) -> Column:
    return F.ltrim(x, F.lit(chars if chars is not None else " \t\n\r\f\v"))


def rstrip(x, chars: str | None = None) -> Column:
    return F.rtrim(x, F.lit(chars if chars is not None else " \t\n\r\f\v"))


def replace(x, pat: str, repl: str, case: bool = True, flags: int = 0, regex: bool = False) -> Column:
    if not regex and case:
        return F.replace(x, F.lit(pat), F.lit(repl))
    return F.regexp_replace(x, flagged(pat if regex else re.escape(pat), case, flags), re.sub(r"\\(\d)", r"$\1", repl))


def starts(x, pats) -> Column:
    out = F.lit(False)
    for p in (pats,) if isinstance(pats, str) else pats:
        out = out | x.startswith(p)
    return F.when(x.isNotNull(), out)


def ends(x, pats) -> Column:
    out = F.lit(False)
    for p in (pats,) if isinstance(pats, str) else pats:
        out = out | x.endswith(p)
    return F.when(x.isNotNull(), out)


def split(x, sep: str = " ") -> Column:
    return F.split(x, rf"\Q{sep}\E")


def zfill(x, width: int) -> Column:
    body = pad(F.substring(x, 2, 2**31 - 1), width - 1, "left", "0")
    return F.when(x.rlike("^[+-]"), F.concat(F.substring(x, 1, 1), body)).otherwise(pad(x, width, "left", "0"))


def find(x, sub: str, start: int | None = None, end: int | None = None) -> Column:
    bounded = F.substring(x, 1, end) if end is not None else x
    return (F.instr(F.substring(bounded, (start or 0) + 1, 2**31 - 1), sub) - 1 + F.lit(start or 0)).cast("bigint") if not start else F.when(F.instr(F.substring(bounded, start + 1, 2**31 - 1), sub) > 0, F.instr(F.substring(bounded, start + 1, 2**31 - 1), sub) - 1 + start).otherwise(-1).cast("bigint")


def extract(x, pat: str, group: int = 1) -> Column:
    return F.when(x.rlike(pat), F.regexp_extract(x, pat, group))


def slice_(x, start: int | None = None, stop: int | None = None) -> Column:
    n = F.length(x)
    at = F.lit(start or 0) if (start or 0) >= 0 else F.greatest(n + start, F.lit(0))
    to = n if stop is None else (F.lit(stop) if stop >= 0 else n + stop)
    return F.substring(x, (at + 1).cast("int"), F.greatest(to - at, F.lit(0)).cast("int"))


def repeat(x, n: int) -> Column:
    return F.repeat(x, n)


SIMPLE = {
    "len": lambda x: F.char_length(x).cast("bigint"), "lower": F.lower, "upper": F.upper, "reverse": F.reverse, "capitalize": capitalize,
    "isalnum": isalnum, "isalpha": isalpha, "isdecimal": isdecimal, "isdigit": isdigit, "isnumeric": isnumeric, "isspace": isspace, "islower": islower, "isupper": isupper,
}
