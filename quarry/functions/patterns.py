"""Perl-style pattern functions, patterns inline as /pattern/flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.errors import NonConvertible


def parse(pattern: str) -> str:
    """A Java pattern with its flags inline."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", pattern, re.S)
    if not m:
        raise ValueError(f"not a pattern: {pattern}")
    flags = "".join(f for f in m[2] if f in "imsx")
    return (f"(?{flags})" if flags else "") + m[1]


def prxmatch(pattern: str, s) -> Column:
    return F.regexp_instr(s if isinstance(s, Column) else F.col(s), F.lit(parse(pattern)))


def prxchange(pattern: str, times: int, s) -> Column:
    """s/from/to/flags for all matches (-1)."""
    if times != -1:
        raise NonConvertible("a positive number of changes")
    m = re.fullmatch(r"s/((?:[^/\\]|\\.)*)/((?:[^/\\]|\\.)*)/([a-z]*)", pattern, re.S)
    if not m:
        raise ValueError(f"not a change: {pattern}")
    return F.regexp_replace(s if isinstance(s, Column) else F.col(s), parse(f"/{m[1]}/{m[3]}"), m[2])


def prxposn(pattern: str, group: int, s) -> Column:
    return F.regexp_extract(s if isinstance(s, Column) else F.col(s), parse(pattern), group)


def prxsubstr(pattern: str, s) -> Column:
    """position and length of the first match; 0 and 0 without one."""
    c = s if isinstance(s, Column) else F.col(s)
    return F.struct(prxmatch(pattern, c).alias("position"), F.length(F.regexp_extract(c, parse(pattern), 0)).alias("length"))


def prxparen(*_):
    raise NonConvertible("PRXPAREN")
