"""Character functions with the language's own edge cases; every one returns a Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the delimiters of SCAN when none are given.
SCAN_DELIMITERS = " .<(+&!$*);^-/,%|"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def char_class(chars: str) -> str:
    """A regex class of exactly these characters."""
    return "[" + "".join("\\" + c if re.match(r"[\W_]", c) and not c.isspace() else c for c in chars) + "]"


def scan(s, n: int, delimiters: str = SCAN_DELIMITERS) -> Column:
    """The n-th word; runs of delimiters are one; negative n counts from the end; missing where there is none."""
    words = F.filter(F.split(_col(s), char_class(delimiters) + "+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(n))


def substr(s, at: int, length: int | None = None) -> Column:
    return _col(s).substr(F.lit(at), F.lit(length) if length is not None else F.length(_col(s)))


def assign_substr(s, at: int, new: str | Column) -> Column:
    """SUBSTR on the left of an assignment: characters from `at` on are replaced in place."""
    return F.overlay(_col(s), F.lit(new) if isinstance(new, str) else new, F.lit(at))


def index(s, sub: str) -> Column:
    """1-based place of the first occurrence, 0 without one."""
    return F.instr(_col(s), sub)


def find(s, sub: str, start: int = 1, ignore_case: bool = False) -> Column:
    text = F.lower(_col(s)) if ignore_case else _col(s)
    return F.locate(sub.lower() if ignore_case else sub, text, start)


def tranwrd(s, old: str, new: str) -> Column:
    return F.replace(_col(s), F.lit(old), F.lit(new))


def translate(s, to: str, old: str) -> Column:
    """Argument order of the language: replacement first."""
    return F.translate(_col(s), old, to)


def strip(s) -> Column:
    return F.trim(_col(s))


def trim(s) -> Column:
    return F.rtrim(_col(s))


def left(s) -> Column:
    return F.ltrim(_col(s))


def compress(s, chars: str | None = None, keep: bool = False) -> Column:
    """Without chars all blanks go; with chars these go, or (keep) all others."""
    if chars is None:
        return F.replace(_col(s), F.lit(" "), F.lit(""))
    own = char_class(chars)
    return F.regexp_replace(_col(s), own if not keep else "[^" + own[1:], "")


def compbl(s) -> Column:
    return F.regexp_replace(_col(s), " +", " ")


def _text(x) -> Column:
    return F.coalesce(_col(x).cast("string"), F.lit(""))


def cat(*parts) -> Column:
    return F.concat(*map(_text, parts))


def catt(*parts) -> Column:
    return F.concat(*(F.rtrim(_text(p)) for p in parts))


def cats(*parts) -> Column:
    return F.concat(*(F.trim(_text(p)) for p in parts))


def catx(separator: str, *parts) -> Column:
    """Missing and blank parts are left out with their separator."""
    trimmed = [F.trim(_col(p).cast("string")) for p in parts]
    return F.concat_ws(separator, *(F.when(t != "", t) for t in trimmed))


def upcase(s) -> Column:
    return F.upper(_col(s))


def lowcase(s) -> Column:
    return F.lower(_col(s))


def propcase(s, delimiters: str | None = None) -> Column:
    if delimiters is None:
        return F.initcap(_col(s))
    marked = F.regexp_replace(F.lower(_col(s)), f"({char_class(delimiters)})", "$1\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def length(s) -> Column:
    """Without trailing blanks; 1 for blank and missing."""
    return F.coalesce(F.greatest(F.length(F.rtrim(_col(s))), F.lit(1)), F.lit(1))


def lengthn(s) -> Column:
    return F.coalesce(F.length(F.rtrim(_col(s))), F.lit(0))


def lengthc(s) -> Column:
    return F.length(_col(s))


#: Character classes of the ANY and NOT scans.
CLASSES = {"alnum": "A-Za-z0-9", "alpha": "A-Za-z", "digit": "0-9", "lower": "a-z", "upper": "A-Z", "space": r"\s", "punct": r"\p{Punct}", "xdigit": "0-9A-Fa-f", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "first": "A-Za-z_", "name": "A-Za-z0-9_"}


def any_of(kind: str, s) -> Column:
    """1-based place of the first character of the class, 0 without one."""
    return F.regexp_instr(_col(s), F.lit(f"[{CLASSES[kind]}]"))


def not_of(kind: str, s) -> Column:
    return F.regexp_instr(_col(s), F.lit(f"[^{CLASSES[kind]}]"))


def count_of(s, sub: str) -> Column:
    return ((F.length(_col(s)) - F.length(F.replace(_col(s), F.lit(sub), F.lit("")))) / len(sub)).cast("int")


def countc(s, chars: str) -> Column:
    return F.length(F.regexp_replace(_col(s), "[^" + char_class(chars)[1:], ""))


def countw(s, delimiters: str = SCAN_DELIMITERS) -> Column:
    return F.size(F.filter(F.split(_col(s), char_class(delimiters) + "+"), lambda w: w != ""))


def indexc(s, chars: str) -> Column:
    return F.regexp_instr(_col(s), F.lit(char_class(chars)))


def verify(s, chars: str) -> Column:
    """Place of the first character that isn't one of these."""
    return F.regexp_instr(_col(s), F.lit("[^" + char_class(chars)[1:]))


def digest(kind: str, x: Column) -> Column:
    """MD5, SHA1, SHA256 or SHA512 of the bytes, as bytes; hex() of it is what HASHING gives."""
    kind = kind.upper()
    found = {"MD5": F.md5, "SHA1": F.sha1}.get(kind) or (lambda c: F.sha2(c, {"SHA256": 256, "SHA512": 512}[kind]))
    return F.unhex(found(x.cast("binary")))


def hashing(kind: str, x: Column) -> Column:
    """HASHING: upper-case hexadecimal digits."""
    return F.hex(digest(kind, x))


def hashing_hmac(x: Column, key: bytes) -> Column:
    """HMAC-SHA256 under a constant key, upper-case hexadecimal digits."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return hashing("SHA256", F.concat(outer, digest("SHA256", F.concat(inner, x.cast("binary")))))


def put(x, width: int | None = None, zeros: bool = False) -> Column:
    """PUT of a whole number: as text, or right-aligned to a width (with zeros for the Z format)."""
    text = F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    return text if width is None else F.lpad(text, width, "0" if zeros else " ")


def input_number(x) -> Column:
    """INPUT of text as a number; missing where it isn't one."""
    return F.trim(F.col(x) if isinstance(x, str) else x).try_cast("double")
