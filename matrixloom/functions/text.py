"""Strings, paths, numbers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matrixloom.model import column

C = str | Column


def lines(s: C) -> Column:
    return F.split(column(s), r"\r?\n")


def words(s: C, keep_empty: bool = False) -> Column:
    return _kept(F.split(column(s), r"\s+"), keep_empty)


def csv_fields(s: C, keep_empty: bool = False) -> Column:
    """Fields between white space or commas; quotes mean nothing."""
    return _kept(F.split(column(s), r"[\s,]+" if not keep_empty else r"[\s,]"), keep_empty)


def _kept(parts: Column, keep_empty: bool) -> Column:
    return parts if keep_empty else F.filter(parts, lambda x: x != "")


def path_head(s: C) -> Column:
    """What stands before the last slash."""
    return F.regexp_extract(column(s), r"^(.*)/[^/]*$", 1)


def path_tail(s: C) -> Column:
    return F.substring_index(column(s), "/", -1)


def path_ext(s: C) -> Column:
    """The extension with its dot; a name that begins with its only dot has none."""
    return F.regexp_extract(path_tail(s), r"[^.](\.[^.]*)$", 1)


def strip_ext(s: C) -> Column:
    return F.regexp_replace(column(s), r"(?<=[^/.])\.[^./]*$", "")


def find(s: C, part: C) -> Column:
    """Place, from 0, of the first occurrence; -1 if there is none."""
    return F.instr(column(s), part) - 1


def is_blank(s: C) -> Column:
    return column(s).rlike(r"^\s*$")


def hex_to_binary(s: C) -> Column:
    return F.conv(column(s), 16, 2)


def parse_number(s: C) -> Column:
    return column(s).try_cast("double")


def format_number(v: C, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", column(v).cast("double"))


def djb2(s: C) -> Column:
    """Bernstein's hash over UTF-8 bytes, 33 h + byte from 5381, modulo 2^32."""
    data = F.hex(column(s).cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.length(data) - 1, F.lit(2)), lambda i: F.conv(F.substring(data, i, 2), 16, 10).cast("long"))
    start = F.lit(5381).cast("long")
    return F.when(F.length(data) == 0, start).otherwise(F.aggregate(codes, start, lambda h, c: (h * 33 + c) % (1 << 32)))


def xorshift64(x: C) -> Column:
    """One step of the 13, 7, 17 generator."""
    x = column(x)
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def kr_hash(s: C) -> Column:
    """Kernighan and Ritchie's hash over UTF-8 bytes, 31 h + byte from 0, modulo 2^32."""
    data = F.hex(column(s).cast("binary"))
    codes = F.transform(F.sequence(F.lit(1), F.length(data) - 1, F.lit(2)), lambda i: F.conv(F.substring(data, i, 2), 16, 10).cast("long"))
    start = F.lit(0).cast("long")
    return F.when(F.length(data) == 0, start).otherwise(F.aggregate(codes, start, lambda h, c: (h * 31 + c) % (1 << 32)))
