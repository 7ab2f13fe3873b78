"""Identifiers of persons and works, in one written form each; null where a value is missing, damaged
or fails its check character. Every function takes and gives a string column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strings that stand for a missing value.
SENTINELS = ("", "na", "nan", "none", "null", "inconnu", "unknown", "undetermined", "n/a", "-", "?")


def present(c: Column) -> Column:
    """Trimmed text; null for blanks, sentinels and strings of zeros."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"[\s\u00a0]+", " "))
    return F.when(F.lower(t).isin(*SENTINELS) | t.rlike(r"^[0\s\-.]+$"), None).otherwise(t)


def _checks() -> Column:
    return F.split(F.lit("0123456789X"), "")


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, ""), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def ppn(c: Column) -> Column:
    """IdRef number: eight digits and a check character modulo 11, weights 9 to 2. One that was kept as a
    number may lack up to two leading zeros."""
    t = F.upper(F.regexp_replace(F.regexp_replace(present(c), r"(?i)^\s*(\(?idref\)?|ppn)[\s:/]*", ""), r"\.0$", ""))
    t = F.regexp_replace(t, r"[\s\-]", "")
    t = F.when(t.rlike("^[0-9]{6,8}[0-9X]$") & ~t.rlike("^0+$"), F.lpad(t, 9, "0"))
    weighted = F.transform(_digits(F.substring(t, 1, 8)), lambda x, i: x * (F.lit(9) - i))
    check = F.aggregate(weighted, F.lit(0), lambda s, x: s + x, lambda s: (F.lit(11) - s % 11) % 11)
    return F.when(F.substring(t, 9, 1) == F.element_at(_checks(), check + 1), t)


def viaf(c: Column) -> Column:
    """VIAF number: 5 to 22 digits without leading zero; it has no check character."""
    t = F.regexp_replace(present(c), r"(?i)^(https?://)?(www\.)?viaf(\.org)?(/viaf)?[\s:/]*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"/+$", ""), r"\.0$", "")
    t = F.regexp_replace(t, r"[\s\u00a0]", "")
    return F.when(t.rlike("^[1-9][0-9]{4,21}$"), t)


def _mod11_2(t: Column) -> Column:
    """t (16 characters) where its ISO 7064 mod 11-2 check character is right, else null."""
    check = F.aggregate(_digits(F.substring(t, 1, 15)), F.lit(0), lambda s, x: ((s + x) * 2) % 11, lambda s: (F.lit(12) - s) % 11)
    return F.when(F.substring(t, 16, 1) == F.element_at(_checks(), check + 1), t)


def isni(c: Column) -> Column:
    t = F.upper(F.regexp_replace(F.regexp_replace(present(c), r"(?i)^(https?://)?(www\.)?isni(\.org)?[\s:/]*", ""), r"[\s\u00a0\-]", ""))
    return _mod11_2(F.when(t.rlike("^[0-9]{15}[0-9X]$"), t))


def orcid(c: Column) -> Column:
    """ORCID in four hyphenated groups of four."""
    t = F.regexp_replace(present(c), r"(?i)^(https?://)?orcid(\.org)?[\s:/]*", "")
    t = F.upper(F.regexp_replace(t, r"[\s\u00a0\-\u2010-\u2015\u2212]", ""))
    t = _mod11_2(F.when(t.rlike("^[0-9]{15}[0-9X]$"), t))
    return F.concat_ws("-", *[F.substring(t, i, 4) for i in (1, 5, 9, 13)]).substr(F.lit(1), F.when(t.isNotNull(), 19))


def bnf(c: Column) -> Column:
    t = F.lower(F.regexp_replace(present(c), r"[\s\u00a0]", ""))
    return F.when(t.rlike("^(cb)?[0-9]{8}[0-9a-z]?$"), F.regexp_extract(t, "[0-9]{8}", 0))
