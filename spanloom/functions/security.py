"""Confusable skeletons, mixed scripts and identifier properties.

The confusable prototypes and identifier properties are read once per session from the ICU
library that comes with Spark, by one call for all characters, and travel to the workers as a
dictionary of a few thousand characters.  ``Skeletons`` may be built from any other table.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import ucd

#: Identifier types in the order of their names' list.
IDENTIFIER_TYPES = (
    "Not_Character Deprecated Default_Ignorable Not_NFKC Not_XID Exclusion Obsolete Technical Uncommon_Use Limited_Use Inclusion Recommended"
).split()

_tables: dict[str, dict] = {}


class Skeletons(dict):
    """Character to its confusable prototype; those not listed stand for themselves."""

    def of(self, text: str, normalization: str = "NFKD", fold: bool = True) -> str:
        """Normalize, fold case, replace each character by its prototype."""
        if normalization != "none":
            text = unicodedata.normalize(normalization, text)
        if fold:
            text = text.casefold()
        return text.translate(self)


def prototypes(spark: SparkSession) -> Skeletons:
    """The confusable table of the session's ICU."""
    if "prototypes" not in _tables:
        jvm = spark.sparkContext._jvm
        checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        chars = [chr(cp) for cp in range(0x20, 0x32000) if not 0xD800 <= cp <= 0xF8FF and unicodedata.category(chr(cp)) not in ("Cn", "Co", "Cc")]
        chars = [c for c in chars if unicodedata.normalize("NFD", c) == c and not 0x3400 <= ord(c) <= 0x9FFF and not 0x20000 <= ord(c)]
        cut = "\n"
        found: dict[int, str] = {}
        for i in range(0, len(chars), 20_000):
            part = chars[i : i + 20_000]
            got = checker.getSkeleton(cut.join(part)).split(cut)
            if len(got) != len(part):
                raise RuntimeError("the confusable table cannot be read from this ICU")
            # a mark is moved by the canonical order only within its own piece
            found.update({ord(c): g for c, g in zip(part, got, strict=True) if g and g != c})
        _tables["prototypes"] = found
    return Skeletons(_tables["prototypes"])


def skeleton(text: Column, table: Skeletons, normalization: str = "NFKD", fold: bool = True) -> Column:
    plain = dict(table)

    def run(s: pd.Series) -> pd.Series:
        known = Skeletons(plain)
        return s.map(lambda x: None if x is None else known.of(x, normalization, fold))

    return F.pandas_udf(run, "string")(text)


def is_confusable(a: Column, b: Column, table: Skeletons, normalization: str = "NFKD", fold: bool = True) -> Column:
    return skeleton(a, table, normalization, fold) == skeleton(b, table, normalization, fold)


def identifier_properties(spark: SparkSession) -> dict[str, list[tuple[int, int]]]:
    """Ranges of the code points that are Allowed, and of each identifier type, in the session's ICU."""
    if "identifiers" not in _tables:
        jvm = spark.sparkContext._jvm

        def ranges(pattern: str) -> list[tuple[int, int]]:
            found = jvm.com.ibm.icu.text.UnicodeSet(pattern)
            return [(found.getRangeStart(i), found.getRangeEnd(i)) for i in range(found.getRangeCount())]

        _tables["identifiers"] = {"Allowed": ranges("[:Identifier_Status=Allowed:]")} | {t: ranges(f"[:Identifier_Type={t}:]") for t in IDENTIFIER_TYPES}
    return _tables["identifiers"]


def _inside(ranges: list[tuple[int, int]], cp: int) -> bool:
    from bisect import bisect_right

    i = bisect_right(ranges, (cp, 0x110000)) - 1
    return i >= 0 and ranges[i][0] <= cp <= ranges[i][1]


def identifier_of(cp: int, table: dict[str, list[tuple[int, int]]]) -> tuple[str, int, list[str]]:
    """Status, bit mask of the types (bit by place in ``IDENTIFIER_TYPES``) and their names; a code point in none is Not_Character."""
    types = [t for t in IDENTIFIER_TYPES if _inside(table[t], cp)] or ["Not_Character"]
    return "Allowed" if _inside(table["Allowed"], cp) else "Restricted", sum(1 << IDENTIFIER_TYPES.index(t) for t in types), types


def identifier(char: Column, table: dict[str, list[tuple[int, int]]]) -> Column:
    """struct<status, mask, types, type> of the first character; ``type`` joins the names by |."""

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if not x else (*(r := identifier_of(ord(x[0]), table)), "|".join(r[2])) for x in s]
        return pd.DataFrame(rows, columns=["status", "mask", "types", "type"])

    return F.pandas_udf(run, "struct<status:string,mask:int,types:array<string>,type:string>")(char)


def scripts(token: Column) -> Column:
    """Scripts of a token, without Common and Inherited where there are others."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else ucd.token_scripts(x)), "array<string>")(token)
