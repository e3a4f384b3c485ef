"""Lossless exchange of texts: strict base64, UTF-16LE bytes, envelopes of four kinds, spans.

A column of texts is a string column, which holds no lone surrogates, or a binary one of UTF-16LE
bytes, which may.  Envelopes are structs (v, kind, text, base64, code_units) with nulls in the
fields that a kind does not have.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import segment

KINDS = ("string", "utf8-base64", "utf16le-base64", "utf16-code-units")
_BASE64 = "^(?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
_NOT_IJSON = re.compile("[\ud800-\udfff﷐-﷯" + "".join(f"{chr(p * 0x10000 + 0xFFFE)}{chr(p * 0x10000 + 0xFFFF)}" for p in range(17)) + "]")


def base64_encode(raw: Column) -> Column:
    """RFC 4648 with padding, on one line."""
    return F.regexp_replace(F.base64(raw), "[\\r\\n]", "")


def base64_decode(text: Column, strict: bool = True) -> Column:
    """Bytes of padded base64 text; anything else is an error, or null where not ``strict``."""
    bad = F.raise_error(F.lit("BASE64_INVALID")).cast("binary") if strict else F.lit(None).cast("binary")
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(F.rlike(text, F.lit(_BASE64)), F.unbase64(text)).otherwise(bad)


def utf16le(text: Column) -> Column:
    return F.encode(text, "UTF-16LE")


def from_utf16le(raw: Column, strict: bool = True) -> Column:
    """UTF-16LE bytes as a string; an odd length is an error, or null where not ``strict``."""
    bad = F.raise_error(F.lit("PROTOCOL_INVALID_ENVELOPE")).cast("string") if strict else F.lit(None).cast("string")
    return F.when(raw.isNull(), F.lit(None).cast("string")).when(F.octet_length(raw) % 2 == 0, F.decode(raw, "UTF-16LE")).otherwise(bad)


def slice_by_span(text: Column, start: Column, end: Column) -> Column:
    """The part of a text from ``start`` to ``end`` (exclusive) in UTF-16 code units; offsets outside are cut to it."""
    low = F.greatest(start, F.lit(0))
    return F.decode(F.substring(utf16le(text), low * 2 + 1, F.greatest(end - low, F.lit(0)) * 2), "UTF-16LE")


def is_well_formed(raw: Column) -> Column:
    """Whether UTF-16LE bytes have no unpaired surrogate; null for null, false for an odd length."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(x) % 2 == 0 and not segment.lone_surrogates(segment.from_utf16(x)))

    return F.pandas_udf(run, "boolean")(raw)


def to_well_formed(raw: Column) -> Column:
    """UTF-16LE bytes as a string, each unpaired surrogate as U+FFFD."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else segment.well_formed(segment.from_utf16(x))), "string")(raw)


def lone_surrogates(raw: Column) -> Column:
    """array<struct<start,end,code_unit,kind>> of the unpaired surrogates in UTF-16LE bytes."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"start": a, "end": a + 1, "code_unit": u, "kind": k} for a, u, k in segment.lone_surrogates(segment.from_utf16(x))])

    return F.pandas_udf(run, "array<struct<start:int,end:int,code_unit:int,kind:string>>")(raw)


def is_ijson_text(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return not _NOT_IJSON.search(text)


def envelope(text: str, prefer: str = "string", fallback: str = "utf16-code-units") -> dict:
    """The envelope of one text, of the preferred kind where that can hold it, else of the other."""
    if prefer == "string" and text.isascii():
        return {"v": 1, "kind": prefer, "text": text}
    whole = not segment.lone_surrogates(text)
    for kind in (prefer, fallback, "utf16-code-units"):
        if kind == "string" and is_ijson_text(text):
            return {"v": 1, "kind": kind, "text": text}
        if kind == "utf8-base64" and whole:
            return {"v": 1, "kind": kind, "base64": base64.b64encode(text.encode()).decode()}
        if kind == "utf16le-base64":
            return {"v": 1, "kind": kind, "base64": base64.b64encode(segment.to_utf16(text)).decode()}
        if kind == "utf16-code-units":
            raw = segment.to_utf16(text)
            return {"v": 1, "kind": kind, "codeUnits": [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]}
    raise AssertionError(prefer)


def open_envelope(e: dict) -> str:
    """The text of an envelope; one that is not valid is an error."""
    bad = ValueError("PROTOCOL_INVALID_ENVELOPE")
    kind = e.get("kind")
    if e.get("v") != 1 or kind not in KINDS:
        raise bad
    if kind == "string":
        return e["text"]
    if kind == "utf16-code-units":
        units = e["codeUnits"]
        if any(not isinstance(u, int) or isinstance(u, bool) or not 0 <= u <= 0xFFFF for u in units):
            raise bad
        return segment.from_utf16(b"".join(u.to_bytes(2, "little") for u in units))
    if not re.fullmatch(_BASE64[1:-1], e["base64"]):
        raise bad
    raw = base64.b64decode(e["base64"])
    return raw.decode() if kind == "utf8-base64" else segment.from_utf16(raw)


#: Rows whose code units are made together.
CHUNK = 256


def code_units(text: Column) -> Column:
    """array<int> of the UTF-16 code units; null for null."""

    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.field("element", pa.int32()))
        made = [pa.array([], kind)]
        for i in range(0, len(column), CHUNK):
            part = column[i : i + CHUNK]
            raw = [b"" if x is None else x.encode("utf-16-le") for x in part.to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, raw)]) // 2, pa.int32())
            values = pa.array(np.frombuffer(b"".join(raw), "<u2").astype(np.int32))
            made.append(pa.ListArray.from_arrays(ends, values, type=kind, mask=part.is_null()))
        return pa.concat_arrays(made)

    return F.arrow_udf(run, "array<int>")(text)


def from_code_units(units: Column) -> Column:
    """The text of UTF-16 code units; null where one is null or outside of 0 to 0xFFFF; an unpaired surrogate is an error."""

    def run(column: pa.Array) -> pa.Array:
        made = [pa.array([], pa.string())]
        for i in range(0, len(column), CHUNK):
            found: list[str | None] = []
            for x in column[i : i + CHUNK]:
                if not x.is_valid or x.values.null_count:
                    found.append(None)
                    continue
                codes = x.values.to_numpy(zero_copy_only=False)
                found.append(None if len(codes) and not (codes.min() >= 0 and codes.max() <= 0xFFFF) else codes.astype("<u2").tobytes().decode("utf-16-le"))
            made.append(pa.array(found, pa.string()))
        return pa.concat_arrays(made)

    return F.arrow_udf(run, "string")(units)


def encode_envelope(text: Column, prefer: str = "string", fallback: str = "utf16-code-units") -> Column:
    """Envelope of a string column: such a text is well-formed, so only noncharacters keep it from being a JSON string.  Native but for code units."""
    if prefer not in KINDS or fallback not in KINDS:
        raise ValueError(f"unknown envelope kind {prefer} or {fallback}")
    second = fallback if fallback != "string" else "utf16-code-units"
    safe = ~F.rlike(text, F.lit("[\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(1, 17)) + "\\x{FFFE}\\x{FFFF}]"))
    kind = F.when(safe, prefer).otherwise(second) if prefer == "string" else F.lit(prefer)
    raw = utf16le(text)
    codes = code_units(F.when(kind == "utf16-code-units", text)) if "utf16-code-units" in (prefer, second if prefer == "string" else "") else F.lit(None).cast("array<int>")
    return F.when(
        text.isNotNull(),
        F.struct(
            F.lit(1).alias("v"),
            kind.alias("kind"),
            F.when(kind == "string", text).alias("text"),
            F.when(kind == "utf8-base64", base64_encode(F.encode(text, "UTF-8"))).when(kind == "utf16le-base64", base64_encode(raw)).alias("base64"),
            codes.alias("code_units"),
        ),
    )


def decode_envelope(e: Column, strict: bool = True) -> Column:
    """The text of an envelope with well-formed text; an envelope that is not valid is an error, or null where not ``strict``."""
    bad = F.raise_error(F.lit("PROTOCOL_INVALID_ENVELOPE")).cast("string") if strict else F.lit(None).cast("string")
    raw = base64_decode(e["base64"], strict)
    joined = from_code_units(F.when(e["kind"] == "utf16-code-units", e["code_units"]))
    utf8 = F.decode(raw, "UTF-8") if strict else F.try_validate_utf8(raw.cast("string"))
    return (
        F.when(e.isNull(), F.lit(None).cast("string"))
        .when(e["v"] != 1, bad)
        .when((e["kind"] == "string") & e["text"].isNotNull(), e["text"])
        .when((e["kind"] == "utf8-base64") & e["base64"].isNotNull(), utf8)
        .when((e["kind"] == "utf16le-base64") & e["base64"].isNotNull(), from_utf16le(raw, strict))
        .when((e["kind"] == "utf16-code-units") & joined.isNotNull(), joined)
        .otherwise(bad)
    )
