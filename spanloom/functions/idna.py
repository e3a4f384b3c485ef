"""Domain names by UTS #46: mapping, to Unicode and to ASCII, with the errors and warnings found.

The mapping is derived, not stored: a character is mapped to its NFKC case folding without default
ignorables, ignored if nothing is left, valid if it maps to itself, and disallowed by its category.
Four deviation characters are valid.  Unicode data are those of the interpreter and the pattern
engine.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ucd import lookup, predicate, script

#: Fixed values.
DOTS = "。．｡"
DEVIATIONS = "ßς‌‍"
_VIRAMA = 9
_DISALLOWED = frozenset(("Cc", "Cf", "Cs", "Co", "Cn", "Zs", "Zl", "Zp"))
_RTL_ALLOWED = frozenset(("R", "AL", "AN", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"))
_LTR_ALLOWED = frozenset(("L", "EN", "ES", "CS", "ET", "ON", "BN", "NSM"))
_NON_JOINER = regex.compile(r"[\p{Joining_Type=L}\p{Joining_Type=D}]\p{Joining_Type=T}*‌\p{Joining_Type=T}*[\p{Joining_Type=R}\p{Joining_Type=D}]")


@cache
def status(char: str) -> tuple[str, str]:
    """(valid, mapped, ignored, deviation or disallowed; what it is mapped to)."""
    cp = ord(char)
    if char.isascii():
        return ("mapped", char.lower()) if char.isupper() else ("valid", char)
    if char == "。":
        return "mapped", "."
    if char in DEVIATIONS:
        return "deviation", char
    kind = lookup("General_Category")[cp]
    if predicate("noncharacter")[cp] or kind in ("Cs", "Co", "Cn", "Cc") or 0x2FF0 <= cp <= 0x2FFF or cp in (0x31EF, 0xFFFC, 0xFFFD):
        return "disallowed", char
    if predicate("default_ignorable")[cp]:
        # soft hyphen, joiner, word joiner, byte order mark and variation selectors vanish; others are refused
        return ("ignored", "") if cp in (0xAD, 0x34F, 0x200B, 0x2060, 0x2064, 0xFEFF) or predicate("variation_selector")[cp] or cp == 0x180F else ("disallowed", char)
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", char).casefold())
    folded = unicodedata.normalize("NFC", "".join(c for c in folded if not predicate("default_ignorable")[ord(c)]))
    if char == "ẞ":
        folded = "ß"
    folded = folded.replace("。", ".")
    if folded != char:
        bad = any(lookup("General_Category")[ord(c)] in _DISALLOWED for c in folded)
        return ("disallowed", char) if bad or not folded else ("mapped", folded)
    return ("disallowed", char) if kind in _DISALLOWED else ("valid", char)


def _issue(code: str, **where: int) -> dict:
    return {"code": code, **where}


def map_domain(domain: str) -> tuple[str, list[dict], list[dict]]:
    """Mapped text, errors and warnings, each with the code point it is about."""
    out, errors, warnings = [], [], []
    for c in domain:
        kind, to = status(c)
        if 0xD800 <= ord(c) <= 0xDFFF:
            errors.append(_issue("ILL_FORMED_UNICODE", codePoint=ord(c)))
            continue
        if kind == "disallowed":
            code = "NONCHARACTER" if predicate("noncharacter")[ord(c)] else "UNASSIGNED" if predicate("unassigned")[ord(c)] else "DISALLOWED"
            errors.append(_issue(code, codePoint=ord(c)))
        elif kind != "valid":
            warnings.append(_issue(kind.upper(), codePoint=ord(c)))
        out.append(to)
    return unicodedata.normalize("NFC", "".join(out)), errors, warnings


def punycode(label: str) -> str | None:
    """A label without its prefix, decoded; null where it is not valid."""
    try:
        if not label.isascii() or label.endswith("-") and "-" in label[:-1] and not label[:-1]:
            return None
        return label.encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return None


def _joiners(label: str) -> bool:
    """ContextJ."""
    for i, c in enumerate(label):
        if c == "‍" and not (i and unicodedata.combining(label[i - 1]) == _VIRAMA):
            return False
        if c == "‌" and not (i and unicodedata.combining(label[i - 1]) == _VIRAMA):
            if not any(m.start() < i < m.end() for m in _NON_JOINER.finditer(label, overlapped=True)):
                return False
    return True


def _contexto(label: str) -> bool:
    """The rules of RFC 5892 for middle dot, keraia, geresh, Katakana dot and Arabic digits."""
    names = {script()[ord(c)] for c in label}
    arabic = any(0x660 <= ord(c) <= 0x669 for c in label)
    for i, c in enumerate(label):
        before, after = label[i - 1 : i], label[i + 1 : i + 2]
        if c == "·" and (before, after) != ("l", "l"):
            return False
        if c == "͵" and (not after or script()[ord(after)] != "Greek"):
            return False
        if c in "׳״" and (not before or script()[ord(before)] != "Hebrew"):
            return False
        if c == "・" and not names & {"Hiragana", "Katakana", "Han"}:
            return False
        if 0x6F0 <= ord(c) <= 0x6F9 and arabic:
            return False
    return True


def _bidi_rule(label: str) -> bool:
    """RFC 5893 for one label."""
    kinds = [lookup("Bidi_Class")[ord(c)] for c in label]
    if kinds[0] not in ("L", "R", "AL"):
        return False
    rtl = kinds[0] != "L"
    if not set(kinds) <= (_RTL_ALLOWED if rtl else _LTR_ALLOWED) or rtl and {"EN", "AN"} <= set(kinds):
        return False
    last = next((k for k in reversed(kinds) if k != "NSM"), "")
    return last in (("R", "AL", "EN", "AN") if rtl else ("L", "EN"))


def process(domain: str, std3: bool = True, hyphens: bool = True, bidi: bool = True, joiners: bool = True) -> tuple[list[str], list[dict], list[dict]]:
    """Labels in Unicode, errors and warnings."""
    mapped, errors, warnings = map_domain(domain)
    labels, seen = [], set()
    for i, label in enumerate(mapped.split(".")):
        if label.startswith("xn--"):
            decoded = punycode(label[4:])
            if decoded is None or not label.isascii():
                errors.append(_issue("PUNYCODE_ERROR", labelIndex=i))
                labels.append(label)
                continue
            if decoded.isascii() or unicodedata.normalize("NFC", decoded) != decoded or any(status(c)[0] not in ("valid", "deviation") for c in decoded):
                errors.append(_issue("INVALID_ACE_PREFIX" if decoded.isascii() else "DISALLOWED", labelIndex=i))
            label = decoded
        labels.append(label)
        if label:
            errors += [_issue(code, labelIndex=i) for code in _label_issues(label, std3, hyphens, joiners)]
            seen |= {lookup("Bidi_Class")[ord(c)] for c in label}
    if bidi and seen & {"R", "AL", "AN"}:
        errors += [_issue("BIDI_RULE", labelIndex=i) for i, x in enumerate(labels) if x and not _bidi_rule(x)]
    return labels, errors, warnings


def _label_issues(label: str, std3: bool, hyphens: bool, joiners: bool) -> list[str]:
    found = []
    if hyphens:
        found += ["LEADING_HYPHEN"] * label.startswith("-") + ["TRAILING_HYPHEN"] * label.endswith("-") + ["HYPHEN_3_4"] * (label[2:4] == "--")
    if lookup("General_Category")[ord(label[0])] in ("Mn", "Mc", "Me"):
        found.append("DISALLOWED")
    if std3 and any(c.isascii() and not (c.islower() or c.isdigit() or c == "-") for c in label):
        found.append("STD3_DISALLOWED")
    if joiners:
        found += ["CONTEXTJ"] * (not _joiners(label)) + ["CONTEXTO"] * (not _contexto(label))
    return found


def to_unicode(domain: str, **options: bool) -> dict:
    labels, errors, warnings = process(domain, **options)
    return {"ok": not errors, "value": ".".join(labels), "errors": errors, "warnings": warnings}


def to_ascii(domain: str, verify_length: bool = True, **options: bool) -> dict:
    labels, errors, warnings = process(domain, **options)
    encoded = [x if x.isascii() else "xn--" + x.encode("punycode", "surrogatepass").decode("ascii") for x in labels]
    if verify_length:
        rooted = len(encoded) > 1 and not encoded[-1]
        for i, x in enumerate(encoded):
            errors += [_issue("EMPTY_LABEL", labelIndex=i)] * (not x) + [_issue("LABEL_TOO_LONG", labelIndex=i)] * (len(x) > 63)
        if len(".".join(encoded)) - rooted > 253:
            errors.append(_issue("DOMAIN_TOO_LONG"))
    return {"ok": not errors, "value": ".".join(encoded), "errors": errors, "warnings": warnings}


RESULT = "struct<ok:boolean,value:string,errors:array<string>,warnings:array<string>>"


def _applied(domain: Column, one: object) -> Column:
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            r = None if x is None else one(x)
            rows.append((None,) * 4 if r is None else (r["ok"], r["value"], [e["code"] for e in r["errors"]], [w["code"] for w in r["warnings"]]))
        return pd.DataFrame(rows, columns=["ok", "value", "errors", "warnings"])

    return F.pandas_udf(run, RESULT)(domain)


def uts46_to_ascii(domain: Column, **options: bool) -> Column:
    """See ``RESULT``: errors and warnings by their codes."""
    return _applied(domain, lambda x: to_ascii(x, **options))


def uts46_to_unicode(domain: Column, **options: bool) -> Column:
    return _applied(domain, lambda x: to_unicode(x, **options))


def uts46_map(domain: Column) -> Column:
    def one(x: str) -> dict:
        mapped, errors, warnings = map_domain(x)
        return {"ok": not errors, "value": mapped, "errors": errors, "warnings": warnings}

    return _applied(domain, one)
