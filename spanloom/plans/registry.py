"""Schemas of the exchange formats and the tools that make them, as plain JSON values."""

from __future__ import annotations

from collections.abc import Mapping

DRAFT = "https://json-schema.org/draft/2020-12/schema"


def _object(properties: Mapping, required: tuple[str, ...] = (), **more: object) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(required), "properties": dict(properties)} | more


def _array(items: Mapping) -> dict:
    return {"type": "array", "items": dict(items)}


WHOLE, TEXT, FLAG = {"type": "integer", "minimum": 0}, {"type": "string"}, {"type": "boolean"}
SPAN = _object({"startCU": WHOLE, "endCU": WHOLE}, ("startCU", "endCU"))
RATIO = _object({"num": {"type": "string", "pattern": "^[0-9]+$"}, "den": {"type": "string", "pattern": "^[1-9][0-9]*$"}}, ("num", "den"))
PROVENANCE = _object(
    {"unicodeVersion": TEXT, "algorithm": _object(dict.fromkeys(("name", "spec", "revisionOrDate", "implementationId"), TEXT), ("name", "spec", "revisionOrDate", "implementationId")), "configHash": TEXT, "units": {"type": "object"}},
    ("unicodeVersion", "algorithm", "configHash", "units"),
)


def _envelope(kind: str, field: str, schema: Mapping) -> dict:
    return _object({"v": {"const": 1}, "kind": {"const": kind}, field: schema}, ("v", "kind", field))


_BASE64 = {"type": "string", "contentEncoding": "base64"}
ENVELOPE = {
    "oneOf": [
        _envelope("string", "text", TEXT),
        _envelope("utf8-base64", "base64", _BASE64),
        _envelope("utf16le-base64", "base64", _BASE64),
        _envelope("utf16-code-units", "codeUnits", _array({"type": "integer", "minimum": 0, "maximum": 65535})),
    ]
}
_COUNTED = {"count": WHOLE, "spans": _array(SPAN), "spansTruncated": FLAG}
_NAMED = lambda name: _array(_object({name: TEXT, "count": WHOLE}, (name, "count")))
_FINDING = _object({"kind": TEXT, "span": SPAN, "codePoint": WHOLE}, ("kind", "span", "codePoint"))
_CHANGES = _object(dict.fromkeys(("nfcChanged", "nfdChanged", "nfkcChanged", "nfkdChanged"), FLAG))
PACK = _object(
    {
        "v": {"const": 1},
        "build": _object(dict.fromkeys(("libraryVersion", "unicodeVersion", "algorithmRevision"), TEXT), ("libraryVersion", "unicodeVersion", "algorithmRevision")),
        "input": _object({"text": ENVELOPE}),
        "integrity": _object({"profile": _object({"wellFormed": FLAG, "counts": {"type": "object", "additionalProperties": WHOLE}, "samples": {"type": "object", "additionalProperties": _array(_FINDING)}}, ("wellFormed", "counts", "samples"))}),
        "unicode": _object({"scripts": _NAMED("script"), "generalCategories": _NAMED("category"), "normalization": _CHANGES, "bidiControls": WHOLE, "defaultIgnorables": WHOLE}),
        "segment": _object(dict.fromkeys(("graphemes", "words", "sentences"), _object(_COUNTED, ("count",)))),
        "security": {"type": "object"},
        "variants": {"type": "object"},
        "profile": {"type": "object"},
        "fingerprint": _object({"count": WHOLE, "fingerprints": _array(_object({"hash64Hex": TEXT, "tokenIndex": WHOLE, "span": SPAN}, ("hash64Hex", "tokenIndex", "span"))), "truncated": FLAG, "provenance": PROVENANCE}, ("count",)),
        "provenance": PROVENANCE,
    },
    ("v", "build", "provenance"),
)
_ISSUE = _object({"code": TEXT, "labelIndex": WHOLE, "codePoint": WHOLE}, ("code",))
IDNA_RESULT = _object({"ok": FLAG, "value": TEXT, "errors": _array(_ISSUE), "warnings": _array(_ISSUE)}, ("ok", "value", "errors", "warnings"))
IDNA_OPTIONS = _object(dict.fromkeys(("std3", "hyphens", "bidi", "joiners", "verify_length"), FLAG))

SCHEMAS: dict[str, dict] = {
    name: {"$schema": DRAFT, "$id": f"spanloom:{name}"} | schema for name, schema in {"text-envelope-v1": ENVELOPE, "pack-v1": PACK, "idna-result-v1": IDNA_RESULT, "uts46-options-v1": IDNA_OPTIONS}.items()
}


def json_schema(name: str, target: str = "draft-2020-12") -> dict:
    """The schema of that name; another target or name is an error."""
    if target != "draft-2020-12":
        raise ValueError(f"SCHEMA_TARGET_UNSUPPORTED: {target}")
    return SCHEMAS[name]


_TOKENS = {"tokenizer": {"enum": ["uax29-word", "uax29-grapheme", "codePoint"]}, "canonicalKey": {"enum": ["raw", "nfc", "nfkc", "nfkcCaseFold", "skeleton"]}}
_LIMITS = {"maxTokens": WHOLE, "maxD": WHOLE, "prefer": {"enum": ["delete", "insert"]}}
_WINNOW = {"k": {"type": "integer", "minimum": 1}, "window": {"type": "integer", "minimum": 1}, "dedupe": {"enum": ["by-hash", "by-position", "none"]}}


def _tool(name: str, says: str, inputs: Mapping, required: tuple[str, ...], output: Mapping, operator: str) -> dict:
    """``operator`` names the function that does it on columns or tables."""
    return {"v": 1, "name": name, "description": says, "inputSchema": {"$schema": DRAFT} | _object(inputs, required), "outputSchema": {"$schema": DRAFT} | dict(output), "operator": operator}


_ONE = {"text": ENVELOPE, "opts": {"type": "object"}}
TOOLS: dict[str, dict] = {
    t["name"]: t
    for t in (
        _tool("packTextV1", "All requested facts of one text as a pack that I-JSON can hold.", _ONE, ("text",), PACK, "spanloom.operators.packs.pack_v1"),
        _tool("packTextV1Sha256", "Checksum of a text's pack.", _ONE, ("text",), TEXT, "spanloom.operators.packs.pack_v1"),
        _tool("diffText", "Token edits from one text to another.", {"a": ENVELOPE, "b": ENVELOPE, "options": _object(_TOKENS | _LIMITS)}, ("a", "b"), {"type": "object"}, "spanloom.operators.diff.text_diffs"),
        _tool(
            "compareTextsDetailed", "Shared fingerprints of two texts by exact fractions, with a diff if asked.", {"a": ENVELOPE, "b": ENVELOPE, "options": _object(_TOKENS | _LIMITS | {"fingerprint": _object(_WINNOW), "diff": FLAG})}, ("a", "b"),
            _object({"jaccard": RATIO, "containmentAinB": RATIO, "containmentBinA": RATIO, "overlapCount": TEXT}), "spanloom.operators.diff.compare_texts",
        ),
        _tool("winnowingFingerprints", "Winnowing fingerprints of a text.", {"text": ENVELOPE, "options": _object(_TOKENS | _WINNOW)}, ("text",), {"type": "object"}, "spanloom.operators.fingerprint.fingerprints"),
        _tool("integrityProfile", "Counts and samples of integrity findings.", {"text": ENVELOPE}, ("text",), {"type": "object"}, "spanloom.operators.scan.integrity_samples"),
        _tool("confusableSkeleton", "Skeleton of a text.", {"text": ENVELOPE}, ("text",), ENVELOPE, "spanloom.functions.security.skeleton"),
        _tool("uts46ToAscii", "Domain name in ASCII.", {"domain": TEXT, "options": IDNA_OPTIONS}, ("domain",), IDNA_RESULT, "spanloom.functions.idna.uts46_to_ascii"),
        _tool("uts46ToUnicode", "Domain name in Unicode.", {"domain": TEXT, "options": IDNA_OPTIONS}, ("domain",), IDNA_RESULT, "spanloom.functions.idna.uts46_to_unicode"),
    )
}


def tool_spec(name: str) -> dict:
    return TOOLS[name]


def list_tool_specs() -> list[dict]:
    return [TOOLS[n] for n in sorted(TOOLS)]


def to_mcp_tool(spec: Mapping) -> dict:
    """A tool in the form that the Model Context Protocol lists."""
    return {k: spec[k] for k in ("name", "description", "inputSchema", "outputSchema")}
