"""Facts of one text as plain values: integrity, segments, security, variants, profile, fingerprints, diff, packs.

All functions take a Python string, which may hold lone surrogates, and count in UTF-16 code
units.  Results are dictionaries that canonical JSON can hold; ``operators/packs.py`` applies
them to columns.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache
from itertools import accumulate

import numpy as np

from . import bidi, kernels, linebreak, protocol, segment, ucd
from .provenance import provenance
from .security import Skeletons

#: Kinds of findings in the order in which one character is reported.
FINDING_KINDS = ("lone-surrogate", "default-ignorable", "bidi-control", "join-control", "variation-selector", "noncharacter")
CANONICAL_KEYS = ("raw", "nfc", "nfkc", "nfkcCaseFold", "skeleton")
REVISION = "Unicode 17.0.0"
PACK_REVISION = "spanloom-pack-v1"
VERSION = "0.2.0"


def _span(a: int, b: int) -> dict:
    return {"startCU": a, "endCU": b}


def _capped(items: list, most: float | None) -> tuple[list, bool]:
    if most is None or most == float("inf"):
        return items, False
    return items[: int(most)], len(items) > most


def by_count(counts: Mapping[str, int]) -> list[tuple[str, int]]:
    """Falling counts, ties by code point order."""
    if len(counts) < 2:
        return list(counts.items())
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def _commonest(counts: Mapping, most: float | None, least: int = 1) -> list[tuple]:
    """The ``most`` first of ``by_count`` among counts of ``least`` at least; only these are sorted."""
    if most is not None and most < len(counts):
        if most < 1:
            return []
        least = max(least, sorted(counts.values(), reverse=True)[int(most) - 1])
    found = sorted(((k, n) for k, n in counts.items() if n >= least), key=lambda x: (-x[1], x[0]))
    return _capped(found, most)[0]


def findings(text: str, include: Iterable[str] = (), most: int | None = None) -> list[dict]:
    """Findings in text order; ``include`` names kinds (none: all), ``most`` caps them."""
    wanted = [k for k in FINDING_KINDS if not include or k in set(include)]
    if text.isascii():
        return []
    tables = [(k, ucd.predicate(k.replace("-", "_"))) for k in wanted if k != "lone-surrogate"]
    out, at = [], 0
    for c in text:
        cp = ord(c)
        end = at + 1 + (cp > 0xFFFF)
        if 0xD800 <= cp <= 0xDFFF:
            kinds = ["lone-surrogate"] * ("lone-surrogate" in wanted)
        else:
            kinds = [k for k, t in tables if t[cp]] if cp >= 0xAD else []
        out += [{"kind": k, "span": _span(at, end), "codePoint": cp} for k in kinds]
        if most is not None and len(out) >= most:
            return out[:most]
        at = end
    return out


def integrity_profile(text: str, samples: int = 5) -> dict:
    found = findings(text)
    by_kind: dict[str, list[dict]] = {}
    for f in found:
        by_kind.setdefault(f["kind"], []).append(f)
    return {
        "wellFormed": not by_kind.get("lone-surrogate"),
        "counts": {k: len(by_kind.get(k, ())) for k in FINDING_KINDS},
        # the first of a kind is always shown
        "samples": {k: v[: max(samples, 1)] for k, v in by_kind.items()},
    }


def canonical(raw: str, key: str, table: Skeletons | None = None) -> str:
    if key in ("nfc", "nfkc"):
        return unicodedata.normalize(key.upper(), raw)
    if key == "nfkcCaseFold":
        return raw.casefold() if raw.isascii() else unicodedata.normalize("NFKC", raw).casefold()
    if key == "skeleton":
        return (table if table is not None else Skeletons()).of(raw)
    return raw


TOKENIZERS = {"uax29-word": "word", "uax29-grapheme": "grapheme", "uax29-sentence": "sentence"}
Custom = Callable[[str], Iterable[segment.Span]] | None


def _spans(text: str, tokenizer: str, custom: Custom = None) -> list[tuple[int, int, str]]:
    if tokenizer == "custom" and custom is None:
        raise ValueError("a custom tokenizer is required")
    return segment.spans(text, TOKENIZERS.get(tokenizer, "code_point"), custom if tokenizer == "custom" else None)


def _kept_spans(text: str, tokenizer: str, keep: str, custom: Custom) -> list[tuple[int, int, str]]:
    """``_spans`` without most of those that ``_token_facts`` passes over."""
    return segment.word_like_spans(text) if tokenizer == "uax29-word" and keep == "word-like" else _spans(text, tokenizer, custom)


def _hash64(text: str, algo: str) -> int:
    return _hash64_short(text, algo) if len(text) <= 64 else _hash64_any(text, algo)


def _hash64_any(text: str, algo: str) -> int:
    import xxhash

    if algo == "xxh64-utf8":
        return xxhash.xxh64_intdigest(segment.well_formed(text).encode())
    raw = segment.to_utf16(text) if algo == "fnv1a64-utf16le" else segment.well_formed(text).encode()
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


_hash64_short = lru_cache(1 << 16)(_hash64_any)


def tokenize(text: str, tokenizer: str = "uax29-word", key: str = "raw", algo: str = "xxh64-utf8", most: float | None = None, table: Skeletons | None = None, custom: Custom = None) -> list[dict]:
    """Tokens with span, raw text, canonical key and the key's 64-bit hash; any unknown tokenizer cuts code points."""
    known: dict[str, tuple[str, int]] = {}
    out = []
    for a, b, raw in _capped(_spans(text, tokenizer, custom), most)[0]:
        if (found := known.get(raw)) is None:
            k = canonical(raw, key, table)
            found = known[raw] = k, _hash64(k, algo)
        out.append({"span": (a, b), "raw": raw, "key": found[0], "hash": found[1]})
    return out


#: Distinct tokens of which a worker keeps what is said of them.
KNOWN = 1 << 16


def _token_facts(raw: str, tokenizer: str, canonicalize: str, keep: str, table: Skeletons | None, known: dict) -> dict | None:
    """What is said of a distinct token, looked up in ``known`` first; None for one that is passed over."""
    if raw in known:
        return known[raw]
    if len(known) >= KNOWN:
        known.clear()
    if tokenizer == "uax29-word" and keep == "word-like" and not segment.is_word_like(raw):
        known[raw] = None
        return None
    control = ucd.predicate("bidi_control")
    scripts = ucd.token_scripts(raw)
    key = canonical(raw, "raw" if canonicalize == "none" else canonicalize, table)
    found = known[raw] = {"raw": raw, "canonical": key, "scripts": scripts, "hasMixedScript": len(scripts) > 1, "hasBidiControls": not raw.isascii() and any(control[ord(c)] for c in raw)}
    return found


def tokens_of(text: str, tokenizer: str, canonicalize: str, keep: str, most: float | None, table: Skeletons | None, custom: Custom, known: dict) -> list[tuple[int, int, dict]]:
    """(start, end, facts) of each token."""
    out: list[tuple[int, int, dict]] = []
    for a, b, raw in _kept_spans(text, tokenizer, keep, custom):
        if most is not None and len(out) >= most:
            break
        if (found := known.get(raw)) is None:
            found = _token_facts(raw, tokenizer, canonicalize, keep, table, known)
        if found is not None:
            out.append((a, b, found))
    return out


def scan(text: str, tokenizer: str = "uax29-word", canonicalize: str = "none", keep: str = "all", most: float | None = None, table: Skeletons | None = None, custom: Custom = None) -> list[dict]:
    """Each token with its canonical form, scripts, and whether scripts are mixed or bidi controls inside."""
    return [{"spanCU": _span(a, b), **found} for a, b, found in tokens_of(text, tokenizer, canonicalize, keep, most, table, custom, {})]


def _envelope(text: str) -> dict:
    return protocol.envelope(text)


def security_facts(text: str, most: float | None = None, examples: int = 5, table: Skeletons | None = None, known: dict | None = None) -> dict:
    """Mixed-script tokens, and skeletons that stand for several forms."""
    if most is None:
        found = forms_of(segment.word_like(text), table, known)
    else:
        found = forms_of([t["raw"] for t in scan(text, keep="word-like", most=most)], table)
    total, mixed, count, forms = found
    many = sorted((k for k in forms if forms[k] > 1), key=lambda k: (-count[k], k))
    block: dict = {"count": len(many)}
    if many and examples > 0:
        block["examples"] = [{"skeleton": _envelope(k), "totalCount": count[k], "distinctForms": forms[k]} for k in many[:examples]]
    if len(many) > examples:
        block["truncated"] = True
    return {"totalTokens": total, "mixedScriptTokens": mixed, "skeletonCollisions": block}


def forms_of(words: Iterable[str], table: Skeletons | None = None, known: dict | None = None) -> tuple[int, int, Counter, Counter]:
    """Number of words, number of those of several scripts, words and distinct forms of each skeleton; ``known`` keeps skeletons."""
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    total = mixed = 0
    count, forms = Counter(), Counter()
    for form, n in Counter(words).items():
        if (key := known.get(form)) is None:
            key = known[form] = canonical(form, "skeleton", table)
        count[key] += n
        forms[key] += 1
        total += n
        mixed += n * (len(ucd.token_scripts(form)) > 1)
    return total, mixed, count, forms


def variants_of(text: str, tokenizer: str, key: str, keep: str, most: float | None, table: Skeletons | None, custom: Custom, known: dict) -> tuple[list[tuple[str, dict]], int, bool]:
    """(key, what is known of it), the commonest first; number of tokens; whether keys were passed over."""
    places: dict[str, list[tuple[int, int]]] = {}
    for a, b, raw in _kept_spans(text, tokenizer, keep, custom):
        places.setdefault(raw, []).append((a, b))
    keys: dict[str, dict] = {}
    total, cut = 0, False
    for raw, spans in places.items():
        found = _token_facts(raw, tokenizer, "none" if key == "raw" else key, keep, table, known)
        if found is None:
            continue
        n = len(spans)
        total += n
        if (e := keys.get(found["canonical"])) is None:
            if most is not None and len(keys) >= most:
                cut = True
                continue
            e = keys[found["canonical"]] = {"count": 0, "forms": [], "scripts": {}, "mixed": False}
        e["count"] += n
        e["forms"].append((raw, spans))
        for x in found["scripts"]:
            e["scripts"][x] = e["scripts"].get(x, 0) + n
        e["mixed"] |= found["hasMixedScript"]
    for e in keys.values():
        if len(e["forms"]) > 1:
            e["forms"].sort(key=lambda x: (-len(x[1]), x[0]))
    return sorted(keys.items(), key=lambda x: (-x[1]["count"], x[0])), total, cut


def variant_index(text: str, tokenizer: str = "uax29-word", key: str = "nfkcCaseFold", keep: str = "all", examples: int = 5, most: float | None = None, table: Skeletons | None = None, custom: Custom = None) -> dict:
    """Forms, examples and scripts behind each canonical key; beyond ``most`` keys new ones are passed over."""
    found, total, cut = variants_of(text, tokenizer, key, keep, most, table, custom, {})
    variants = [
        {
            "key": k,
            "totalCount": e["count"],
            "distinctForms": len(e["forms"]),
            "forms": [{"form": f, "count": len(s), "firstSpanCU": _span(*s[0]), "exampleSpansCU": [_span(*x) for x in s[:examples]]} for f, s in e["forms"]],
            "scriptsSummary": [{"script": s, "count": n} for s, n in by_count(e["scripts"])],
            "hasMixedScriptAny": e["mixed"],
        }
        for k, e in found
    ]
    return {"variants": variants, "totalTokens": total} | ({"truncated": True} if cut else {})


def histogram(lengths: Iterable[int], bins: Iterable[int]) -> dict:
    edges = sorted(bins)
    counts = [0] * (len(edges) + 1)
    for size, n in Counter(lengths).items():
        counts[bisect_left(edges, size)] += n
    return {"bins": [{"max": e, "count": c} for e, c in zip(edges, counts, strict=False)], "overflow": counts[-1]}


def char_ngrams(text: str, sizes: Iterable[int], top: int = 50) -> list[dict]:
    out = []
    for n in sizes:
        grams: Iterable[str] = text
        for j in range(1, n):
            grams = map(operator.add, grams, text[j:])
        counts = Counter(grams)
        out.append({"n": n, "total": max(0, len(text) - n + 1), "items": [{"gram": g, "count": c} for g, c in _commonest(counts, top)]} | ({"truncated": True} if top is not None and len(counts) > top else {}))
    return out


def grapheme_count(text: str) -> int:
    return len(text) - text.count("\r\n") if segment.is_latin(text) else len(segment.pieces(text, "grapheme"))


def surface_profile(text: str, sizes: Iterable[int] = (), top: int = 50, bins: Iterable[int] = (), keep: str = "word-like") -> dict:
    chars = Counter(text)
    category, script = ucd.lookup("General_Category"), ucd.script()
    categories, scripts = Counter(), Counter()
    for c, n in chars.items():
        categories[category[ord(c)]] += n
        scripts[script[ord(c)]] += n
    words = segment.word_like(text) if keep == "word-like" else segment.pieces(text, "word")
    sentences = segment.pieces(text, "sentence") if text else []
    control = ucd.predicate("bidi_control")
    parts: dict = {"graphemes": grapheme_count(text), "words": len(words), "sentences": len(sentences)}
    edges = list(bins)
    if edges:
        parts |= {"wordLengthHistogram": histogram(map(segment.code_units, words), edges), "sentenceLengthHistogram": histogram(map(segment.code_units, sentences), edges)}
    found = {
        "summary": {"codeUnits": segment.code_units(text), "codePoints": len(text), "bytes": len(segment.well_formed(text).encode())},
        "unicode": {
            "generalCategories": [{"category": k, "count": n} for k, n in by_count(categories)],
            "scripts": [{"script": k, "count": n} for k, n in by_count(scripts)],
            "normalization": {f"{f.lower()}Changed": not unicodedata.is_normalized(f, text) for f in ("NFC", "NFD", "NFKC", "NFKD")},
            "bidiControls": sum(n for c, n in chars.items() if control[ord(c)]),
        },
        "segmentation": parts,
        "punctuationWhitespace": {"punctuation": sum(n for k, n in categories.items() if k[0] == "P"), "whitespace": sum(n for k, n in categories.items() if k[0] == "Z")},
    }
    grams = char_ngrams(text, sizes, top)
    return found | ({"ngrams": {"charNgrams": grams}} if grams else {})


def winnowing(text: str, k: int = 5, window: int = 4, dedupe: str = "by-hash", most: float | None = None, max_tokens: float | None = None, **tokens: object) -> tuple[list[dict], bool]:
    """Fingerprints by token, and whether ``most`` cut them; a text of fewer shingles than a window has none."""
    k, window = max(1, int(k)), max(1, int(window))
    cut = tokenize(text, most=max_tokens, **tokens)
    picked, hashes = _picked([t["hash"] for t in cut], k, window, dedupe)
    picked, truncated = _capped(picked, most)
    if dedupe == "none":
        picked = sorted(picked)
    rows = [{"hash64Hex": f"{hashes[i]:016x}", "tokenIndex": i, "span": _span(cut[i]["span"][0], cut[i + k - 1]["span"][1])} for i in picked]
    return rows, truncated


def _picked(tokens: list[int], k: int, window: int, dedupe: str) -> tuple[list[int], list[int]]:
    """Chosen shingles of tokens by their hashes, and the hashes of all shingles."""
    from spanloom.operators.fingerprint import shingle_hashes, winnow

    hashes = shingle_hashes(np.array(tokens, np.uint64), k)
    return winnow(hashes, window, dedupe), hashes.tolist()


def ratio(num: int, den: int) -> dict:
    """A fraction of whole numbers as they are counted; 0/1 for nothing."""
    return {"num": str(num), "den": str(den)} if den else {"num": "0", "den": "1"}


def compare(a: str, b: str, k: int = 5, window: int = 4, dedupe: str = "by-hash", with_diff: bool = False, most: float | None = None, max_d: int | None = None, prefer: str = "delete", **tokens: object) -> dict:
    """Overlap of two texts' fingerprint sets by exact ratios, with a token diff if asked."""
    found = {"fingerprints": compared(*[tokenize(t, most=most, **tokens) for t in (a, b)], k, window, dedupe)}
    return found | ({"diff": diff(a, b, most, max_d, prefer, **tokens)} if with_diff else {})


def compared(a: list[dict], b: list[dict], k: int, window: int, dedupe: str) -> dict:
    """Fingerprint sets of two texts' tokens and their overlap."""
    k, window = max(1, int(k)), max(1, int(window))
    one, two = ({f"{h[i]:016x}" for i in at} for at, h in (_picked([t["hash"] for t in x], k, window, dedupe) for x in (a, b)))
    shared = len(one & two)
    return {"a": sorted(one), "b": sorted(two), "jaccard": ratio(shared, len(one | two)), "containmentAinB": ratio(shared, len(one)), "containmentBinA": ratio(shared, len(two)), "overlapCount": str(shared)}


def diff(a: str, b: str, most: float | None = None, max_d: int | None = None, prefer: str = "delete", **tokens: object) -> dict:
    """Token edits with their spans, and a summary."""
    from spanloom.operators.diff import edit_script

    x, y = (tokenize(t, most=most, **tokens) for t in (a, b))
    runs, cut = edit_script([t["key"] for t in x], [t["key"] for t in y], prefer, max_d)
    total = dict.fromkeys(("insert", "delete", "equal"), 0)
    edits = []
    for op, a0, a1, b0, b1 in runs:
        total[op] += b1 - b0 if op == "insert" else a1 - a0
        edit = {"op": op} | ({} if op == "insert" else {"a0": a0, "a1": a1}) | ({} if op == "delete" else {"b0": b0, "b1": b1})
        edit |= {} if op == "insert" else {"aSpans": [_span(*t["span"]) for t in x[a0:a1]]}
        edits.append(edit | ({} if op == "delete" else {"bSpans": [_span(*t["span"]) for t in y[b0:b1]]}))
    full = most is not None and (len(x) >= most or len(y) >= most)
    found = {"edits": edits, "summary": {"insertedTokens": total["insert"], "deletedTokens": total["delete"], "equalTokens": total["equal"]}, "aTokens": len(x), "bTokens": len(y)}
    return found | ({"truncated": True} if cut or full else {})


def _segments(text: str, tokenizer: str, most: float | None) -> dict:
    if not most and tokenizer == "grapheme":
        return {"count": grapheme_count(text)}
    found = segment.pieces(text, tokenizer) if text else []
    if not most:
        return {"count": len(found)}
    shown, cut = _capped(found, most)
    ends = list(accumulate(map(segment.code_units, shown)))
    return {"count": len(found), "spans": [_span(a, b) for a, b in zip([0, *ends], ends, strict=False)]} | ({"spansTruncated": True} if cut else {})


DEFAULT_SECTIONS = {"integrity": True, "unicode": True, "segment": True, "security": False, "variants": False, "profile": False, "fingerprint": False}


def pack_v1(text: str, options: Mapping | None = None, table: Skeletons | None = None) -> dict:
    """The exchange pack of one text: sections integrity, unicode and segment by default, others on request.

    Options: includeInputText, inputTextEncoding, maxSpans, maxExamples, maxTokens,
    maxFingerprints, topK, sections.  Strings of the input stand in envelopes.
    """
    pack = _pack_v1(text, options, table)
    kernels.assert_ijson(pack)
    return pack


def pack_v1_text(text: str, options: Mapping | None = None, table: Skeletons | None = None, known: tuple[dict, dict] | None = None) -> str:
    """Canonical JSON of ``pack_v1``; the long sections are written as they are found.  ``known`` keeps facts and skeletons of tokens between texts."""
    found = _pack_v1(text, options, table, known or ({}, {}))
    return "{" + ",".join(f'"{k}":{v if isinstance(v, _Json) else kernels.jcs_plain(v)}' for k, v in sorted(found.items())) + "}"


class _Json(str):
    """A value as canonical JSON."""


def _envelope_json(text: str) -> str:
    if text.isascii() or protocol.is_ijson_text(text):
        return f'{{"kind":"string","text":{kernels.quoted(text)},"v":1}}'
    return kernels.jcs_plain(_envelope(text))


def _variants_json(text: str, opts: Mapping, table: Skeletons | None, made: dict, known: dict) -> _Json:
    found, total, cut = variants_of(text, "uax29-word", "nfkcCaseFold", "word-like", opts.get("topK"), table, None, known)
    examples = opts.get("maxExamples", 5)
    span = lambda s: f'{{"endCU":{s[1]},"startCU":{s[0]}}}'
    rows = []
    for k, e in found:
        forms = ",".join(f'{{"count":{len(at)},"exampleSpansCU":[{",".join(map(span, at[:examples]))}],"firstSpanCU":{span(at[0])},"form":{_envelope_json(f)}}}' for f, at in e["forms"])
        scripts = ",".join(f'{{"count":{n},"script":"{x}"}}' for x, n in by_count(e["scripts"]))
        rows.append(f'{{"distinctForms":{len(e["forms"])},"forms":[{forms}],"hasMixedScriptAny":{"true" if e["mixed"] else "false"},"key":{_envelope_json(k)},"scriptsSummary":[{scripts}],"totalCount":{e["count"]}}}')
    return _Json(f'{{"provenance":{kernels.jcs_plain(made)},"totalTokens":{total},{'"truncated":true,' if cut else ""}"variants":[{",".join(rows)}]}}')


def _fingerprint_json(text: str, opts: Mapping, made: dict) -> _Json:
    keys: dict[str, int] = {}
    spans, _ = _capped(segment.spans(text, "word"), opts.get("maxTokens"))
    for _, _, raw in spans:
        if raw not in keys:
            keys[raw] = _hash64(canonical(raw, "nfkcCaseFold"), "xxh64-utf8")
    picked, hashes = _picked([keys[raw] for _, _, raw in spans], 3, 4, "by-hash")
    picked, cut = _capped(picked, opts.get("maxFingerprints"))
    rows = ",".join(f'{{"hash64Hex":"{hashes[i]:016x}","span":{{"endCU":{spans[i + 2][1]},"startCU":{spans[i][0]}}},"tokenIndex":{i}}}' for i in picked)
    return _Json(f'{{"count":{len(picked)},"fingerprints":[{rows}],"provenance":{kernels.jcs_plain(made)}{',"truncated":true' if cut else ""}}}')


def _pack_v1(text: str, options: Mapping | None, table: Skeletons | None, bulk: tuple[dict, dict] | None = None) -> dict:
    """``pack_v1`` before its strings are looked at; with ``bulk``, what is known of tokens, the long sections as ``_Json``."""
    opts = dict(options or {})
    sections = DEFAULT_SECTIONS | dict(opts.get("sections") or {})
    pack: dict = {
        "v": 1,
        "build": {"libraryVersion": VERSION, "unicodeVersion": REVISION.split()[1], "algorithmRevision": PACK_REVISION},
        "provenance": provenance("Protocol.PackV1", "spanloom:pack-v1", PACK_REVISION, opts | {"sections": sections}, {"text": "utf16-code-unit"}),
    }
    if opts.get("includeInputText"):
        pack["input"] = {"text": protocol.envelope(text, opts.get("inputTextEncoding", "string"), "utf16le-base64")}
    if sections["integrity"]:
        pack["integrity"] = {"profile": integrity_profile(text, opts.get("maxExamples", 5))}
    profile = surface_profile(text) if sections["unicode"] or sections["profile"] else {}
    if sections["unicode"]:
        ignorable = ucd.predicate("default_ignorable")
        pack["unicode"] = dict(profile["unicode"]) | {"defaultIgnorables": sum(n for c, n in Counter(text).items() if ignorable[ord(c)])}
    if sections["segment"]:
        pack["segment"] = {f"{t}s": _segments(text, t, opts.get("maxSpans")) for t in ("grapheme", "word", "sentence")}
    if sections["security"]:
        pack["security"] = security_facts(text, opts.get("maxTokens"), opts.get("maxExamples", 5), table, bulk[1] if bulk else None)
    if sections["variants"]:
        index = variant_index(text, keep="word-like", examples=opts.get("maxExamples", 5), most=opts.get("topK"), table=table) if not bulk else {}
        wrapped = [v | {"key": _envelope(v["key"]), "forms": [f | {"form": _envelope(f["form"])} for f in v["forms"]]} for v in index.get("variants", ())]
        config = {"tokenizer": "uax29-word", "canonicalKey": "nfkcCaseFold", "wordFilter": "word-like", "maxExamplesPerVariant": opts.get("maxExamples", 5), "maxVariants": opts.get("topK"), "sortOrder": "codepoint"}
        made = provenance("Facts.VariantIndex", "spanloom:variants", REVISION, config)
        pack["variants"] = index | {"variants": wrapped, "provenance": made} if not bulk else _variants_json(text, opts, table, made, bulk[0])
    if sections["profile"]:
        pack["profile"] = profile | {"provenance": provenance("Profile.Surface", "spanloom:profile", REVISION, {})}
    if sections["fingerprint"]:
        config = {"tokenizer": "uax29-word", "canonicalKey": "nfkcCaseFold", "k": 3, "window": 4, "dedupe": "by-hash"}
        made = provenance("Fingerprint.Winnowing", "spanloom:winnowing", "Winnowing", config)
        if bulk:
            pack["fingerprint"] = _fingerprint_json(text, opts, made)
        else:
            found, cut = winnowing(text, 3, 4, "by-hash", opts.get("maxFingerprints"), opts.get("maxTokens"), key="nfkcCaseFold")
            pack["fingerprint"] = {"count": len(found), "fingerprints": found, "provenance": made} | ({"truncated": True} if cut else {})
    return pack


def line_break_facts(text: str, positions: int | None = None) -> dict:
    if positions is None:
        return dict(zip(("count", "mandatory"), linebreak.counts(text), strict=True))
    found = [x for x in linebreak.opportunities(text) if x[1] != "prohibited"]
    out = {"count": len(found), "mandatory": sum(k == "mandatory" for _, k in found)}
    if positions is not None:
        shown, cut = _capped([p for p, _ in found], positions)
        out |= {"positions": shown} | ({"positionsTruncated": True} if cut else {})
    return out


def bidi_facts(text: str, positions: int | None = None) -> tuple[dict, dict]:
    """Display and security facts of the resolved text."""
    if positions is None:
        runs, level, mixed, n = bidi.summary(text)
        return {"paragraphLevel": level, "runCount": runs}, {"hasBidiControls": n > 0, "bidiControlCount": n, "mixedDirection": mixed}
    r = bidi.resolve(text)
    controls = bidi.controls(text)
    display: dict = {"paragraphLevel": r.paragraph, "runCount": len(r.runs)}
    security: dict = {"hasBidiControls": bool(controls), "bidiControlCount": len(controls), "mixedDirection": bidi.mixed(r.levels)}
    if positions is not None:
        for block, name, items in (
            (display, "runs", [{"level": x, "startCU": a, "endCU": b} for x, a, b in r.runs]), (display, "visualOrder", r.order), (security, "bidiControlSpans", [_span(a, b) for a, b in controls]),
        ):
            shown, cut = _capped(items, positions)
            block[name] = shown
            if cut:
                block["bidiControlsTruncated" if name == "bidiControlSpans" else f"{name}Truncated"] = True
    return display, security


def duplicate_sentences(text: str, top: int = 50, positions: int = 200) -> dict:
    spans: dict[str, list] = {}
    for a, b, s in segment.spans(text, "sentence") if text else ():
        spans.setdefault(s, []).append(_span(a, b))
    many = sorted((s for s in spans if len(spans[s]) > 1), key=lambda s: (-len(spans[s]), s))
    return {"items": [{"text": s, "count": len(spans[s]), "spans": spans[s][:positions]} for s in many[:top]], "totalDuplicates": len(many)}


def pairs_in_windows(words: list[str], window: int) -> list[tuple[str, str]]:
    """The two words, lesser first, of each two places of each full window."""
    n = max(0, len(words) - window + 1)
    return [(a, b) if a <= b else (b, a) for i in range(window) for j in range(i + 1, window) for a, b in zip(words[i : i + n], words[j : j + n], strict=True)]


def word_tables(words: list[str], n: int | None = None, window: int | None = None) -> dict:
    """Counts of words, n-grams and pairs in windows, with their totals, from one pass over the tokens."""
    found: dict = {"words": Counter(words), "totalTokens": len(words)}
    if n:
        found["grams"] = Counter(zip(*[words[j:] for j in range(n)], strict=False))
        found["totalNgrams"] = max(0, len(words) - n + 1)
    if window:
        window = max(2, int(window))
        found["pairs"] = Counter(pairs_in_windows(words, window))
        found["totalWindows"] = max(0, len(words) - window + 1)
    return found


_controls = re.compile("[\x00-\x1f\x7f-\x9f]").findall


def invisible_chars(text: str) -> int:
    return 0 if text.isascii() else sum(map(text.count, "\u200b\u200c\u200d\u2060\ufeff"))


def control_chars(text: str) -> int:
    return len(_controls(text))


def fact_pack(text: str, options: Mapping | None = None, table: Skeletons | None = None) -> dict:
    """All facts of one text.

    Options: filter ("all" or "word-like"), topK (50), ngrams {n, minCount, topK}, cooccurrence
    {windowSize, minCount, maxPairs}, maxPositions (200), includeBoundaries, includeRepetition,
    includeDuplicateSentences, includeAllFrequencies, variants, profile, fingerprint,
    maxOutputBytes, mode ("full" or "lean"), fullModeInputLimit, allowUnsafeFullMode.
    """
    opts = {"filter": "all", "topK": 50, "maxPositions": 200, "mode": "full", "fullModeInputLimit": 8_000_000} | dict(options or {})
    size = segment.code_units(text)
    if opts["mode"] == "full" and size > opts["fullModeInputLimit"] and not opts.get("allowUnsafeFullMode"):
        raise ValueError(f"FULL_MODE_INPUT_TOO_LARGE: {size} code units")
    top, shown = opts["topK"], opts["maxPositions"] if opts.get("includeBoundaries") else None
    words = segment.word_like(text) if opts["filter"] == "word-like" else segment.pieces(text, "word")
    grams, pairs = opts.get("ngrams"), opts.get("cooccurrence")
    tables = word_tables(words, max(1, int(grams["n"])) if grams else None, pairs["windowSize"] if pairs else None)
    frequencies = [{"token": t, "count": c} for t, c in _commonest(tables["words"], None if opts.get("includeAllFrequencies") else top)]
    display, security = bidi_facts(text, shown)
    pack: dict = {
        "summary": {
            "codeUnits": size, "codePoints": len(text), "graphemes": _segments(text, "grapheme", shown), "sentences": _segments(text, "sentence", shown),
            "words": _segments(text, "word", shown) if shown else {"count": len(words)},
        },
        "frequencies": {"words": {"representation": "json", "items": frequencies[:top], "totalTokens": len(words)} | ({"allItems": frequencies} if opts.get("includeAllFrequencies") else {})},
        "display": {"lineBreaks": line_break_facts(text, shown), "bidi": display},
        "security": security,
        "safety": {
            "unpairedSurrogates": len(segment.lone_surrogates(text)), "controlChars": control_chars(text), "invisibleChars": invisible_chars(text),
        },
        "provenance": provenance("Pack.AnalyzeText", "spanloom:pack", REVISION, opts),
    }
    repetition: dict = {}
    if grams:
        items = lambda most, least: _commonest(tables["grams"], most, least)
        least = grams.get("minCount", 1)
        pack["ngrams"] = {"words": {"representation": "json", "items": [{"tokens": list(g), "count": c} for g, c in items(grams.get("topK", top), least)], "totalNgrams": tables["totalNgrams"]}}
        if opts.get("includeRepetition"):
            twice = max(2, least)
            repetition["wordNgrams"] = {"items": [{"tokens": list(g), "count": c} for g, c in items(top, twice)], "totalRepeated": sum(c >= twice for c in tables["grams"].values())}
    if pairs:
        items = _commonest(tables["pairs"], pairs.get("maxPairs", top), pairs.get("minCount", 1))
        pack["cooccurrence"] = {"words": {"representation": "json", "items": [{"tokens": list(g), "count": c} for g, c in items], "totalWindows": tables["totalWindows"]}}
    if opts.get("includeDuplicateSentences"):
        repetition["duplicateSentences"] = duplicate_sentences(text, top, opts["maxPositions"])
    if repetition:
        pack["repetition"] = repetition
    if opts.get("variants"):
        v = opts["variants"]
        pack["variants"] = variant_index(text, v.get("tokenizer", "uax29-word"), v.get("canonicalKey", "raw"), v.get("wordFilter", "all"), v.get("maxExamplesPerVariant", 5), v.get("maxVariants"), table)
    if opts.get("profile") is not None:
        p = opts["profile"]
        pack["profile"] = surface_profile(text, p.get("ngrams", {}).get("sizes", ()), p.get("ngrams", {}).get("topK", 50), p.get("lengthBins", ()), p.get("wordFilter", "word-like"))
    if opts.get("fingerprint"):
        f = opts["fingerprint"]
        rows, cut = winnowing(text, f["k"], f["window"], f.get("dedupe", "by-hash"), f.get("maxFingerprints"), tokenizer=f.get("tokenizer", "uax29-word"), key=f.get("canonicalKey", "raw"), table=table)
        pack["fingerprint"] = {"k": f["k"], "window": f["window"], "fingerprintCount": len(rows), "fingerprints": rows} | ({"truncated": True} if cut else {})
    return pack | {"size": size_info(pack | {"size": {"estimatedBytes": 0}}, opts.get("maxOutputBytes", 0))}


def size_info(pack: dict, most: int = 0) -> dict:
    """Length of the canonical text in code units, and whether it exceeds ``most`` where that is given."""
    size = segment.code_units(kernels.canonical_of_plain(pack))
    return {"estimatedBytes": size} | ({"maxOutputBytes": most, "exceedsMax": size > most} if most > 0 else {})
