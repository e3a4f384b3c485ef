"""Functions without a built-in form, as Arrow-batched UDFs over columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FNV_SEED, _FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
SHINGLE_BASE = np.uint64(0x9E3779B185EBCA87)


def fnv1a64(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each byte string: one step per byte place over all strings at once."""
    size = np.array([len(v) for v in values], np.int64)
    out = np.full(len(values), _FNV_SEED, np.uint64)
    if not len(values):
        return out
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    live = len(order)
    falling = size[order]
    with np.errstate(over="ignore"):
        for j in range(int(size.max(initial=0))):
            while live and falling[live - 1] <= j:
                live -= 1
            at = order[:live]
            out[at] = (out[at] ^ data[start[at] + j]) * _FNV_PRIME
    return out


def _udf(kind: str, f: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    return F.pandas_udf(f, kind)


def fnv1a64_utf8(text: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fnv1a64([(x or "").encode() for x in s]).view(np.int64)).where(s.notna().to_numpy())

    return _udf("long", run)(text)


def fnv1a64_utf16(text: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(fnv1a64([(x or "").encode("utf-16-le") for x in s]).view(np.int64)).where(s.notna().to_numpy())

    return _udf("long", run)(text)


def xxh64_utf8(text: Column, seed: int = 0) -> Column:
    """XXH64 of the UTF-8 bytes (Spark's own xxhash64 has a fixed seed of 42)."""

    def run(s: pd.Series) -> pd.Series:
        import xxhash

        return pd.Series([None if x is None else int(np.uint64(xxhash.xxh64_intdigest(x.encode(), seed)).astype(np.int64)) for x in s], dtype="Int64")

    return _udf("long", run)(text)


def hash64(text: Column, algo: str = "xxh64-utf8", seed: int = 0) -> Column:
    """fnv1a64-utf16le, fnv1a64-utf8 or xxh64-utf8 of a text; only the last has a seed."""
    if seed and algo != "xxh64-utf8":
        raise ValueError("HASH64_SEED_UNSUPPORTED")
    known = {"fnv1a64-utf16le": fnv1a64_utf16, "fnv1a64-utf8": fnv1a64_utf8, "xxh64-utf8": lambda t: xxh64_utf8(t, seed)}
    if algo not in known:
        raise ValueError(f"HASH64_ALGO_UNSUPPORTED: {algo}")
    return known[algo](text)


def hash64_bytes(raw: Column, algo: str = "xxh64", seed: int = 0) -> Column:
    """fnv1a64 or xxh64 of bytes."""
    if algo not in ("xxh64", "fnv1a64") or seed and algo == "fnv1a64":
        raise ValueError(f"HASH64_ALGO_UNSUPPORTED: {algo} with seed {seed}")

    def run(s: pd.Series) -> pd.Series:
        import xxhash

        known = s.notna().to_numpy()
        if algo == "fnv1a64":
            return pd.Series(fnv1a64([bytes(x) if x is not None else b"" for x in s]).view(np.int64)).where(known)
        return pd.Series([None if x is None else int(np.uint64(xxhash.xxh64_intdigest(x, seed)).astype(np.int64)) for x in s], dtype="Int64")

    return _udf("long", run)(raw)


def hash64_span(text: Column, start: Column, end: Column, algo: str = "xxh64-utf8") -> Column:
    """``hash64`` of the part from ``start`` to ``end`` in UTF-16 code units."""
    from .protocol import slice_by_span

    return hash64(slice_by_span(text, start, end), algo)


def hash128_hex(text: Column, left: str = "fnv1a64-utf16le", right: str = "xxh64-utf8") -> Column:
    """Two 64-bit hashes as 32 hexadecimal digits."""
    half = lambda algo: F.lpad(F.lower(F.hex(hash64(text, algo))), 16, "0")
    return F.concat(half(left), half(right))


def parse_u64_hex(digits: Column) -> Column:
    """16 lower-case hexadecimal digits as the signed long of the same bits; anything else is null."""
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("long")
    return F.when(F.rlike(digits, F.lit("^[0-9a-f]{16}$")), F.shiftleft(high, 32).bitwiseOR(low))


def parse_hash128_hex(digits: Column) -> Column:
    """struct<left, right> of 32 digits; null where they are not that."""
    ok = F.rlike(digits, F.lit("^[0-9a-f]{32}$"))
    return F.when(ok, F.struct(parse_u64_hex(F.substring(digits, 1, 16)).alias("left"), parse_u64_hex(F.substring(digits, 17, 16)).alias("right")))


def normalize(text: Column, form: str) -> Column:
    """NFC, NFD, NFKC or NFKD; texts of ASCII only are returned as they are."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"NORMALIZATION_FORM_UNSUPPORTED: {form}")

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return _udf("string", run)(text)


def normal_forms(text: Column) -> Column:
    """struct<is_nfc, is_nfd, is_nfkc, is_nfkd>, in one pass; nulls for null."""
    forms = ("NFC", "NFD", "NFKC", "NFKD")

    def run(s: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 4 if x is None else (True,) * 4 if x.isascii() else tuple(unicodedata.is_normalized(f, x) for f in forms) for x in s]
        return pd.DataFrame(rows, columns=[f"is_{f.lower()}" for f in forms], dtype="object")

    return _udf("struct<" + ",".join(f"is_{f.lower()}:boolean" for f in forms) + ">", run)(text)


def explain_normalization(text: Column, form: str) -> Column:
    """struct<output, decomposed, reordered, composed>: code points after each stage."""

    def one(x: str) -> tuple:
        full = "".join(unicodedata.normalize("NFKD" if "K" in form else "NFD", c) for c in x)
        ordered = unicodedata.normalize("NFD", full)
        out = unicodedata.normalize(form, x)
        return out, *([ord(c) for c in stage] for stage in (full, ordered, out))

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None,) * 4 if x is None else one(x) for x in s], columns=["output", "decomposed", "reordered", "composed"])

    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"NORMALIZATION_FORM_UNSUPPORTED: {form}")
    return _udf("struct<output:string,decomposed:array<int>,reordered:array<int>,composed:array<int>>", run)(text)


def case_fold(text: Column) -> Column:
    return _udf("string", lambda s: s.map(lambda x: None if x is None else x.casefold()))(text)


def nfkc_case_fold(text: Column) -> Column:
    """Case folding of the NFKC form, not normalized again."""
    return case_fold(normalize(text, "NFKC"))


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters."""

    def run(s: pd.Series) -> pd.Series:
        import regex

        cut = regex.compile(r"\X").findall
        return s.map(lambda x: None if x is None else cut(x))

    return _udf("array<string>", run)(text)


def words_any(text: Column) -> Column:
    """Default word segments of any text; they tile it."""

    def run(s: pd.Series) -> pd.Series:
        import regex

        cut = regex.compile(r"(?w)(?s:.)(?:(?!\b)(?s:.))*")
        return s.map(lambda x: None if x is None else cut.findall(x))

    return _udf("array<string>", run)(text)


def keep_word_like(segments: Column) -> Column:
    """The segments with a letter, digit, Katakana or connector in the sense of word breaking."""

    def run(s: pd.Series) -> pd.Series:
        import regex

        found = regex.compile("[" + "".join(rf"\p{{Word_Break={c}}}" for c in ("ALetter", "Hebrew_Letter", "Numeric", "Katakana", "ExtendNumLet")) + "]").search
        return s.map(lambda x: None if x is None else [w for w in x if found(w)])

    return _udf("array<string>", run)(segments)


#: One letter for each sentence-break class.
_SENTENCE_CLASSES = {
    "ATerm": "A", "STerm": "T", "Close": "C", "Sp": "S", "Sep": "P", "CR": "R", "LF": "N", "Upper": "U", "Lower": "L", "OLetter": "O", "Numeric": "D", "SContinue": "X", "Extend": "E", "Format": "F",
}


class _Classes(dict):
    """Code point to class letter, looked up once per code point."""

    def __init__(self) -> None:
        import regex

        self.tests = [(letter, regex.compile(rf"\p{{Sentence_Break={name}}}")) for name, letter in _SENTENCE_CLASSES.items()]

    def __missing__(self, cp: int) -> str:
        self[cp] = found = next((letter for letter, test in self.tests if test.match(chr(cp))), ".")
        return found


_classes: _Classes | None = None


def split_sentences(text: str) -> list[str]:
    """Default sentence segments (UAX #29); they tile the text."""
    global _classes
    if _classes is None:
        _classes = _Classes()
    kinds = text.translate(_classes)
    cuts = [0]
    for m in re.finditer(r"RN|[PRN]|([TA])[EF]*((?:C[EF]*)*(?:S[EF]*)*)(RN|[PRN])?", kinds):
        end, term = m.end(), m[1]
        if term and not m[3]:
            after = kinds[end : end + 1]
            near = not m[2]
            before = kinds[: m.start()].rstrip("EF")[-1:] if term == "A" and near and after == "U" else ""
            if after in ("X", "T", "A"):
                continue
            if term == "A" and (near and after == "D" or before in ("U", "L") or re.compile("[^OULPRNTA]*L").match(kinds, end)):
                continue
        cuts.append(end)
    if cuts[-1] != len(text):
        cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def sentences(text: Column) -> Column:
    return _udf("array<string>", lambda s: s.map(lambda x: None if x is None else split_sentences(x)))(text)


def char_property(char: Column, name: str) -> Column:
    """bidi_class, east_asian_width, combining_class, mirrored, decomposition or name of a character."""
    looked_up = {
        "bidi_class": unicodedata.bidirectional,
        "east_asian_width": unicodedata.east_asian_width,
        "combining_class": lambda c: str(unicodedata.combining(c)),
        "mirrored": lambda c: str(bool(unicodedata.mirrored(c))).lower(),
        "decomposition": unicodedata.decomposition,
        "name": lambda c: unicodedata.name(c, ""),
    }[name]
    return _udf("string", lambda s: s.map(lambda x: None if not x else looked_up(x[0])))(char)


def ends_cu(segments: Column) -> Column:
    """Running end of each segment in UTF-16 code units."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.cumsum([len(w) if w.isascii() else len(w.encode("utf-16-le")) // 2 for w in x]).astype(np.int32).tolist())

    return _udf("array<int>", run)(segments)


def punycode_encode(label: Column) -> Column:
    """RFC 3492 encoding of a label, without a prefix."""
    return _udf("string", lambda s: s.map(lambda x: None if x is None else x.encode("punycode").decode("ascii")))(label)


def punycode_decode(label: Column) -> Column:
    """Inverse of ``punycode_encode``; null where the input is not valid."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else x.encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return None

    return _udf("string", lambda s: s.map(one))(label)


def jcs_number(x: float) -> str:
    """A number as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("JCS_NON_FINITE")
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = f"{x!r}".partition("e")
    digits = mantissa.replace(".", "")
    point = (mantissa.index(".") if "." in mantissa else len(mantissa)) + int(exponent or 0)
    stripped = digits.lstrip("0")
    point -= len(digits) - len(stripped)
    digits = stripped.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        body = digits + "0" * (point - n)
    elif 0 < point <= 21:
        body = digits[:point] + "." + digits[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


_NONCHARACTER = re.compile("[\ufdd0-\ufdef" + "".join(f"{chr(p * 0x10000 + 0xFFFE)}{chr(p * 0x10000 + 0xFFFF)}" for p in range(17)) + "]")


_SURROGATE = re.compile("[\ud800-\udfff]")
#: What a JSON string escapes.
_ESCAPED = re.compile('[\x00-\x1f"\\\\\ud800-\udfff]')


def _ijson_string(s: str) -> str:
    try:
        s.encode("latin-1")  # a fast way to see that there is nothing to look for
        return s
    except UnicodeEncodeError:
        pass
    if _SURROGATE.search(s):
        raise ValueError("IJSON_LONE_SURROGATE")
    if _NONCHARACTER.search(s):
        raise ValueError("IJSON_NONCHARACTER")
    return s


def quoted(s: str) -> str:
    if not _ESCAPED.search(s):
        return f'"{s}"'
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " or "\ud800" <= c <= "\udfff" else c) for c in s) + '"'


def _jcs_string(s: str) -> str:
    return quoted(_ijson_string(s))


def assert_ijson(value: object) -> None:
    """An error unless the value is I-JSON: plain types, finite numbers, strings without lone surrogates and noncharacters, no cycles."""
    open_: set[int] = set()

    def visit(v: object) -> None:
        if v is None or isinstance(v, bool):
            return
        if isinstance(v, str):
            _ijson_string(v)
        elif isinstance(v, int | float):
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError("JCS_NON_FINITE")
        elif isinstance(v, list | tuple | dict):
            if id(v) in open_:
                raise ValueError("IJSON_CYCLE")
            open_.add(id(v))
            if isinstance(v, dict):
                for k in v:
                    if not isinstance(k, str):
                        raise TypeError("IJSON_TYPE: key")
                    _ijson_string(k)
            for x in v.values() if isinstance(v, dict) else v:
                visit(x)
            open_.discard(id(v))
        else:
            raise TypeError(f"IJSON_TYPE: {type(v).__name__}")

    visit(value)


def canonical_json(value: object) -> str:
    """Lenient canonical JSON of a model: functions are left out, numbers that are not finite are null, other integers than doubles hold are strings, sets sorted arrays, bytes arrays."""
    if value is None or isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return "null"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > 2**53:
        return f'"{value}"'
    if isinstance(value, bytes | bytearray | list | tuple):
        return "[" + ",".join("null" if callable(v) else canonical_json(v) for v in value) + "]"
    if isinstance(value, set | frozenset):
        return "[" + ",".join(sorted(map(canonical_json, value))) + "]"
    if isinstance(value, dict):
        keys = sorted((k for k in value if not callable(value[k])), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{quoted(k)}:{canonical_json(value[k])}" for k in keys) + "}"
    return jcs(value)


def jcs(value: object) -> str:
    """RFC 8785 canonical JSON: keys by UTF-16 code units, ECMAScript numbers, no white space."""
    if value is None:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, str):
        return _jcs_string(value)
    if isinstance(value, int | float):
        return jcs_number(float(value)) if isinstance(value, float) or abs(value) > 2**53 else str(value)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(jcs, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_jcs_string(k)}:{jcs(value[k])}" for k in keys) + "}"
    raise TypeError(f"IJSON_TYPE: {type(value).__name__}")


def jcs_plain(value: object) -> str:
    """``jcs`` of lists, strings, whole numbers under 2**53, booleans and nulls, and of dictionaries with ASCII keys."""
    import json

    text = json.dumps(value, ensure_ascii=False, check_circular=False, separators=(",", ":"), sort_keys=True)
    return _ijson_string(text)


def canonical_of_plain(value: object) -> str:
    """``canonical_json`` of such values."""
    import json

    text = json.dumps(value, ensure_ascii=False, check_circular=False, separators=(",", ":"), sort_keys=True)
    return text if text.isascii() or not _SURROGATE.search(text) else canonical_json(value)


def jcs_of_json(text: Column) -> Column:
    """Canonical form of JSON text; null where it is not I-JSON."""

    def one(x: str | None) -> str | None:
        import json

        try:
            return None if x is None else jcs(json.loads(x))
        except (ValueError, TypeError):
            return None

    return _udf("string", lambda s: s.map(one))(text)
