"""Segmentation of one text in Python: spans in UTF-16 code units, also of texts with lone surrogates.

A text with lone surrogates is a Python string that holds them; ``from_utf16`` makes one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache
from itertools import accumulate

import regex

from . import kernels, text as columns
from .ucd import predicate

Span = tuple[int, int]


_not_latin = re.compile(columns.NOT_LATIN).search
_LATIN_WORDS = re.compile(columns.WORD)
#: The word-like ones of these segments.
LATIN_WORD_LIKE = re.compile(columns.WORD.split("|\\r")[0])
_like = re.compile(columns.WORD_LIKE).search


def is_latin(text: str) -> bool:
    """Of the repertoire whose words, lines and directions follow from simple patterns."""
    return _not_latin(text) is None


def from_utf16(raw: bytes) -> str:
    """UTF-16LE bytes as text; lone surrogates stay as they are, an odd length is an error."""
    if len(raw) % 2:
        raise ValueError("PROTOCOL_INVALID_ENVELOPE: UTF-16LE byte length must be even")
    return raw.decode("utf-16-le", "surrogatepass")


def to_utf16(text: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass")


_beyond = re.compile("[\U00010000-\U0010ffff]").search


def _one_unit_each(text: str) -> bool:
    return text.isascii() or not _beyond(text)


def code_units(text: str) -> int:
    return len(text) if _one_unit_each(text) else len(to_utf16(text)) // 2


_surrogate = re.compile("[\ud800-\udfff]").search


def lone_surrogates(text: str) -> list[tuple[int, int, str]]:
    """(start, code unit, high or low) of each."""
    if text.isascii() or not _surrogate(text):
        return []
    at, out = 0, []
    for c in text:
        cp = ord(c)
        if 0xD800 <= cp <= 0xDFFF:
            out.append((at, cp, "high" if cp < 0xDC00 else "low"))
        at += 1 + (cp > 0xFFFF)
    return out


def well_formed(text: str) -> str:
    """Each lone surrogate as U+FFFD."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", "�", text)


@cache
def _cutter(tokenizer: str) -> Callable[[str], list[str]]:
    if tokenizer == "grapheme":
        return regex.compile(r"\X").findall
    if tokenizer == "word":
        return regex.compile(r"(?w)(?s:.)(?:(?!\b)(?s:.))*").findall
    if tokenizer == "sentence":
        return kernels.split_sentences
    return list


def pieces(text: str, tokenizer: str) -> list[str]:
    """Segments that tile the text; any unknown tokenizer cuts code points."""
    if tokenizer == "word" and is_latin(text):
        return _LATIN_WORDS.findall(text)
    if tokenizer == "grapheme" and is_latin(text):
        return list(text) if "\r" not in text else re.findall("\r\n|[\\s\\S]", text)
    return _cutter(tokenizer)(text)


def words(text: str, repertoire: str = "auto") -> list[str]:
    """Word segments; ``repertoire`` "latin" takes the text for one of that repertoire, "any" does not."""
    return pieces(text, "word") if repertoire == "auto" else _LATIN_WORDS.findall(text) if repertoire == "latin" else _cutter("word")(text)


def spans(text: str, tokenizer: str, custom: Callable[[str], Iterable[Span]] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, raw) of each segment, or of the spans that ``custom`` names."""
    if custom is not None:
        raw = to_utf16(text)
        return [(a, b, raw[2 * a : 2 * b].decode("utf-16-le", "surrogatepass")) for a, b in custom(text)]
    found = pieces(text, tokenizer)
    ends = list(accumulate(map(len if _one_unit_each(text) else code_units, found)))
    return list(zip([0, *ends], ends, found, strict=False))


def word_like(text: str) -> list[str]:
    """The word segments that are words or numbers."""
    return LATIN_WORD_LIKE.findall(text) if is_latin(text) else [w for w in pieces(text, "word") if is_word_like(w)]


def word_like_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, raw) of ``word_like``."""
    if is_latin(text):
        return [(*m.span(), m[0]) for m in LATIN_WORD_LIKE.finditer(text)]
    return [x for x in spans(text, "word") if is_word_like(x[2])]


def is_word_like(token: str) -> bool:
    if token.isascii() or _like(token):
        return _like(token) is not None
    table = predicate("word_like")
    return any(table[ord(c)] for c in token)
