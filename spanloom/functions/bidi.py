"""Bidirectional resolution (UAX #9) of a text as one paragraph: levels, runs, visual order."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import code_units, is_latin
from .ucd import lookup, predicate

MAX_DEPTH = 125
REMOVED = 255
_ISOLATES = ("LRI", "RLI", "FSI")
_EMBEDDINGS = {"LRE": (0, ""), "RLE": (1, ""), "LRO": (0, "L"), "RLO": (1, "R")}
_DROPPED = frozenset((*_EMBEDDINGS, "PDF", "BN"))
_NEUTRAL = frozenset(("B", "S", "WS", "ON", "LRI", "RLI", "FSI", "PDI"))
_LEVEL = frozenset(("L", "EN", "ES", "ET", "CS", "NSM", "B", "S", "WS", "ON"))
_SWAPS = (("LEFT", "RIGHT"), ("GYON", "GYAS"), ("OGHAM FEATHER", "OGHAM REVERSED FEATHER"))


@cache
def bracket(char: str) -> tuple[str, str] | None:
    """("open" or "close", canonical closing bracket) of a paired bracket: partners differ by one word of their names."""
    kind = lookup("General_Category")[ord(char)]
    if kind not in ("Ps", "Pe") or lookup("Bidi_Class")[ord(char)] != "ON":
        return None
    char = unicodedata.normalize("NFC", char)
    name = unicodedata.name(char, "")
    for here, there in _SWAPS:
        if kind == "Pe":
            here, there = there, here
        if here in name:
            try:
                partner = unicodedata.normalize("NFC", unicodedata.lookup(name.replace(here, there, 1)))
            except KeyError:
                continue
            if partner != char and lookup("General_Category")[ord(partner)] == ("Pe" if kind == "Ps" else "Ps"):
                return ("open", partner) if kind == "Ps" else ("close", char)
    return None


@dataclass
class Resolution:
    paragraph: int
    levels: list[int]  # REMOVED for controls that have no level
    runs: list[tuple[int, int, int]]  # level, start, end in code units
    order: list[int]  # characters from left to right


def _matches(kinds: list[str]) -> dict[int, int]:
    """Isolate initiators and the PDI that ends each."""
    found, open_ = {}, []
    for i, k in enumerate(kinds):
        if k in _ISOLATES:
            open_.append(i)
        elif k == "PDI" and open_:
            found[open_.pop()] = i
    return found


def _first_strong(kinds: list[str], ends: dict[int, int], i: int, stop: int) -> int:
    """Level by the first strong character outside isolates (P2, P3)."""
    while i < stop:
        if kinds[i] in ("L", "R", "AL"):
            return int(kinds[i] != "L")
        i = ends.get(i, stop) if kinds[i] in _ISOLATES else i + 1
    return 0


def _explicit(kinds: list[str], ends: dict[int, int], paragraph: int) -> tuple[list[int], list[str]]:
    """X1 to X9: levels and types, REMOVED where nothing is left."""
    n = len(kinds)
    levels, types = [paragraph] * n, list(kinds)
    stack = [(paragraph, "", False)]
    lost_isolates = lost_embeddings = isolates = 0
    for i, k in enumerate(kinds):
        level, forced, _ = stack[-1]
        if k in _EMBEDDINGS:
            levels[i] = REMOVED
            odd, override = _EMBEDDINGS[k]
            deeper = level + 1 + (level % 2 == odd)
            if deeper <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                stack.append((deeper, override, False))
            elif not lost_isolates:
                lost_embeddings += 1
        elif k in _ISOLATES:
            levels[i], types[i] = level, forced or k
            odd = _first_strong(kinds, ends, i + 1, ends.get(i, n)) if k == "FSI" else int(k == "RLI")
            deeper = level + 1 + (level % 2 == odd)
            if deeper <= MAX_DEPTH and not lost_isolates and not lost_embeddings:
                isolates += 1
                stack.append((deeper, "", True))
            else:
                lost_isolates += 1
        elif k == "PDI":
            if lost_isolates:
                lost_isolates -= 1
            elif isolates:
                lost_embeddings = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                isolates -= 1
            levels[i], types[i] = stack[-1][0], stack[-1][1] or k
        elif k == "PDF":
            levels[i] = REMOVED
            if lost_isolates:
                pass
            elif lost_embeddings:
                lost_embeddings -= 1
            elif len(stack) > 1 and not stack[-1][2]:
                stack.pop()
        elif k == "B":
            levels[i] = paragraph
        elif k == "BN":
            levels[i] = REMOVED
        else:
            levels[i], types[i] = level, forced or k
    return levels, types


def _sequences(kinds: list[str], levels: list[int], ends: dict[int, int]) -> list[list[int]]:
    """Isolating run sequences (X10)."""
    runs: list[list[int]] = []
    for i, level in enumerate(levels):
        if level == REMOVED:
            continue
        if runs and levels[runs[-1][-1]] == level:
            runs[-1].append(i)
        else:
            runs.append([i])
    at = {r[0]: r for r in runs}
    paired = set(ends.values())
    out = []
    for r in runs:
        if kinds[r[0]] == "PDI" and r[0] in paired:
            continue
        whole = list(r)
        while kinds[whole[-1]] in _ISOLATES and whole[-1] in ends and ends[whole[-1]] in at:
            whole += at[ends[whole[-1]]]
        out.append(whole)
    return out


def _weak(t: list[str], sos: str) -> None:
    """W1 to W7."""
    n = len(t)
    before, strong = sos, sos
    for i in range(n):
        if t[i] == "NSM":
            t[i] = "ON" if before in (*_ISOLATES, "PDI") else before
        before = t[i]
        if t[i] in ("R", "L", "AL"):
            strong = t[i]
        elif t[i] == "EN" and strong == "AL":
            t[i] = "AN"
    t[:] = ["R" if x == "AL" else x for x in t]
    for i in range(1, n - 1):
        a, b = t[i - 1], t[i + 1]
        if t[i] == "ES" and a == b == "EN" or t[i] == "CS" and a == b and a in ("EN", "AN"):
            t[i] = a
    i = 0
    while i < n:
        j = i
        while j < n and t[j] == "ET":
            j += 1
        if j > i and (i and t[i - 1] == "EN" or j < n and t[j] == "EN"):
            t[i:j] = ["EN"] * (j - i)
        i = max(j, i + 1)
    strong = sos
    for i in range(n):
        if t[i] in ("ES", "ET", "CS"):
            t[i] = "ON"
        elif t[i] in ("R", "L"):
            strong = t[i]
        elif t[i] == "EN" and strong == "L":
            t[i] = "L"


def _side(kind: str) -> str:
    return "R" if kind in ("R", "EN", "AN") else "L" if kind == "L" else ""


def _brackets(t: list[str], chars: list[str], was_mark: list[bool], sos: str, own: str) -> None:
    """N0."""
    open_: list[tuple[str, int]] = []
    pairs = []
    for i, c in enumerate(chars):
        b = bracket(c) if t[i] == "ON" else None
        if b is None:
            continue
        if b[0] == "open":
            if len(open_) == 63:
                break
            open_.append((b[1], i))
        else:
            for j in range(len(open_) - 1, -1, -1):
                if open_[j][0] == b[1]:
                    pairs.append((open_[j][1], i))
                    del open_[j:]
                    break
    for a, b in sorted(pairs):
        inside = {_side(x) for x in t[a + 1 : b]} - {""}
        if own in inside:
            found = own
        elif inside:
            context = next((s for x in reversed(t[:a]) if (s := _side(x))), sos)
            found = context if context != own else own
        else:
            continue
        for i in (a, b):
            t[i] = found
            j = i + 1
            while j < len(t) and was_mark[j]:
                t[j] = found
                j += 1


def _neutral(t: list[str], sos: str, eos: str, own: str) -> None:
    """N1 and N2."""
    i, n = 0, len(t)
    while i < n:
        j = i
        while j < n and t[j] in _NEUTRAL:
            j += 1
        if j > i:
            a = _side(t[i - 1]) if i else sos
            b = _side(t[j]) if j < n else eos
            t[i:j] = [a if a == b else own] * (j - i)
        i = j + 1


def resolve(text: str, direction: str = "auto", use_brackets: bool = True) -> Resolution:
    """``direction``: auto (first strong character), ltr or rtl."""
    if direction != "rtl" and is_plain(text):
        n = len(text)
        return Resolution(0, [0] * n, [(0, 0, code_units(text))] if text else [], list(range(n)))
    table = lookup("Bidi_Class")
    kinds = [table[ord(c)] for c in text]
    ends = _matches(kinds)
    paragraph = {"ltr": 0, "rtl": 1}.get(direction, _first_strong(kinds, ends, 0, len(kinds)))
    levels, types = _explicit(kinds, ends, paragraph)
    base = list(levels)
    kept = [i for i, x in enumerate(base) if x != REMOVED]
    place = {i: k for k, i in enumerate(kept)}
    for seq in _sequences(kinds, base, ends):
        level = base[seq[0]]
        before = place[seq[0]] - 1
        low = base[kept[before]] if before >= 0 else paragraph
        after = place[seq[-1]] + 1
        open_end = kinds[seq[-1]] in _ISOLATES and seq[-1] not in ends
        high = paragraph if open_end or after == len(kept) else base[kept[after]]
        sos, eos, own = ("LR"[max(level, x) % 2] for x in (low, high, level))
        t = [types[i] for i in seq]
        was_mark = [x == "NSM" for x in t]
        _weak(t, sos)
        if use_brackets:
            _brackets(t, [text[i] for i in seq], was_mark, sos, own)
        _neutral(t, sos, eos, own)
        for i, x in zip(seq, t, strict=True):
            levels[i] = level + ((x == "R") + 2 * (x in ("AN", "EN")) if level % 2 == 0 else int(x != "R"))
    reset = True  # L1: from the end backwards
    for i in range(len(kinds) - 1, -1, -1):
        if kinds[i] in ("B", "S"):
            reset = True
        elif kinds[i] not in ("WS", "PDI", *_ISOLATES) and base[i] != REMOVED:
            reset = False
        if reset and base[i] != REMOVED:
            levels[i] = paragraph
    return Resolution(paragraph, levels, _runs(text, levels), visual_order(levels))


def is_plain(text: str) -> bool:
    """Only characters that all have level 0 in a paragraph of level 0, as which such a text is resolved."""
    if is_latin(text):
        return True
    table = lookup("Bidi_Class")
    return all(table[ord(c)] in _LEVEL for c in set(text))


def summary(text: str) -> tuple[int, int, bool, int]:
    """Number of runs, paragraph level, whether both directions occur, number of controls."""
    if is_plain(text):
        return int(text != ""), 0, False, len(controls(text))
    r = resolve(text)
    return len(r.runs), r.paragraph, mixed(r.levels), len(controls(text))


def _runs(text: str, levels: list[int]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    at = 0
    for c, level in zip(text, levels, strict=True):
        end = at + 1 + (ord(c) > 0xFFFF)
        if level != REMOVED:
            if out and out[-1][0] == level and out[-1][2] == at:
                out[-1][2] = end
            else:
                out.append([level, at, end])
        at = end
    return [tuple(r) for r in out]


def visual_order(levels: list[int]) -> list[int]:
    """L2: characters with a level, left to right."""
    order = [i for i, x in enumerate(levels) if x != REMOVED]
    odd = [levels[i] for i in order if levels[i] % 2]
    for level in range(max((levels[i] for i in order), default=0), min(odd, default=1) - 1, -1):
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and levels[order[j]] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = j + 1
    return order


def controls(text: str) -> list[tuple[int, int]]:
    """Spans of the bidi controls."""
    if is_latin(text):
        return []
    table, at, out = predicate("bidi_control"), 0, []
    for c in text:
        end = at + 1 + (ord(c) > 0xFFFF)
        if table[ord(c)]:
            out.append((at, end))
        at = end
    return out


def mixed(levels: list[int]) -> bool:
    """Both directions occur."""
    return len({x % 2 for x in levels if x != REMOVED}) > 1


FACTS = "struct<paragraph_level:int,runs:array<struct<level:int,start:int,end:int>>,visual_order:array<int>,mixed_direction:boolean,control_spans:array<struct<start:int,end:int>>>"


def facts(text: Column, direction: str = "auto", use_brackets: bool = True) -> Column:
    """Paragraph level, runs, visual order, whether both directions occur, and the controls' spans; null for null."""

    def one(x: str) -> dict:
        r = resolve(x, direction, use_brackets)
        return {
            "paragraph_level": r.paragraph, "runs": [dict(zip(("level", "start", "end"), t, strict=True)) for t in r.runs], "visual_order": r.order,
            "mixed_direction": mixed(r.levels), "control_spans": [{"start": a, "end": b} for a, b in controls(x)],
        }

    def run(s: pd.Series) -> pd.DataFrame:
        names = ["paragraph_level", "runs", "visual_order", "mixed_direction", "control_spans"]
        return pd.DataFrame([dict.fromkeys(names) if x is None else one(x) for x in s], columns=names)

    return F.pandas_udf(run, FACTS)(text)
