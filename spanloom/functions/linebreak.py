"""Line break opportunities (UAX #14, all default rules)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import is_latin
from .ucd import lookup, predicate

HARD = frozenset(("BK", "CR", "LF", "NL"))
_NO_BASE = HARD | {"SP", "ZW"}
_AFTER_INITIAL = _NO_BASE | {"OP", "QU", "GL"}
_BEFORE_FINAL = HARD | {"SP", "GL", "WJ", "CL", "QU", "CP", "EX", "IS", "SY", "ZW"}
_WORD_START = _NO_BASE | {"CB", "GL"}
_LETTER = frozenset(("AL", "HL"))
_IDEOGRAPH = frozenset(("ID", "EB", "EM"))
_HANGUL = frozenset(("JL", "JV", "JT", "H2", "H3"))
_DOTTED = "◌"


class _Unit:
    """A character with the marks that belong to it."""

    __slots__ = ("kind", "first", "end", "char", "wide", "joined")

    def __init__(self, kind: str, first: int, char: str):
        self.kind, self.first, self.end, self.char = kind, first, first + 1, char
        self.wide = predicate("east_asian_wide")[ord(char)]
        self.joined = False  # ends in a zero width joiner

    def aksara(self) -> bool:
        return self.kind in ("AK", "AS") or self.char == _DOTTED

    def initial(self) -> bool:
        return self.kind == "QU" and predicate("initial_punctuation")[ord(self.char)]

    def final(self) -> bool:
        return self.kind == "QU" and predicate("final_punctuation")[ord(self.char)]


def _kind(char: str) -> str:
    kind = lookup("Line_Break")[ord(char)]
    if kind in ("AI", "SG", "XX"):
        return "AL"
    if kind == "CJ":
        return "NS"
    if kind == "SA":
        return "CM" if predicate("mark")[ord(char)] else "AL"
    return kind


def _units(text: str) -> list[_Unit]:
    """LB1, LB9 and LB10."""
    out: list[_Unit] = []
    for i, c in enumerate(text):
        kind = _kind(c)
        if kind in ("CM", "ZWJ"):
            if out and out[-1].kind not in _NO_BASE:
                out[-1].end, out[-1].joined = i + 1, kind == "ZWJ"
                continue
            out.append(_Unit("AL", i, c))
            out[-1].joined = kind == "ZWJ"
            continue
        out.append(_Unit(kind, i, c))
    return out


class _Rules:
    """Looks at the units around one boundary, rule by rule in their order."""

    def __init__(self, units: list[_Unit]):
        self.u = units
        n = len(units)
        self.solid = [0] * n  # last unit up to here that is no space, -1 for none
        self.number = [False] * n  # here ends NU (SY | IS)*
        self.flags = [0] * n  # regional indicators in a row up to here
        last = -1
        for i, x in enumerate(units):
            last = i if x.kind != "SP" else last
            self.solid[i] = last
            self.number[i] = x.kind == "NU" or x.kind in ("SY", "IS") and i > 0 and self.number[i - 1]
            self.flags[i] = (self.flags[i - 1] if i else 0) + 1 if x.kind == "RI" else 0

    def at(self, i: int) -> _Unit | None:
        return self.u[i] if 0 <= i < len(self.u) else None

    def kind(self, i: int) -> str:
        return self.u[i].kind if 0 <= i < len(self.u) else ""

    def between(self, i: int) -> str:
        """prohibited, allowed or mandatory before unit ``i``."""
        a, b = self.u[i - 1], self.u[i]
        p, q = a.kind, b.kind
        if p in HARD:
            return "prohibited" if p == "CR" and q == "LF" else "mandatory"
        if q in HARD or q in ("SP", "ZW"):
            return "prohibited"
        base = self.solid[i - 1]
        before = self.kind(base)
        if before == "ZW":
            return "allowed"
        return "prohibited" if a.joined or self._kept(i, a, b, p, q, base, before) else "allowed"

    def _kept(self, i: int, a: _Unit, b: _Unit, p: str, q: str, base: int, before: str) -> bool:
        if q == "WJ" or p == "WJ" or p == "GL":  # LB11, LB12
            return True
        if q == "GL" and p not in ("SP", "BA", "HY", "HH"):  # LB12a
            return True
        if q in ("CL", "CP", "EX", "SY") or before == "OP":  # LB13, LB14
            return True
        if base >= 0 and self.u[base].initial() and (base == 0 or self.kind(base - 1) in _AFTER_INITIAL):  # LB15a
            return True
        if b.final() and (i + 1 == len(self.u) or self.kind(i + 1) in _BEFORE_FINAL):  # LB15b
            return True
        if q == "IS":  # LB15c, LB15d
            return not (p == "SP" and self.kind(i + 1) == "NU")
        if q == "NS" and before in ("CL", "CP") or q == "B2" and before == "B2":  # LB16, LB17
            return True
        if p == "SP":  # LB18
            return False
        if self._quotes(i, a, b, p, q):
            return True
        if p == "CB" or q == "CB":  # LB20
            return False
        if p in ("HY", "HH") and q in _LETTER and (i == 1 or self.kind(i - 2) in _WORD_START):  # LB20a
            return True
        if q in ("BA", "HH", "HY", "NS") or p == "BB":  # LB21
            return True
        if p in ("HY", "HH") and self.kind(i - 2) == "HL" and q != "HL" or p == "SY" and q == "HL":  # LB21a, LB21b
            return True
        return q == "IN" or self._numbers(i, p, q) or self._letters(i, a, b, p, q)

    def _quotes(self, i: int, a: _Unit, b: _Unit, p: str, q: str) -> bool:
        """LB19 and LB19a."""
        if q == "QU":
            after = self.at(i + 1)
            return not b.initial() or not a.wide or after is None or not after.wide
        if p == "QU":
            outer = self.at(i - 2)
            return not a.final() or not b.wide or outer is None or not outer.wide
        return False

    def _numbers(self, i: int, p: str, q: str) -> bool:
        """LB23 to LB25."""
        if p in _LETTER and q == "NU" or p == "NU" and q in _LETTER:
            return True
        if p == "PR" and q in _IDEOGRAPH or p in _IDEOGRAPH and q == "PO":
            return True
        if p in ("PR", "PO") and q in _LETTER or p in _LETTER and q in ("PR", "PO"):
            return True
        if q in ("PO", "PR") and (self.number[i - 1] or p in ("CL", "CP") and i > 1 and self.number[i - 2]):
            return True
        if p in ("PO", "PR") and (q == "NU" or q == "OP" and (self.kind(i + 1) == "NU" or self.kind(i + 1) == "IS" and self.kind(i + 2) == "NU")):
            return True
        return q == "NU" and (p in ("HY", "IS") or self.number[i - 1])

    def _letters(self, i: int, a: _Unit, b: _Unit, p: str, q: str) -> bool:
        """LB26 to LB30b."""
        if p == "JL" and q in ("JL", "JV", "H2", "H3") or p in ("JV", "H2") and q in ("JV", "JT") or p in ("JT", "H3") and q == "JT":
            return True
        if p in _HANGUL and q == "PO" or p == "PR" and q in _HANGUL or p in _LETTER and q in _LETTER:
            return True
        if p == "AP" and b.aksara() or a.aksara() and q in ("VF", "VI"):
            return True
        if p == "VI" and i > 1 and self.u[i - 2].aksara() and (q == "AK" or b.char == _DOTTED):
            return True
        if a.aksara() and b.aksara() and self.kind(i + 1) == "VF":
            return True
        if p == "IS" and q in _LETTER:
            return True
        if p in _LETTER | {"NU"} and q == "OP" and not b.wide or p == "CP" and not a.wide and q in _LETTER | {"NU"}:
            return True
        if p == "RI" and q == "RI":
            return self.flags[i - 1] % 2 == 1
        return q == "EM" and (p == "EB" or predicate("extended_pictographic")[ord(a.char)] and predicate("unassigned")[ord(a.char)])


@cache
def _latin_kinds() -> tuple[np.ndarray, dict[str, int]]:
    """Number of the class of each byte of Latin-1, and the numbers."""
    number: dict[str, int] = {}
    return np.array([number.setdefault(_kind(chr(i)), len(number)) for i in range(256)], np.uint8), number


def _latin(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a text of the Latin repertoire may and must break before the characters from the second on.

    The rules for the classes CR LF SP BA AL NU OP CL CP EX IS SY HY QU PR PO; no others occur, and no
    character is wide, a mark or an initial or final quote.
    """
    table, number = _latin_kinds()
    k = table[np.frombuffer(text.encode("latin-1"), np.uint8)]
    n = len(k)
    is_ = {c: k == number[c] for c in "CR LF SP BA AL NU OP CL CP EX IS SY HY QU PR PO".split()}
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(is_["SP"], -1, at))
    runs = np.maximum.accumulate(np.where(is_["SY"] | is_["IS"], -1, at))
    number_ends = (runs >= 0) & is_["NU"][runs]
    q = {c: x[1:] for c, x in is_.items()}
    p = {c: x[:-1] for c, x in is_.items()}
    no = np.zeros(1, bool)
    ahead = {c: np.append(x[2:], no) for c, x in is_.items() if c in ("NU", "IS")}
    ahead2_nu = np.append(is_["NU"][3:], np.zeros(min(2, n - 1), bool))
    behind = lambda x: np.append(no, x[:-2])  # noqa: E731  at i - 2
    must = p["LF"] | p["CR"] & ~q["LF"]
    hard = p["LF"] | p["CR"]
    affix_p, affix_q = p["PR"] | p["PO"], q["PR"] | q["PO"]
    # in the order of the rules: what follows a space is settled at LB18
    base = solid[:-1]
    early = q["CR"] | q["LF"] | q["SP"] | q["CL"] | q["CP"] | q["EX"] | q["SY"] | (base >= 0) & is_["OP"][base] | q["IS"] & ~(p["SP"] & ahead["NU"])
    late = (
        p["QU"] | q["QU"] | q["BA"] | q["HY"]  # LB19, LB21
        | p["HY"] & q["AL"] & np.append(n > 1, behind(is_["CR"] | is_["LF"] | is_["SP"])[1:])  # LB20a
        | p["AL"] & (q["NU"] | q["AL"] | affix_q | q["OP"]) | p["NU"] & (q["AL"] | q["OP"]) | affix_p & q["AL"]  # LB23, LB24, LB28, LB30
        | affix_q & (number_ends[:-1] | (p["CL"] | p["CP"]) & behind(number_ends))  # LB25
        | affix_p & (q["NU"] | q["OP"] & (ahead["NU"] | ahead["IS"] & ahead2_nu))
        | q["NU"] & (p["HY"] | p["IS"] | number_ends[:-1])
        | p["IS"] & q["AL"] | p["CP"] & (q["AL"] | q["NU"])  # LB29, LB30
    )
    return ~hard & ~early & (p["SP"] | ~late), must


def counts(text: str) -> tuple[int, int]:
    """How many boundaries are allowed or mandatory breaks, and how many are mandatory; both ends included."""
    if len(text) > 1 and is_latin(text):
        may, must = _latin(text)
        found = int(must.sum())
        return int(may.sum()) + found + 1, found + 1
    kinds = [k for _, k in opportunities(text)]
    return len(kinds) - kinds.count("prohibited"), kinds.count("mandatory")


def opportunities(text: str) -> list[tuple[int, str]]:
    """(position in code units, kind) of every boundary, both ends included; an empty text has one, mandatory."""
    if not text:
        return [(0, "mandatory")]
    if len(text) > 1 and is_latin(text):
        may, must = _latin(text)
        named = np.array(["prohibited", "allowed", "mandatory"], object)[may + 2 * must]
        return [(0, "prohibited"), *enumerate(named.tolist(), 1), (len(text), "mandatory")]
    units = _units(text)
    rules = _Rules(units)
    kinds = {x.first: rules.between(i) for i, x in enumerate(units) if i}
    out, at = [(0, "prohibited")], 0
    for i, c in enumerate(text, 1):
        at += 1 + (ord(c) > 0xFFFF)
        out.append((at, "mandatory" if i == len(text) else kinds.get(i, "prohibited")))
    return out


def breaks(text: Column) -> Column:
    """array<struct<pos:int,kind:string>> of the boundaries where a line may or must end."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else [{"pos": p, "kind": k} for p, k in opportunities(x) if k != "prohibited"])

    return F.pandas_udf(run, "array<struct<pos:int,kind:string>>")(text)
