"""Character properties by code point, from the pattern engine's Unicode data; looked up once per code point and process."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LETTERS, NOT_LATIN

#: Classes of each property; the first is what an unlisted code point has.
CLASSES: dict[str, tuple[str, ...]] = {
    "Line_Break": tuple(
        "XX BK CR LF NL SP ZW WJ GL CM ZWJ AL AI SG CJ SA HL NU OP CL CP QU EX SY IS BA HH HY NS BB B2 CB IN PR PO ID EB EM RI JL JV JT H2 H3 AP AK AS VF VI".split()
    ),
    "Bidi_Class": tuple("L R AL EN ES ET AN CS NSM BN B S WS ON LRE LRO RLE RLO PDF LRI RLI FSI PDI".split()),
    "General_Category": tuple("Cn Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co".split()),
    "Grapheme_Cluster_Break": tuple("Other CR LF Control Extend ZWJ Regional_Indicator Prepend SpacingMark L V T LV LVT".split()),
    "Word_Break": tuple("Other CR LF Newline Extend ZWJ Regional_Indicator Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet WSegSpace".split()),
    "Sentence_Break": tuple("Other CR LF Extend Sep Format Sp Lower Upper OLetter Numeric ATerm SContinue STerm Close".split()),
    "Indic_Conjunct_Break": tuple("None Linker Consonant Extend".split()),
    "East_Asian_Width": tuple("N A F H Na W".split()),
    "Joining_Type": tuple("U C D L R T".split()),
}

#: Script names of more than one word or with inner capitals.
LONG_SCRIPT_NAMES = (
    "Anatolian_Hieroglyphs Beria_Erfe Canadian_Aboriginal Caucasian_Albanian Cypro_Minoan Dives_Akuru Egyptian_Hieroglyphs Gunjala_Gondi Gurung_Khema Hanifi_Rohingya "
    "Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Khitan_Small_Script Kirat_Rai Linear_A Linear_B Masaram_Gondi Meetei_Mayek Mende_Kikakui Meroitic_Cursive "
    "Meroitic_Hieroglyphs Nag_Mundari New_Tai_Lue Nyiakeng_Puachue_Hmong Ol_Chiki Ol_Onal Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian "
    "Old_South_Arabian Old_Turkic Old_Uyghur Pahawh_Hmong Pau_Cin_Hau Phags_Pa Psalter_Pahlavi SignWriting Sora_Sompeng Syloti_Nagri Tai_Le Tai_Tham Tai_Viet Tai_Yo "
    "Tolong_Siki Tulu_Tigalari Warang_Citi Zanabazar_Square"
).split()

#: Yes-or-no properties by the name they have here.
PREDICATES: dict[str, str] = {
    "common_or_inherited": r"[\p{Script=Common}\p{Script=Inherited}]",
    "default_ignorable": r"\p{Default_Ignorable_Code_Point}",
    "bidi_control": r"\p{Bidi_Control}",
    "join_control": r"\p{Join_Control}",
    "variation_selector": r"\p{Variation_Selector}",
    "noncharacter": r"\p{Noncharacter_Code_Point}",
    "extended_pictographic": r"\p{Extended_Pictographic}",
    "east_asian_wide": r"[\p{East_Asian_Width=W}\p{East_Asian_Width=F}\p{East_Asian_Width=H}]",
    "mark": r"\p{M}",
    "initial_punctuation": r"\p{Pi}",
    "final_punctuation": r"\p{Pf}",
    "unassigned": r"\p{Cn}",
    "word_like": r"[\p{Word_Break=ALetter}\p{Word_Break=Hebrew_Letter}\p{Word_Break=Numeric}\p{Word_Break=Katakana}\p{Word_Break=ExtendNumLet}]",
}


class _Lookup(dict):
    """Code point to value, tested once each."""

    def __init__(self, find: Callable[[str], object]):
        self.find = find

    def __missing__(self, cp: int) -> object:
        self[cp] = found = self.find(chr(cp))
        return found


@cache
def lookup(name: str) -> _Lookup:
    """Value of a property of ``CLASSES`` for each code point."""
    values = CLASSES[name]
    tests = [(v, regex.compile(rf"\p{{{name}={v}}}")) for v in values[1:]]
    return _Lookup(lambda c: next((v for v, t in tests if t.match(c)), values[0]))


@cache
def predicate(name: str) -> _Lookup:
    test = regex.compile(PREDICATES[name])
    return _Lookup(lambda c: test.match(c) is not None)


@cache
def script_names() -> tuple[str, ...]:
    """All scripts of the data, each once, by their long names."""
    by_id: dict[int, str] = {}
    for name, number in regex._regex_core.PROPERTIES["SCRIPT"][1].items():
        names = (by_id.get(number, name), name)
        # codes have four letters: a name of three or less is the name
        by_id[number] = min(names, key=len) if min(map(len, names)) < 4 else max(names, key=len)
    long = {n.replace("_", "").upper(): n for n in LONG_SCRIPT_NAMES}
    return tuple(sorted(long.get(n, n.capitalize()) for n in by_id.values() if n != "UNKNOWN"))


@cache
def script() -> _Lookup:
    tests = [(n, regex.compile(rf"\p{{Script={n}}}")) for n in sorted(script_names(), key=lambda n: (n not in ("Latin", "Common"), n))]
    return _Lookup(lambda c: next((n for n, t in tests if t.match(c)), "Unknown"))


_not_latin, _latin_letter = re.compile(NOT_LATIN).search, re.compile(f"[{LETTERS}]").search


@cache
def script_extensions() -> _Lookup:
    """All scripts that use the character."""
    tests = [(n, regex.compile(rf"\p{{Script_Extensions={n}}}")) for n in script_names()]
    return _Lookup(lambda c: tuple(n for n, t in tests if t.match(c)) or ("Unknown",))


def token_scripts(token: str) -> list[str]:
    """Scripts of a token by extensions, but for Common and Inherited; without any, that of its first character."""
    if token and not _not_latin(token):
        return ["Latin" if _latin_letter(token) else "Common"]
    table = script_extensions()
    found = {s for c in set(token) for s in table[ord(c)] if s not in ("Common", "Inherited")}
    return sorted(found) if found else [script()[ord(token[0])]] if token else []


def of(char: Column, name: str) -> Column:
    """A property of ``CLASSES``, ``script`` or ``script_extensions`` (joined by a space) of the first character; null for none."""
    def run(s: pd.Series) -> pd.Series:
        if name == "script_extensions":
            found = lambda cp: " ".join(script_extensions()[cp])
        else:
            found = (script() if name == "script" else lookup(name)).__getitem__
        return s.map(lambda x: found(ord(x[0])) if x else None)

    return F.pandas_udf(run, "string")(char)


def has(char: Column, name: str) -> Column:
    """Whether the first character has a property of ``PREDICATES``; null for none."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: predicate(name)[ord(x[0])] if x else None)

    return F.pandas_udf(run, "boolean")(char)


def mixed_script(token: Column) -> Column:
    """Whether a token has characters of more than one script."""
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else len(token_scripts(x)) > 1)

    return F.pandas_udf(run, "boolean")(token)
