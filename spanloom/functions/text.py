"""Column expressions over text: sizes, classes of characters, scans, hashes, envelopes.

Offsets of the engine are UTF-16 code units; Spark counts code points.  Both are offered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of ASCII and Latin-1.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: What a text of ASCII printables, tab, line ends and Latin-1 letters does not hold: without it words follow from ``WORD``.
NOT_LATIN = f"[^\\x09\\x0A\\x0D\\x20-\\x7E{LETTERS}]"
#: Default word segmentation (UAX #29) on that repertoire: the matches tile the text.
#: Repeats are possessive: nothing after them could need a part back, and the engine walks them without recursion.
WORD = f"(?:[{LETTERS}]++(?:[:.'][{LETTERS}]++)*+|[0-9]++(?:[,.;'][0-9]++)*+|_)++|\\r\\n| ++|[\\s\\S]"
WORD_LIKE = f"[{LETTERS}0-9_]"

BIDI_CONTROLS = "\\x{061C}\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}"
JOIN_CONTROLS = "\\x{200C}\\x{200D}"
VARIATION_SELECTORS = "\\x{180B}-\\x{180D}\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}"
DEFAULT_IGNORABLE = (
    "\\x{00AD}\\x{034F}\\x{061C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}"
    "\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{1BCA0}-\\x{1BCA3}\\x{1D173}-\\x{1D17A}\\x{E0000}-\\x{E0FFF}"
)
NONCHARACTERS = "\\x{FDD0}-\\x{FDEF}" + "".join(f"\\x{{{p:X}FFFE}}\\x{{{p:X}FFFF}}" for p in range(17)).replace("{0F", "{F")
CONTROL = "\\x{0000}-\\x{001F}\\x{007F}-\\x{009F}"
INVISIBLE = "\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}"

INTEGRITY_KINDS = {
    "default_ignorable": DEFAULT_IGNORABLE,
    "bidi_control": BIDI_CONTROLS,
    "join_control": JOIN_CONTROLS,
    "variation_selector": VARIATION_SELECTORS,
    "noncharacter": NONCHARACTERS,
}


def code_points(text: Column) -> Column:
    return F.length(text).cast("long")


def code_units(text: Column) -> Column:
    """UTF-16 code units."""
    return F.shiftright(F.octet_length(F.encode(text, "UTF-16LE")), 1).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def count_class(text: Column, chars: str) -> Column:
    """Code points of ``text`` in a regular-expression class body."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def has_bidi_controls(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{BIDI_CONTROLS}]"))


def is_latin(text: Column) -> Column:
    return ~F.rlike(text, F.lit(NOT_LATIN))


def words(text: Column) -> Column:
    """All word segments of a text of the Latin repertoire."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_like(segment: Column) -> Column:
    """Whether a segment of a text of the Latin repertoire is a word or number."""
    return F.rlike(segment, F.lit(WORD_LIKE))


def case_fold_latin(text: Column) -> Column:
    """Full case folding on the Latin repertoire."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))


def sha256_text(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def u64_hex(value: Column) -> Column:
    """A signed long as 16 hexadecimal digits of its unsigned value."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def unsigned_order(value: Column) -> Column:
    """A long that sorts as the unsigned value of ``value`` does."""
    return value.bitwiseXOR(F.lit(-(2**63)))


def is_ijson(text: Column) -> Column:
    """No noncharacter (a Spark string holds no lone surrogate)."""
    return ~F.rlike(text, F.lit(f"[{NONCHARACTERS}]"))


def host_of(url: Column) -> Column:
    """Host of an absolute URL, without user and port."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def ascii_host(host: Column) -> Column:
    """Lower-cased host of ASCII letters, digits, hyphens and dots; null for any other (no mapping is done)."""
    return F.when(F.rlike(host, F.lit("^[A-Za-z0-9.-]+$")) & ~F.rlike(F.lower(host), F.lit("(^|\\.)xn--")), F.lower(host))
