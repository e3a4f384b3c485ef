"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query: an OR of ANDs of the
trigrams that any match must contain (lower-cased).  The index holds postings (trigram, row)
for the trigrams that some rule asks for; a rule's candidates are the rows in the intersection
of its postings, and only they are searched with the expression.  A rule without a mandatory
trigram scans every row.  All of it is DataFrame functions; the driver holds only the rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


@dataclass(frozen=True)
class Rule:
    """A match counts if its ``group`` has ``least`` characters at least."""

    kind: str
    regex: str
    group: int
    least: int


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + MORE

#: At most so many alternatives and class members are spelled out; beyond that a part counts as unknown.
MAX_ALTERNATIVES, MAX_CLASS, MAX_GRAMS = 64, 8, 4
#: Up to so many candidate rows (a hash and a flag for each rule) are broadcast; beyond that they and the texts meet by a shuffle.
BROADCAST_ROWS = 200_000
GAP = "\0"


def _product(heads: list[str], tails: list[str]) -> list[str]:
    out = list(dict.fromkeys(a + b for a in heads for b in tails))
    return out if len(out) <= MAX_ALTERNATIVES else [a + GAP for a in heads]


def _strings(parsed: _parser.SubPattern | list) -> list[str]:
    """What the pattern can match, lower-cased, with ``GAP`` for unknown parts."""
    out = [""]
    for op, arg in parsed:
        if op is ops.LITERAL:
            part = [chr(arg).lower()]
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= MAX_CLASS:
            part = list(dict.fromkeys(chr(c).lower() for _, c in arg))
        elif op is ops.SUBPATTERN:
            part = _strings(arg[-1])
        elif op is ops.BRANCH:
            part = list(dict.fromkeys(x for branch in arg[1] for x in _strings(branch)))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, item = arg
            inner = _strings(item)
            part = ["", *inner] if (low, int(high)) == (0, 1) else [GAP] if low == 0 else [x + GAP * (int(high) > 1) for x in inner]
        elif op is ops.AT:
            part = [""]
        else:
            part = [GAP]
        out = _product(out, part)
    return out


def _grams(run: str) -> list[str]:
    """At most ``MAX_GRAMS`` trigrams that cover a run end to end as far as they reach: the ones between would hardly narrow the search."""
    starts = sorted({*range(0, len(run) - 2, 3), len(run) - 3}) if len(run) >= 3 else []
    return [run[i : i + 3] for i in starts[:: -(-len(starts) // MAX_GRAMS) or 1]]


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The OR of ANDs of trigrams that every match holds; an empty set asks for nothing (scan all)."""
    found = {frozenset(g for run in text.split(GAP) for g in _grams(run)) for text in _strings(_parser.parse(regex))}
    return sorted((x for x in found if not any(y < x for y in found)), key=sorted)


def needs_scan(query: list[frozenset[str]]) -> bool:
    return any(not x for x in query)


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, row) of (row, text) rows for these trigrams."""
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, trigrams)), lambda g: F.contains(low, g))
    return rows.select("row", F.explode(held).alias("trigram")).select("trigram", "row").distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, maybe_<kind>...) for rows in the intersection of some rule's postings; at most all asked trigrams meet per row."""
    held = index.groupBy("row").agg(F.collect_set("trigram").alias("held"))
    flags = {}
    for rule in rules:
        query = trigram_query(rule.regex)
        if not needs_scan(query):
            clauses = [F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(x))))) == len(x) for x in query]
            flag = clauses[0]
            for c in clauses[1:]:
                flag = flag | c
            flags[f"maybe_{rule.kind}"] = flag
    some = F.greatest(*flags.values(), F.lit(False))
    return held.select("row", *[c.alias(k) for k, c in flags.items()], some.alias("some")).where("some").drop("some")


def spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, place, stop, kind>> of the rule's matches, leftmost and non-overlapping, in code points.

    Starts follow from the lengths of the matches and of the text between them.
    """
    pattern = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    steps = F.zip_with(F.zip_with(F.slice(F.split(text, rule.regex, -1), 1, F.size(whole)), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))), part, lambda s, p: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), F.length(p).alias("part")))
    kind = "array<struct<start:int,place:int,stop:int,kind:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        end = begin + s["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("place"), end.alias("stop"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(s["part"] >= rule.least, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(steps, start, step, lambda acc: acc["found"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, found) for every row of ``docs``: all spans by start, then rule order.

    Null texts are empty; empty texts have no spans; the same span may be found by several
    rules; repeated rows give equal results; an empty table gives an empty result; other
    columns are ignored; very long texts are searched whole.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    asked = sorted({g for r in rules for clause in trigram_query(r.regex) for g in clause})
    if asked:
        index = stage(build_index(rows, asked), "trigrams")
        maybe = stage(candidates(index, rules), "candidates")
        discard(docs.sparkSession, index)
        few = maybe.count() <= BROADCAST_ROWS
        rows = rows.join(F.broadcast(maybe) if few else maybe, "row", "left")
    none = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string>>")
    found = []
    for i, rule in enumerate(rules):
        # a rule that scans all rows first asks whether there is any match long enough
        maybe = F.rlike("text", F.lit(_long_enough(rule))) if needs_scan(trigram_query(rule.regex)) else F.coalesce(F.col(f"maybe_{rule.kind}"), F.lit(False))
        found.append(F.when(maybe, spans(F.col("text"), rule, i)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def _long_enough(rule: Rule) -> str:
    """A test that every row with a counted match passes: repeats of one class need ``least`` of them."""
    single = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return f"{single[1]}{{{rule.least}}}" if single and rule.group == 0 and rule.least else rule.regex


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
