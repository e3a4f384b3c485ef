"""Quality rules as weak supervision: rules vote, EM estimates their accuracies, posteriors decide.

Each rule votes 1 (keep), -1 (drop) or 0 (abstain) on the measures of a document.  Documents
with the same votes are alike to the model, so one aggregation counts the vote patterns (3 to
the number of rules at most, whatever the corpus); expectation-maximisation over these counts
estimates the share of good documents and, for each rule and class, the distribution of its
votes, starting from the number of drop votes.  The posterior of every pattern is looked up again by
the documents.  Measures are DataFrame functions inside each row; the only shuffle is that of
the pattern counts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """Votes drop where ``drop`` holds, else keep where ``keep`` holds, else abstains (SQL over the measures)."""

    name: str
    drop: str
    keep: str


#: Each kind of damage is seen by two rules at least: independent votes alone could not tell a
#: kind that one rule sees from that rule's errors.
RULES = (
    Rule("word_length", "word_chars < 2.2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    Rule("symbols", "n_symbols > 0.2 * n_words", "n_symbols <= 0.05 * n_words"),
    Rule("symbol_words", "n_symbol_words > 0.1 * n_words", "n_symbol_words <= 0.02 * n_words"),
    Rule("repeated_words", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.15 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.25 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    Rule("capitals", "n_upper > 0.35 * word_chars", "n_upper <= 0.15 * word_chars"),
    Rule("exclamation", "n_marks > 0.15 * n_words", "n_marks <= 0.05 * n_words"),
    Rule("sentences", "n_words >= 100 and n_stops = 0", "n_stops between n_words / 60 and n_words / 3"),
)


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(grams: str) -> Column:
    """Words under 3-word windows (hashes in reading order) that occur twice or more."""
    pairs = f"array_sort(transform({grams}, (g, i) -> struct(g, i)))"
    return F.expr(
        f"""case when size(array_distinct({grams})) = size({grams}) then 0L else
        aggregate(
          array({pairs}),
          0L,
          (none, p) -> aggregate(
            array(array_sort(transform(filter(transform(p, (s, i) -> struct(s.g = get(p, i - 1).g or s.g = get(p, i + 1).g as twin, s.i as i)), t -> t.twin), t -> t.i))),
            0L,
            (zero, q) -> aggregate(transform(q, (x, j) -> least(3, coalesce(get(q, j + 1), x + 3) - x)), 0L, (a, b) -> a + b)
          )
        ) end"""
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules need besides."""
    t = F.col("t")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("w", words(t)).withColumn("lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    rows = rows.withColumn("grams", F.expr("case when size(w) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"))
    size = lambda c: F.size(c).cast("long")
    return rows.select(
        "doc_id",
        size("w").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _repeat_words("grams").alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}", ""))).cast("long").alias("n_upper"),
        F.regexp_count(t, F.lit("[#*$%&|<>](?=[\\x20\\x09-\\x0D]|$)")).cast("long").alias("n_symbol_words"),
        _count(t, "!?").alias("n_marks"),
        _count(t, ".:;").alias("n_stops"),
    )


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")


def pattern(rules: tuple[Rule, ...] = RULES) -> Column:
    """The votes as one number: base 3, digit 0 drop, 1 abstain, 2 keep."""
    digits = [f"(case when {r.drop} then 0 when {r.keep} then 2 else 1 end) * {3**i}" for i, r in enumerate(rules)]
    return F.expr(" + ".join(digits))


def fit(counts: dict[int, int], n_rules: int, rounds: int = 200, smooth: float = 1.0) -> tuple[float, list[list[list[float]]], dict[int, float]]:
    """EM over the vote patterns seen: share of good documents, P(vote | class) per rule, posterior of each pattern.

    Class 1 starts as the patterns without a drop vote, class 0 as those with two.  Votes are
    independent given the class.
    """
    digits = {p: [p // 3**i % 3 for i in range(n_rules)] for p in counts}
    # at the start two drop votes are damage, one is doubt
    good = {p: (0.97, 0.6, 0.03)[min(v.count(0), 2)] for p, v in digits.items()}
    share, table = 0.5, []
    for _ in range(rounds):
        mass = [smooth, smooth]
        votes = [[[smooth] * 3 for _ in range(2)] for _ in range(n_rules)]
        for p, n in counts.items():
            for c, w in ((1, n * good[p]), (0, n * (1 - good[p]))):
                mass[c] += w
                for i, d in enumerate(digits[p]):
                    votes[i][c][d] += w
        new_share = mass[1] / sum(mass)
        table = [[[x / sum(v[c]) for x in v[c]] for c in range(2)] for v in votes]
        for p, v in digits.items():
            odds = math.log(new_share / (1 - new_share)) + sum(math.log(table[i][1][d] / table[i][0][d]) for i, d in enumerate(v))
            good[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        moved, share = abs(new_share - share), new_share
        if moved < 1e-9:
            break
    return share, table, good


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, base_failed, pattern, quality (posterior) and kept for every row of ``docs``.

    Null and empty texts have no words, so they fail the base; repeated rows count as rows; in
    an empty table nothing is judged; other columns are ignored.  A document is kept if it
    passes the base and its posterior is ``threshold`` at least; documents with equal votes share
    it; very long texts are measured whole.
    """
    seen = stage(measures(docs, doc_id, text).withColumn("pattern", pattern(rules)).withColumn("base_failed", base_failed()), "measures")
    # a pattern is one of 3**len(rules), and those of documents that failed the base have a posterior too
    counted = seen.groupBy("pattern").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()
    _, _, posterior = fit({r["pattern"]: r["n"] for r in counted}, len(rules))
    looked = F.element_at(F.from_json(F.lit(json.dumps(posterior)), "map<string,double>"), F.col("pattern").cast("string"))
    return seen.withColumn("quality", looked).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
