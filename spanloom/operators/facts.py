"""Counted facts of a corpus: frequencies, n-grams, co-occurrence, repetition, histograms.

N-grams and windows are built and counted in workers, so the only shuffle is that of counts;
of what is counted by document, it is that of the texts by document.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions import kernels, pack, segment

from . import rows
from .tokens import cutter, segments, word_counts


def top(counts: DataFrame, k: int | None, by: list[str], within: list[str] | None = None) -> DataFrame:
    """The ``k`` largest counts, ties in order of ``by``; per group of ``within`` if given; all with k None."""
    order = [F.desc("count"), *by]
    if k is None:
        return counts
    if within:
        ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        return ranked.where(F.col("rank") <= k).drop("rank")
    return counts.orderBy(*order).limit(k)


def word_frequencies(docs: DataFrame, k: int | None = 50, keep: str = "word-like", within: list[str] | None = None) -> DataFrame:
    groups = within or []
    counts = word_counts(docs, groups, keep).withColumnRenamed("raw", "token")
    return top(counts, k, ["token"], within)


def word_totals(docs: DataFrame) -> DataFrame:
    """doc_id, tokens of all kinds and word-like ones."""
    def make(x: str) -> tuple:
        found = segment.pieces(x, "word")
        return len(found), len(segment.word_like(x))

    return rows.each(docs, ["doc_id"], ["text"], "all_tokens:bigint,word_tokens:bigint", make)


def grams(words: list[str], n: int) -> map:
    """``n`` consecutive words each, joined by one space."""
    return map(" ".join, zip(*[words[j:] for j in range(n)], strict=False))


def word_ngrams(docs: DataFrame, n: int, k: int | None = 50, keep: str = "word-like", least: int = 1) -> DataFrame:
    """gram (words joined by one space), count: n consecutive tokens of one text."""
    cut = cutter(keep=keep)
    counts = rows.counted(docs, [], "text", "gram:string", lambda x: grams(cut(x), n)).where(F.col("count") >= least)
    return top(counts, k, ["gram"])


def word_cooccurrence(docs: DataFrame, window: int = 3, k: int | None = 50, keep: str = "word-like") -> DataFrame:
    """(a, b, count), a <= b: pairs of places in each full window, counted in every window that holds them."""
    cut = cutter(keep=keep)
    return top(rows.counted(docs, [], "text", "a:string,b:string", lambda x: pack.pairs_in_windows(cut(x), window)), k, ["a", "b"])


def char_ngrams(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), k: int | None = 50) -> DataFrame:
    """(n, gram, count): code-point n-grams, the k commonest of each size.

    Null and too short texts have none.
    """

    def items(x: str) -> Iterator[str]:
        for n in sizes:
            grams: Iterable[str] = x
            for j in range(1, n):
                grams = map(operator.add, grams, x[j:])
            yield from grams

    counts = rows.counted(docs, [], "text", "gram:string", items).select(F.length("gram").alias("n"), "gram", "count")
    return top(counts, k, ["gram"], ["n"])


def repetition(docs: DataFrame, n: int = 2, least: int = 2, keep: str = "word-like") -> DataFrame:
    """doc_id, distinct n-grams that the document repeats, and their occurrences."""
    cut = cutter(keep=keep)

    def make(texts: Iterable[str]) -> tuple | None:
        counts: Counter = Counter()
        for x in texts:
            words = cut(x)
            counts.update(zip(*[words[j:] for j in range(n)], strict=False))
        found = [c for c in counts.values() if c >= least]
        return (len(found), sum(found)) if found else None

    return rows.by_document(docs, "doc_id", "text", "repeated:bigint,occurrences:bigint", make)


def word_length_histogram(docs: DataFrame, bins: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """(upto, count) of word lengths in code points; upto null is the overflow."""
    upto = F.coalesce(*[F.when(F.col("size") <= b, b) for b in bins]) if bins else F.lit(None).cast("int")
    sizes = rows.counted(docs, [], "text", "size:int", lambda x: map(len, segment.word_like(x)))
    return sizes.groupBy(upto.alias("upto")).agg(F.sum("count").alias("count"))


def duplicate_lines(docs: DataFrame, k: int | None = 50) -> DataFrame:
    """(line, count) of lines that the corpus holds more than once, blank ones apart."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return top(counts, k, ["line"])


def grapheme_counts(docs: DataFrame, repertoire: str = "auto") -> DataFrame:
    return docs.select("doc_id", F.size(segments(F.col("text"), "grapheme", repertoire)).cast("long").alias("graphemes"))


def sentence_counts(docs: DataFrame) -> DataFrame:
    return rows.each(docs, ["doc_id"], ["text"], "sentences:bigint", lambda x: (len(kernels.split_sentences(x)),))


def duplicate_sentences(docs: DataFrame, k: int | None = 50) -> DataFrame:
    """(sentence, count) of sentences that the corpus holds more than once."""
    counts = rows.counted(docs, [], "text", "sentence:string", kernels.split_sentences)
    return top(counts.where("count > 1"), k, ["sentence"])
