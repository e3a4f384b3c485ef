"""Token tables: (document columns, tok_idx, raw) rows from texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import kernels, segment, text

from . import rows


def segments(column, tokenizer: str = "word", repertoire: str = "auto", keep: str = "all"):
    """Array of the tokens that tile a text, or of the word-like ones.

    ``repertoire`` "auto" decides for each text: one of ASCII and Latin-1 letters stays native, any
    other goes through an Arrow kernel.  "latin" takes all texts for such ones, "any" takes none.
    """
    if tokenizer == "code_point":
        native = F.filter(F.split(column, ""), lambda x: x != "")
    elif tokenizer == "grapheme":
        native = F.regexp_extract_all(column, F.lit("\\r\\n|[\\s\\S]"), F.lit(0))
    elif tokenizer == "word":
        native = text.words(column)
    else:
        raise ValueError(f"unknown tokenizer {tokenizer}")
    latin = F.lit(repertoire == "latin") if repertoire != "auto" else text.is_latin(column)
    kept = F.filter(native, text.word_like) if keep == "word-like" else native
    if repertoire == "latin" or (tokenizer == "code_point" and keep != "word-like"):
        return kept
    # The kernels run for every row, so the others give them a null.
    rest = F.when(~latin, native if tokenizer == "code_point" else column)
    found = rest if tokenizer == "code_point" else kernels.graphemes(rest) if tokenizer == "grapheme" else kernels.words_any(rest)
    found = kernels.keep_word_like(found) if keep == "word-like" else found
    return found if repertoire == "any" else F.when(latin, kept).otherwise(found)


def count_word_like(words, column):
    """How many of ``words``, the segments of the text ``column``, are word-like."""
    latin = text.is_latin(column)
    return F.when(latin, F.size(F.filter(words, text.word_like))).otherwise(F.size(kernels.keep_word_like(F.when(~latin, words))))


def case_fold(column):
    """Full case folding, native where the text is of the Latin repertoire."""
    latin = text.is_latin(column)
    return F.when(latin, text.case_fold_latin(column)).otherwise(kernels.case_fold(F.when(~latin, column)))


def cutter(repertoire: str = "auto", keep: str = "all", tokenizer: str = "word"):
    """What ``segments`` gives for a column, as a function of one text in a worker."""
    if tokenizer not in ("word", "grapheme", "code_point"):
        raise ValueError(f"unknown tokenizer {tokenizer}")

    def one(text: str) -> list[str]:
        if tokenizer == "word" and keep == "word-like" and repertoire == "auto":
            return segment.word_like(text)
        found = segment.words(text, repertoire) if tokenizer == "word" else segment.pieces(text, tokenizer)
        return [w for w in found if segment.is_word_like(w)] if keep == "word-like" else found

    return one


def word_counts(docs: DataFrame, groups: list[str] | None = None, keep: str = "word-like", column: str = "text") -> DataFrame:
    """(groups, raw, count) of the tokens of all texts."""
    return rows.counted(docs, groups or [], column, "raw:string", cutter(keep=keep))


def word_arrays(docs: DataFrame, keep: str = "word-like", column: str = "text", repertoire: str = "auto", tokenizer: str = "word") -> DataFrame:
    """``docs`` without its text, with ``words``: the tokens of each text, all or word-like ones."""
    return docs.withColumn("words", segments(F.col(column), tokenizer, repertoire, keep)).drop(column)


def tokens(docs: DataFrame, keep: str = "word-like", column: str = "text", repertoire: str = "auto", tokenizer: str = "word") -> DataFrame:
    """One row per token, numbered from 0 in its document after filtering."""
    kept = [c for c in docs.columns if c not in (column, "words")]
    cut = cutter(repertoire, keep, tokenizer)
    return rows.exploded(docs, kept, column, "raw:string", lambda x: (cut(x),), "tok_idx")


def spans(docs: DataFrame, id_column: str = "doc_id", column: str = "text", tokenizer: str = "word", repertoire: str = "auto") -> DataFrame:
    """(id, tok_idx, start_cu, end_cu, raw) of all tokens, in UTF-16 code units."""
    def make(x: str) -> tuple:
        found = segment.spans(x, tokenizer)
        return tuple(zip(*found, strict=True)) if found else ((), (), ())

    return rows.exploded(docs, [id_column], column, "start_cu:int,end_cu:int,raw:string", make, "tok_idx")
