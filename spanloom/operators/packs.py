"""Summary packs: scalar facts of each text and of a corpus, and whole packs as canonical JSON."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import bidi, kernels, linebreak, pack, segment, text
from spanloom.functions.security import Skeletons

from . import facts, fingerprint, rows
from .tokens import cutter


def analyze_text(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, tokens, graphemes, scans and checksum."""
    def make(x: str) -> tuple:
        found = segment.pieces(x, "word")
        raw = x.encode()
        return (
            segment.code_units(x), len(x), len(raw), len(found), len(segment.word_like(x)), pack.grapheme_count(x), pack.control_chars(x),
            len(bidi.controls(x)) > 0, f"sha256:{hashlib.sha256(raw).hexdigest()}",
        )

    kind = ",".join(f"{c}:bigint" for c in ("code_units", "code_points", "bytes", "tokens", "words", "graphemes", "control_chars"))
    return rows.each(docs, ["doc_id"], ["text"], f"{kind},has_bidi_controls:boolean,sha256:string", make)


def size_guard(docs: DataFrame, limit: int = 8_000_000, column: str = "text") -> DataFrame:
    """``docs``, once one cheap scan has shown that its texts hold at most ``limit`` code units in all; else an error before any heavy work."""
    total = docs.agg(F.sum(text.code_units(F.col(column))).alias("n")).first().n or 0
    if total > limit:
        raise ValueError(f"CORPUS_TOO_LARGE: {total} code units, at most {limit}")
    return docs


def analyze_corpus(docs: DataFrame, limit_code_units: int | None = None) -> DataFrame:
    """One row for the corpus.  With a limit, a corpus of more code units is an error."""
    each = analyze_text(docs)
    total = each.agg(
        F.count(F.lit(1)).alias("documents"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("code_units", "code_points", "bytes", "tokens", "words", "graphemes", "control_chars")],
        F.coalesce(F.sum(F.col("has_bidi_controls").cast("long")), F.lit(0)).alias("with_bidi_controls"),
    )
    if limit_code_units is not None:
        total = total.where(F.when(F.col("code_units") <= limit_code_units, True).otherwise(F.raise_error(F.lit("CORPUS_TOO_LARGE")).cast("boolean")))
    return total


def _text(made: dict) -> str:
    """Canonical JSON of a pack, in which strings that I-JSON cannot hold go into envelopes."""
    try:
        return kernels.jcs_plain(made)
    except ValueError:
        return kernels.jcs_plain(_plain(made))


def _digest(text: str) -> str:
    return f"sha256:{hashlib.sha256(text.encode()).hexdigest()}"


def _json(texts: Column, make: Callable[[str], str]) -> Column:
    """struct<json, sha256> of what ``make`` gives for each text; null for null."""

    def run(column: pa.Array) -> pa.Array:
        # as Arrow has them: strings of a whole batch are not held as objects
        made, digests = [], []
        for i in range(0, len(column), 256):
            found = [None if x is None else make(x) for x in column[i : i + 256].to_pylist()]
            made.append(pa.array(found, pa.string()))
            digests += [None if x is None else _digest(x) for x in found]
        both = [pa.concat_arrays(made) if made else pa.array([], pa.string()), pa.array(digests, pa.string())]
        return pa.StructArray.from_arrays(both, ["json", "sha256"])

    return F.arrow_udf(run, "struct<json:string,sha256:string>")(texts)


def _digests(docs: DataFrame, make: Callable[[str], str], id_column: str) -> DataFrame:
    """(id, sha256, length) of what ``make`` gives for each text, which does not leave the worker."""

    def one(x: str) -> tuple:
        text = make(x)
        return _digest(text), len(text)

    return rows.each(docs, [id_column], ["text"], "sha256:string,length:int", one)


def _pack_text(options: Mapping | None, table: Skeletons | None) -> Callable[[str], str]:
    opts, known = dict(options or {}), Skeletons(table or {})
    tokens: tuple[dict, dict] = ({}, {})
    return lambda x: pack.pack_v1_text(x, opts, known, tokens)


def _fact_text(options: Mapping | None, table: Skeletons | None) -> Callable[[str], str]:
    opts, known = dict(options or {}), Skeletons(table or {})
    return lambda x: _text(pack.fact_pack(x, opts, known))


def pack_v1(texts: Column, options: Mapping | None = None, table: Skeletons | None = None) -> Column:
    """Exchange packs of texts as canonical JSON, with their checksum; see ``functions.pack.pack_v1``."""
    return _json(texts, _pack_text(options, table))


def pack_digests(docs: DataFrame, options: Mapping | None = None, table: Skeletons | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, sha256, length) of these packs."""
    return _digests(docs, _pack_text(options, table), id_column)


def fact_pack(texts: Column, options: Mapping | None = None, table: Skeletons | None = None) -> Column:
    """All facts of each text as canonical JSON; see ``functions.pack.fact_pack``.  A text over the size limit is an error."""
    return _json(texts, _fact_text(options, table))


def fact_digests(docs: DataFrame, options: Mapping | None = None, table: Skeletons | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, sha256, length) of these packs."""
    return _digests(docs, _fact_text(options, table), id_column)


def _plain(value: object) -> object:
    """Strings that I-JSON cannot hold go into envelopes."""
    from spanloom.functions import protocol

    if isinstance(value, str):
        return value if protocol.is_ijson_text(value) else protocol.envelope(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def surface_profiles(docs: DataFrame, sizes: tuple[int, ...] = (2, 3), top: int = 50, bins: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """doc_id, profile, sha256: the surface profile of each text as canonical JSON."""

    def make(x: str) -> tuple:
        made = _text(pack.surface_profile(x, sizes, top, bins))
        return made, _digest(made)

    return rows.each(docs, ["doc_id"], ["text"], "profile:string,sha256:string", make)


def display_facts(docs: DataFrame, lines: bool = True, directions: bool = True) -> DataFrame:
    """doc_id, line breaks (all and mandatory), bidi runs, paragraph level, mixed direction, bidi controls; ``lines`` and ``directions`` leave out the others."""

    def make(x: str) -> tuple:
        return *(linebreak.counts(x) if lines else ()), *(bidi.summary(x) if directions else ())

    kinds = ["line_breaks:bigint,mandatory_breaks:bigint"] * lines + ["bidi_runs:bigint,paragraph_level:int,mixed_direction:boolean,bidi_controls:bigint"] * directions
    return rows.each(docs, ["doc_id"], ["text"], ",".join(kinds), make)


def corpus_pack(docs: DataFrame, n: int = 2, window: int = 3, top: int = 50, keep: str = "word-like", k: int = 5, winnow: int = 4, limit_code_units: int | None = None) -> DataFrame:
    """(section, place, item, count): the whole corpus pack as rows.

    Sections: summary, words, ngrams, cooccurrence, repetition, duplicate_sentences, display,
    security, safety, fingerprint, totals; place numbers the items of a section from 1 by falling count.
    ``totals`` has the sums behind the lists, which show ``top`` items: tokens, n-grams, windows,
    repeated n-grams and repeated sentences.  Sums of texts come from one pass and each list from one of its own,
    so nothing is gathered but ``top`` rows each.  With a limit, a larger corpus is an error.
    """
    docs = size_guard(docs, limit_code_units) if limit_code_units is not None else docs

    def scalars(section: str, one: DataFrame, first: int = 1) -> DataFrame:
        names = one.columns
        pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("item"), F.col(c).cast("long").alias("count")) for i, c in enumerate(names, first)])
        return one.select(F.lit(section).alias("section"), F.explode(pairs).alias("x")).select("section", "x.*")

    def ranked(section: str, counts: DataFrame, item: Column) -> DataFrame:
        best = counts.select(item.alias("item"), "count").orderBy(F.desc("count"), "item").limit(top)
        rows = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "item")))
        return best.agg(rows.alias("r")).select(F.lit(section).alias("section"), F.posexplode("r").alias("place", "x")).select("section", (F.col("place") + 1).alias("place"), F.col("x.item").alias("item"), (-F.col("x.order")).alias("count"))

    said = ("code_units", "code_points", "bytes", "graphemes", "tokens", "words", "sentences", "line_breaks", "mandatory_breaks", "bidi_runs", "level", "mixed", "bidi_controls", "unpaired_surrogates", "control_chars", "invisible_chars", "kept", "ngrams", "windows")

    def make(x: str) -> tuple:
        n_all, n_like = len(segment.pieces(x, "word")), len(segment.word_like(x))
        kept = n_like if keep == "word-like" else n_all
        runs, level, mixed, controls = bidi.summary(x)
        return (
            segment.code_units(x), len(x), len(x.encode()), pack.grapheme_count(x), n_all, n_like, len(kernels.split_sentences(x)) if x else 0, *linebreak.counts(x), runs, level, int(mixed), controls,
            0, pack.control_chars(x), pack.invisible_chars(x), kept, max(0, kept - n + 1), max(0, kept - max(2, window) + 1),
        )

    each = rows.each(docs, [], ["text"], ",".join(f"{c}:bigint" for c in said), make)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = lambda condition: F.count_if(condition).cast("long")
    sums = {
        "summary": {"documents": F.count(F.lit(1)), **{c: total(c) for c in said[:7]}},
        "display": {
            **{c: total(c) for c in ("line_breaks", "mandatory_breaks", "bidi_runs")}, "left_to_right": one(F.col("level") == 0), "right_to_left": one(F.col("level") == 1),
            "mixed_direction_docs": total("mixed"), "bidi_controls": total("bidi_controls"), "docs_with_bidi_controls": one(F.col("bidi_controls") > 0),
        },
        "security": {"has_bidi_controls": (total("bidi_controls") > 0).cast("long"), "bidi_controls": total("bidi_controls"), "mixed_direction": (total("mixed") > 0).cast("long"), "mixed_direction_docs": total("mixed")},
        "safety": {c: total(c) for c in ("unpaired_surrogates", "control_chars", "invisible_chars")},
        "totals": {"tokens": total("kept"), "ngrams": total("ngrams"), "windows": total("windows")},
    }
    listed = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(i).alias("place"), F.lit(c).alias("item"), v.cast("long").alias("count")) for section, parts in sums.items() for i, (c, v) in enumerate(parts.items(), 1)])
    summed = each.agg(listed.alias("x")).select(F.explode("x").alias("x")).select("x.*")

    # an empty corpus has sums of 0
    count_of = lambda name, place, counts: scalars("totals", counts.agg(F.count(F.lit(1)).alias(name)), place)
    cut = cutter(keep=keep)

    def marks(texts: Iterable[str]) -> tuple:
        found: set[str] = set()
        for x in texts:
            words = segment.pieces(x, "word")
            h = fingerprint.shingle_hashes(fingerprint.token_hashes(words, "xxh64-utf8"), k)
            found.update(h[fingerprint.winnow(h, winnow, "by-hash")].tolist())
        return (len(found),)

    prints = rows.by_document(docs, "doc_id", "text", "n:bigint", marks)
    sentences = facts.duplicate_sentences(docs, None)
    grams = rows.counted(docs, [], "text", "gram:string", lambda x: facts.grams(cut(x), n))
    listed_grams = ranked("ngrams", grams, F.col("gram"))
    # the repeated ones among them are the commonest of all that are repeated
    both = F.explode(F.when(F.col("count") >= 2, F.array(F.lit("ngrams"), F.lit("repetition"))).otherwise(F.array(F.lit("ngrams"))))
    parts = [
        summed,
        ranked("words", facts.word_frequencies(docs, None, keep), F.col("token")),
        listed_grams.drop("section").select(both.alias("section"), "place", "item", "count"),
        ranked("cooccurrence", facts.word_cooccurrence(docs, window, None, keep), F.concat_ws(" ", "a", "b")),
        ranked("duplicate_sentences", sentences, F.col("sentence")),
        count_of("repeated_ngrams", 4, grams.where("count >= 2")),
        count_of("duplicate_sentences", 5, sentences),
        scalars("fingerprint", prints.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("fingerprints"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
