"""Rows in bounded batches, and the short ways for texts of the Latin repertoire beside the general rules."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import bidi, linebreak, pack, segment, ucd
from spanloom.operators import diff, facts, fingerprint, packs, rows, scan, tokens

LATIN = [c for c in map(chr, range(256)) if segment.is_latin(c)]


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(LATIN) for _ in range(rng.randrange(size))) for _ in range(n)]


class Frame:
    """Stands for a DataFrame, so that the function for ``mapInArrow`` can be called here."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_diffs_of_many_edits_take_little_time():
    a, b = ([f"{x}{rng.randrange(900)}" for _ in range(3000)] for x, rng in (("w", random.Random(1)), ("w", random.Random(2))))
    began = time.process_time()
    runs, cut = diff.edit_script(a, b)
    assert time.process_time() - began < 2 and not cut
    n = diff.edit_counts(a, b)
    assert n["equal"] == sum(r[2] - r[1] for r in runs if r[0] == "equal") and n["delete"] + n["equal"] == 3000
    assert diff.edit_counts(a, b, max_d=5) == {"equal": 0, "delete": 3000, "insert": 3000}


def test_edit_counts_are_those_of_the_script():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(12))] for _ in range(2))
        for prefer, most in (("delete", None), ("delete", 4), ("insert", None)):
            total = dict.fromkeys(("equal", "delete", "insert"), 0)
            for op, a0, a1, b0, b1 in diff.edit_script(a, b, prefer, most)[0]:
                total[op] += b1 - b0 if op == "insert" else a1 - a0
            assert diff.edit_counts(a, b, prefer, most) == total


def test_rows_leave_in_bounded_batches(spark):
    words = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    run = rows.exploded(Frame(words.schema), ["doc_id"], "text", "raw:string", lambda x: (x.split(),), "tok_idx")
    batch = pa.record_batch({"doc_id": list(range(500)), "text": ["a b c d e f g h i j " * 100] * 499 + [None]})
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert sum(sizes) == 499 * 1000 and max(sizes) <= rows.ROWS
    made = rows.each(Frame(words.schema), ["doc_id"], ["text"], "n:bigint", lambda x: (len(x),))
    sizes = [b.num_rows for b in made(iter([pa.record_batch({"doc_id": list(range(3000)), "text": ["y" * 1000] * 3000})]))]
    assert sum(sizes) == 3000 and max(sizes) <= rows.CHARS // 1000 + 1


def test_counts_held_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rows, "ENTRIES", 50)
    found = []
    frame = Frame(spark.createDataFrame([(1, "x")], "doc_id long, text string").schema)
    frame.mapInArrow = lambda run, schema: found.append(run) or spark.createDataFrame([], schema)
    rows.counted(frame, [], "text", "raw:string", str.split)
    out = list(found[0](iter([pa.record_batch({"text": [f"a b{i} c{i}" for i in range(200)]})])))
    assert max(b.num_rows for b in out) < 60 and sum(sum(b.column("count").to_pylist()) for b in out) == 600


def test_a_document_is_all_texts_of_its_id(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (1, "a b rn"), (2, None), (None, "x y x y"), (1, "m a")], "doc_id long, text string")
    assert {tuple(r) for r in facts.repetition(docs).collect()} == {(1, 1, 3), (None, 1, 2)}
    from spanloom.functions.security import prototypes

    got = {r.doc_id: tuple(r)[1:] for r in scan.security_facts(docs, prototypes(spark)).collect()}
    assert got == {1: (9, 0, 1), 2: (0, 0, 0), None: (0, 0, 0)}


def test_latin_texts_break_lines_by_the_general_rules():
    for t in [*texts(3000, 14), "a", "\r\n", ""]:
        units = linebreak._units(t)
        rules = linebreak._Rules(units)
        kinds = ["prohibited", *(rules.between(i) for i in range(1, len(units))), "mandatory"] if t else ["mandatory"]
        assert [k for _, k in linebreak.opportunities(t)] == kinds
        assert linebreak.counts(t) == (len(kinds) - kinds.count("prohibited"), kinds.count("mandatory"))


def test_latin_repertoire_agrees_with_the_tables():
    for c in LATIN:
        assert ucd.script_extensions()[ord(c)] == (("Latin",) if c.isalpha() else ("Common",))
        assert ucd.lookup("Bidi_Class")[ord(c)] in bidi._LEVEL and not ucd.predicate("bidi_control")[ord(c)]
        assert segment.is_word_like(c) == ucd.predicate("word_like")[ord(c)]
    for t in texts(1000, 20):
        assert pack.grapheme_count(t) == len(segment._cutter("grapheme")(t))
        assert segment.word_like(t) == [w for w in segment.pieces(t, "word") if segment.is_word_like(w)]
        plain = t.replace("'", "")
        assert segment.pieces(plain, "word") == segment._cutter("word")(plain)


def test_an_apostrophe_before_a_vowel_is_no_part_of_the_word(spark):
    """Default rules (UAX #29): only letters on both sides hold it; the pattern engine's own rule would keep 'a together."""
    docs = spark.createDataFrame([(1, "say 'a l'eau")], "doc_id long, text string")
    assert [r.raw for r in scan.scan_tokens(docs, keep="word-like").orderBy("tok_idx").collect()] == ["say", "a", "l'eau"]


@pytest.mark.parametrize("make", [linebreak.counts, bidi.summary, lambda x: pack.surface_profile(x, (2, 3)), pack.fact_pack], ids=["lines", "bidi", "profile", "facts"])
def test_long_latin_texts_take_little_time(make):
    text = "Some words, a number 3.14 (and more) of it.\nNext " * 12_000
    began = time.process_time()
    make(text)
    assert time.process_time() - began < 2.5


def test_winnowing_by_hash_follows_its_definition():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(300):
        h, w = rng.integers(0, 4, rng.integers(0, 40)).astype(np.uint64), int(rng.integers(1, 6))
        out = []
        for start in range(len(h) - w + 1):
            i = max(range(start, start + w), key=lambda j: (-int(h[j]), j))
            if not (out and h[i] == h[out[-1]] and start <= out[-1]):
                out.append(i)
        assert fingerprint.winnow(h, w, "by-hash") == out


def test_packs_are_the_same_by_all_ways(spark):
    docs = spark.createDataFrame([(1, "One. Two. One. Two. 'a é"), (2, None), (3, "x﷐"), (4, "")], "doc_id long, text string")
    opts = {"ngrams": {"n": 2}, "cooccurrence": {"windowSize": 3}, "includeRepetition": True, "includeDuplicateSentences": True}
    want = {r.doc_id: (r.p.sha256, r.p.json and len(r.p.json)) for r in docs.select("doc_id", packs.fact_pack(F.col("text"), opts).alias("p")).collect()}
    assert {r.doc_id: (r.sha256, r.length) for r in packs.fact_digests(docs, opts).collect()} == {k: v if v[0] else (None, None) for k, v in want.items()}
    assert {tuple(r) for r in tokens.word_counts(docs).collect()} >= {("One", 2), ("a", 1)}


def test_pack_text_is_the_pack_as_canonical_json():
    from spanloom.functions import kernels
    from spanloom.functions.security import Skeletons

    known = ({}, {})
    for opts in ({"sections": {"security": True, "variants": True, "fingerprint": True}}, {"maxTokens": 3, "topK": 2, "maxFingerprints": 1, "maxExamples": 0, "sections": {"security": True, "variants": True, "fingerprint": True, "profile": True}}):
        for t in [*texts(60, 200, 8), "", "a A ａ A b a " * 9, "Müller müller müller \"x\" \U0001f600 文字", "rnodern modern Modern 12l 121"]:
            assert pack.pack_v1_text(t, opts, Skeletons({ord("m"): "rn"}), known) == kernels.jcs(pack.pack_v1(t, opts, Skeletons({ord("m"): "rn"})))
    with pytest.raises(ValueError, match="NONCHARACTER"):
        pack.pack_v1_text("x", {"note": "\ufdd0", "includeInputText": True, "sections": {}} | {"inputTextEncoding": "string"})


def test_packs_of_many_tokens_take_little_time():
    opts = {"maxSpans": 20, "sections": {"security": True, "variants": True, "fingerprint": True}}
    rng = random.Random(1)
    text = " ".join(f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(40_000))
    began = time.process_time()
    pack.pack_v1_text(text, opts)
    assert time.process_time() - began < 4


def test_code_units_round_trip(spark):
    from spanloom.functions import protocol

    docs = spark.createDataFrame([(1, "a\U0001f600é" * 700), (2, ""), (3, None), (4, "﷐")], "doc_id long, text string")
    got = docs.select("text", protocol.encode_envelope(F.col("text"), "utf16-code-units").alias("e")).select("text", "e.code_units", protocol.decode_envelope(F.col("e")).alias("back")).collect()
    assert all(r.back == r.text for r in got) and got[0].code_units[:4] == [97, 0xD83D, 0xDE00, 0xE9] and got[2].code_units is None
    bad = spark.sql("select struct(1 as v, 'utf16-code-units' as kind, string(null) as text, string(null) as base64, array(65, 70000) as code_units) as e")
    assert bad.select(protocol.decode_envelope(F.col("e"), strict=False)).first()[0] is None
    assert docs.select(protocol.encode_envelope(F.col("text")).alias("e")).where("e.kind = 'utf16-code-units'").first().e.code_units == [0xFDD0]


def test_a_corpus_pack_has_all_its_sections(spark):
    docs = spark.createDataFrame([(1, "One a. Two b. One a. "), (2, "One a. Two b. \u202ex \u05d0"), (2, "One"), (3, None)], "doc_id long, text string")
    got = {(r.section, r.item): r["count"] for r in packs.corpus_pack(docs, top=1).collect()}
    assert got["totals", "duplicate_sentences"] == 1 and got["totals", "repeated_ngrams"] == 3 and ("duplicate_sentences", "One a. ") in got
    assert (got["totals", "tokens"], got["totals", "ngrams"], got["totals", "windows"]) == (13, 10, 8) == (got["summary", "words"], 10, 8)
    assert got["summary", "sentences"] == 6 and got["summary", "documents"] == 4
    assert [got["security", c] for c in ("has_bidi_controls", "bidi_controls", "mixed_direction", "mixed_direction_docs")] == [1, 1, 1, 1]
    assert got["repetition", "One a"] == got["ngrams", "One a"] == 3
