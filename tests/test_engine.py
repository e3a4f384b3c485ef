"""Unit tests of the functions and operators outside the registered queries."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import kernels, protocol, text
from spanloom.operators import diff, facts, fingerprint, packs, tokens, variants
from spanloom.sources import documents


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(1, "Alpha alpha, it's 3.14!\r\nso_so"), (2, ""), (3, None), (4, "Straße ÀÉ éé"), (5, "a b a b a b"), (6, "x‮y​﷐")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    ("value", "utf16"),
    [("", 0xCBF29CE484222325), ("a", 0x089BE207B544F1E4), ("abc", 0xCEC64E155111225D), ("hello", 0x32964F71B2764B97), ("\U0001f600", 0xF39A100FB654058A)],
)
def test_fnv_golden(value, utf16):
    assert int(kernels.fnv1a64([value.encode("utf-16-le")])[0]) == utf16


def test_fnv_matches_the_definition_for_mixed_lengths():
    rng = random.Random(1)
    values = [bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(200)]

    def plain(v):
        h = 0xCBF29CE484222325
        for b in v:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    assert kernels.fnv1a64(values).tolist() == [plain(v) for v in values]


def test_xxh64_golden(spark):
    rows = spark.createDataFrame([("",), ("a",), ("abc",), ("hello",)], "t string")
    got = [r.h for r in rows.select(text.u64_hex(kernels.xxh64_utf8(F.col("t"))).alias("h")).collect()]
    assert got == ["ef46db3751d8e999", "d24ec4f1a98c6e5b", "44bc2cf5ad770999", "26c7827d889f6da3"]


def test_words_tile_and_agree_with_the_general_kernel(spark, odd):
    rows = odd.where("doc_id <> 6 and text is not null").select("text", text.words(F.col("text")).alias("a"), kernels.words_any(F.col("text")).alias("b")).collect()
    for r in rows:
        assert "".join(r.a) == r.text == "".join(r.b)
    assert rows[0].a[:5] == ["Alpha", " ", "alpha", ",", " "] and "it's" in rows[0].a and "3.14" in rows[0].a and "so_so" in rows[0].a


def test_scans(spark, odd):
    r = odd.where("doc_id = 6").select(
        text.has_bidi_controls(F.col("text")).alias("bidi"), *[text.count_class(F.col("text"), c).alias(k) for k, c in text.INTEGRITY_KINDS.items()], text.is_ijson(F.col("text")).alias("ijson")
    ).first()
    assert (r.bidi, r.bidi_control, r.default_ignorable, r.noncharacter, r.ijson) == (True, 1, 2, 1, False)


def test_envelopes_round_trip(spark, odd):
    back = odd.where("text is not null").select("text", protocol.decode_envelope(protocol.encode_envelope(F.col("text"))).alias("back")).collect()
    assert all(r.text == r.back for r in back)


def test_code_units(spark):
    assert one(spark, text.code_units(F.lit("\U0001f600x"))) == 3


def test_spans_count_code_units(spark):
    docs = spark.createDataFrame([(1, "\U0001f600 ab")], "doc_id long, text string")
    got = [tuple(r) for r in tokens.spans(docs, repertoire="any").orderBy("tok_idx").collect()]
    assert got == [(1, 0, 0, 2, "\U0001f600"), (1, 1, 2, 3, " "), (1, 2, 3, 5, "ab")]


def test_facts_of_odd_texts(spark, odd):
    assert facts.word_ngrams(odd.where("doc_id = 5"), 2).collect()[0][:] == ("a b", 3)
    pairs = {(r.a, r.b): r["count"] for r in facts.word_cooccurrence(odd.where("doc_id = 5"), 3).collect()}
    assert pairs == {("a", "b"): 8, ("a", "a"): 2, ("b", "b"): 2}
    assert facts.repetition(odd).collect()[0].doc_id == 5
    assert {r.key: r.forms for r in variants.variant_index(odd).collect()}["alpha"] == 2
    assert packs.analyze_corpus(odd).first().documents == 6
    with pytest.raises(Exception, match="CORPUS_TOO_LARGE"):
        packs.analyze_corpus(odd, limit_code_units=5).collect()


def test_winnowing():
    same = np.full(10, 7, np.uint64)
    assert fingerprint.winnow(same, 4) == [3, 4, 5, 6, 7, 8, 9]
    assert fingerprint.winnow(same, 4, "by-hash") == [3, 7]
    assert fingerprint.winnow(same[:3], 4) == []
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 200, dtype=np.uint64)
    picked = set(fingerprint.winnow(h, 6))
    assert all(any(i in picked for i in range(s, s + 6)) for s in range(195))


def test_diff_is_least_and_rebuilds():
    assert [r[0] for r in diff.edit_script(list("abc"), list("acd"))[0]] == ["equal", "delete", "equal", "insert"]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        for prefer in ("delete", "insert"):
            runs, cut = diff.edit_script(a, b, prefer)
            assert not cut or prefer == "insert"
            made, kept = [], 0
            for op, a0, a1, b0, b1 in runs:
                made += a[a0:a1] if op == "equal" else b[b0:b1] if op == "insert" else []
                kept += a1 - a0 if op == "equal" else 0
            assert made == b
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            assert kept == best[-1][-1] if prefer == "delete" else kept <= best[-1][-1]
    assert diff.edit_script(list("ab"), list("cd"), max_d=1) == ([("delete", 0, 2, 0, 0), ("insert", 2, 2, 0, 2)], True)


def test_canonical_json():
    assert kernels.jcs({"b": [1e30, 4.5, 2e-3, 1e-7, 333333333.33333329, 0.0, -0.0], "a": None, "€": True, "\U0001f600": "\x0f\n"}) == (
        '{"a":null,"b":[1e+30,4.5,0.002,1e-7,333333333.3333333,0,0],"€":true,"\U0001f600":"\\u000f\\n"}'
    )
    with pytest.raises(ValueError, match="NON_FINITE"):
        kernels.jcs(float("nan"))


def test_normal_forms_and_punycode(spark):
    rows = spark.createDataFrame([("é",), ("ﬁ",), (None,), ("bücher",)], "t string")
    t = F.col("t")
    got = rows.select(kernels.normalize(t, "NFC").alias("c"), kernels.nfkc_case_fold(t).alias("k"), kernels.punycode_encode(t).alias("p"), kernels.punycode_decode(kernels.punycode_encode(t)).alias("q"), kernels.graphemes(t).alias("g")).collect()
    assert [r.c for r in got] == ["é", "ﬁ", None, "bücher"] and got[1].k == "fi"
    assert got[3].p == "bcher-kva" and [r.q for r in got] == ["é", "ﬁ", None, "bücher"] and got[0].g == ["é"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode())
    (tmp_path / "b.txt").write_bytes(b"ok")
    got = {r.doc_id.rpartition("/")[2]: r.text for r in documents.from_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "naïve", "b.txt": "ok"}
    assert one(spark, documents.decode_utf8(F.lit(b"\xff"), strict=False)) is None
    docs = spark.createDataFrame([(1, "x"), (2, " "), (3, "x"), (4, None)], "n long, doc_id string")
    assert [r.doc_id for r in documents.with_ids(docs, "n").orderBy("n").collect()] == ["x", "doc-1", "x#2", "doc-2"]


@pytest.mark.parametrize(
    ("whole", "parts"),
    [
        ("One. Two? Three", ["One. ", "Two? ", "Three"]), ("It is 3.4 now. no break. Break", ["It is 3.4 now. no break. ", "Break"]), ("U.S.A. is\nnext", ["U.S.A. is\n", "next"]),
        ("He said (yes.) Then", ["He said (yes.) ", "Then"]), ("", []), ("a\r\nb", ["a\r\n", "b"]), ("Wait... what?! Yes", ["Wait... what?! ", "Yes"]),
    ],
)
def test_sentences(whole, parts):
    assert kernels.split_sentences(whole) == parts


def test_provenance(spark):
    from spanloom.functions import provenance as p

    assert p.fnv1a32("") == "fnv1a32:811c9dc5"
    assert p.config_hash({"b": float("inf"), "a": 1}) == p.fnv1a32('{"a":1,"b":null}')
    block = p.provenance("words", "UAX #29", "17.0.0", {"filter": "all"})
    assert one(spark, p.literal(block)).algorithm.spec == "UAX #29"


OTHER = ["Łódź łódź ŁÓDŹ", "Привет, мир! привет", "Ὀδυσσεύς ΟΔΥΣΣΕΎΣ 3.14", "مرحبا بالعالم", "cafe\u0301 e\u0301 ok", "\U0001f468\u200d\U0001f469\u200d\U0001f467 ab\u2014cd", "plain it's\r\nrow", "µm カタカナ 漢字"]


def test_tokens_of_every_script(spark):
    docs = spark.createDataFrame(list(enumerate(OTHER)), "doc_id long, text string")
    words = [
        ["Łódź", "łódź", "ŁÓDŹ"], ["Привет", "мир", "привет"], ["Ὀδυσσεύς", "ΟΔΥΣΣΕΎΣ", "3.14"], ["مرحبا", "بالعالم"], ["cafe\u0301", "e\u0301", "ok"], ["ab", "cd"], ["plain", "it's", "row"], ["µm", "カタカナ"],
    ]
    flat = [w for ws in words for w in ws]
    assert {r.doc_id: r.words for r in tokens.word_arrays(docs).collect()} == dict(enumerate(words))
    assert {r.token: r["count"] for r in facts.word_frequencies(docs, None).collect()} == {w: flat.count(w) for w in flat}
    assert {r.gram for r in facts.word_ngrams(docs, 2, None).collect()} == {f"{a} {b}" for ws in words for a, b in zip(ws, ws[1:], strict=False)}
    assert {r.doc_id: r.word_tokens for r in facts.word_totals(docs).collect()} == {i: len(ws) for i, ws in enumerate(words)}
    graphemes = {0: 14, 1: 19, 2: 22, 3: 13, 4: 9, 5: 7, 6: 14, 7: 10}
    assert {r.doc_id: r.graphemes for r in facts.grapheme_counts(docs).collect()} == graphemes
    assert {r.doc_id: (r.words, r.graphemes) for r in packs.analyze_text(docs).collect()} == {i: (len(ws), graphemes[i]) for i, ws in enumerate(words)}
    keys = {r.key: (r.total, r.forms) for r in variants.variant_index(docs).collect()}
    assert keys["łódź"] == (3, 3) and keys["привет"] == (2, 2) and keys["μm"] == (1, 1) and "οδυσσεύσ" in keys
    assert {r.raw for r in tokens.tokens(docs, tokenizer="code_point").where("doc_id = 1").collect()} == set("Приветмпрп")
    pair = spark.createDataFrame([("старый мир здесь", "новый мир здесь")], "a string, b string")
    r = diff.diff_texts(pair).first()
    assert (r.a_tokens, r.b_tokens, r.equal, r.deleted, r.inserted) == (5, 5, 4, 1, 1)
    long = spark.createDataFrame([(1, " ".join(f"слово{i}" for i in range(20)))], "doc_id long, text string")
    assert fingerprint.fingerprints(long).collect() == fingerprint.fingerprints(long, repertoire="any").collect() != []


def test_streamed_words_of_every_script(spark, tmp_path):
    from spanloom.streaming import facts as streaming

    spark.createDataFrame([("Łódź мир мир",), ("plain",)], "text string").write.parquet(f"{tmp_path}/in")
    counts = streaming.word_counts(spark.readStream.schema("text string").parquet(f"{tmp_path}/in"))
    assert {r.token: r["count"] for r in streaming.drain(spark, counts, uuid.uuid4().hex).collect()} == {"Łódź": 1, "мир": 2, "plain": 1}
