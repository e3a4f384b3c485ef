"""Segmentation, line breaking, bidi, IDNA, skeletons, envelopes and hashes against stated results."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import bidi, idna, kernels, linebreak, pack, protocol, security, segment, text, ucd
from spanloom.operators import facts, scan, tokens


def cut(t):
    raw, out, last = segment.to_utf16(t), [], 0
    for at, kind in linebreak.opportunities(t):
        if kind != "prohibited":
            out.append(segment.from_utf16(raw[2 * last : 2 * at]))
            last = at
    return out


def of(spark, rows, column, kind="string"):
    return [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, t {kind}").orderBy("i").select(column.alias("c")).collect()]


@pytest.mark.parametrize("unit", ["a1", "a.", "_", "1,", "a:b'"])
def test_a_token_of_millions_of_characters(spark, unit):
    """The word pattern walks its repeats without recursion."""
    long = unit * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, "two words")], "doc_id long, text string")
    got = {r.token: r["count"] for r in facts.word_frequencies(docs, None, keep="all").collect()}
    assert sum(len(t) * n for t, n in got.items()) == len(long) + 9 and got["two"] == 1


@pytest.mark.parametrize(
    ("line", "parts"),
    [
        ("Hello world, it's $12.50 (or 3-4) ok", ["Hello ", "world, ", "it's ", "$12.50 ", "(or ", "3-4) ", "ok"]), ("one\ntwo\r\nthree", ["one\n", "two\r\n", "three"]),
        ("start-up «quoted text» and “x”!", ["start-", "up ", "«quoted ", "text» ", "and ", "“x”!"]), ("日本語の「はい」。", ["日", "本", "語", "の", "「は", "い」。"]), ("🇫🇷🇩🇪🇯", ["🇫🇷", "🇩🇪", "🇯"]),
        ("👩🏽‍💻 ok", ["👩🏽‍💻 ", "ok"]), ("a​b⁠c", ["a​", "b⁠c"]), ("100 %, 5,000.00€ -5", ["100 ", "%, ", "5,000.00€ ", "-5"]), ("é x", ["é ", "x"]), ("(x) [y]", ["(x) ", "[y]"]),
        ("http://a.b/c", ["http://", "a.b/", "c"]), ("각각", ["각", "각"]), ("a b c", ["a b ", "c"]),
    ],
)
def test_line_breaks(line, parts):
    assert cut(line) == parts


def test_line_break_ends():
    assert linebreak.opportunities("") == [(0, "mandatory")]
    assert linebreak.opportunities("a") == [(0, "prohibited"), (1, "mandatory")]
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice("a1 \n\r-(́‍​日“😀א") for _ in range(rng.randrange(1, 12)))
        found = linebreak.opportunities(t)
        assert len(found) == len(t) + 1 and found[-1] == (segment.code_units(t), "mandatory")
        assert all(k == "mandatory" for (_, k), c in zip(found[1:], t, strict=True) if c == "\n")
        assert all(k != "allowed" for (_, k), c in zip(found, t, strict=False) if c in " \n\r​")


@pytest.mark.parametrize(
    ("line", "direction", "paragraph", "levels"),
    [
        ("abc", "auto", 0, [0, 0, 0]), ("abc", "rtl", 1, [2, 2, 2]), ("אבג", "auto", 1, [1, 1, 1]), ("a אב 12", "auto", 0, [0, 0, 1, 1, 1, 2, 2]), ("אב (a) 1.5!", "auto", 1, [1, 1, 1, 1, 2, 1, 1, 2, 2, 2, 1]),
        ("A ‮DE‬", "auto", 0, [0, 0, 255, 1, 1, 255]), ("a ⁧אב⁩ b", "auto", 0, [0, 0, 0, 1, 1, 0, 0, 0]), ("ب1٢", "auto", 1, [1, 2, 2]), ("a(ב)c", "auto", 0, [0, 0, 1, 0, 0]), ("", "auto", 0, []), ("א ", "ltr", 0, [1, 0]),
    ],
)
def test_bidi_levels(line, direction, paragraph, levels):
    r = bidi.resolve(line, direction)
    assert (r.paragraph, r.levels) == (paragraph, levels)
    assert sorted(r.order) == [i for i, x in enumerate(levels) if x != 255]


def test_bidi_order_and_brackets():
    t = "abc אבג 123 def"
    assert "".join(t[i] for i in bidi.resolve(t).order) == "abc 123 גבא def"
    assert bidi.bracket("(") == ("open", ")") and bidi.bracket("]") == ("close", "]") and bidi.bracket("x") is None and bidi.bracket("༺") == ("open", "༻")
    assert bidi.mixed(bidi.resolve(t).levels) and not bidi.mixed(bidi.resolve("abc").levels)
    assert [r.paragraph for r in [bidi.resolve("⁧א⁩ a")]] == [0]


@pytest.mark.parametrize(
    ("domain", "ascii_form", "codes"),
    [
        ("Example.COM", "example.com", []), ("bücher.de", "xn--bcher-kva.de", []), ("faß.de", "xn--fa-hia.de", []), ("xn--bcher-kva.de", "xn--bcher-kva.de", []), ("a。b", "a.b", []), ("אב.com", "xn--4dbc.com", []),
        ("1אב.com", "xn--1-0hcd.com", ["BIDI_RULE"]), ("a‍b.com", "xn--ab-m1t.com", ["CONTEXTJ"]), ("a_b.com", "a_b.com", ["STD3_DISALLOWED"]), ("-a.b", "-a.b", ["LEADING_HYPHEN"]), ("a..b", "a..b", ["EMPTY_LABEL"]),
        ("ab--c.d", "ab--c.d", ["HYPHEN_3_4"]), ("a" * 64 + ".b", "a" * 64 + ".b", ["LABEL_TOO_LONG"]), ("l·l.cat", "xn--ll-0ea.cat", []), ("a·b.cat", "xn--ab-0ea.cat", ["CONTEXTO"]),
    ],
)
def test_idna(domain, ascii_form, codes):
    r = idna.to_ascii(domain)
    assert (r["value"], [e["code"] for e in r["errors"]], r["ok"]) == (ascii_form, codes, not codes)
    if not codes:
        assert idna.to_ascii(idna.to_unicode(domain)["value"])["value"] == ascii_form


def test_idna_columns(spark):
    got = of(spark, ["Bücher.de", None, "x﷐"], idna.uts46_to_ascii(F.col("t")))
    assert got[0].value == "xn--bcher-kva.de" and got[0].warnings == ["MAPPED"] and got[1].value is None and got[2].errors[0] == "NONCHARACTER"
    assert of(spark, ["ＡＢ．com"], idna.uts46_map(F.col("t")))[0].value == "ab.com"


def test_properties(spark):
    assert ucd.lookup("Line_Break")[ord("a")] == "AL" and ucd.script()[0x3B1] == "Greek" and ucd.lookup("Bidi_Class")[0x5D0] == "R"
    assert ucd.token_scripts("Αlpha") == ["Greek", "Latin"] and ucd.token_scripts("...") == ["Common"] and ucd.token_scripts("") == []
    assert len(ucd.script_names()) > 170 and "Old_Italic" in ucd.script_names()
    assert of(spark, ["a", "א", "", None], ucd.of(F.col("t"), "script")) == ["Latin", "Hebrew", None, None]
    assert of(spark, ["‍", "a", None], ucd.has(F.col("t"), "join_control")) == [True, False, None]
    assert of(spark, ["Αlpha", "alpha"], ucd.mixed_script(F.col("t"))) == [True, False]
    for name, yes, no in (("default_ignorable", "­", "a"), ("variation_selector", "️", "a"), ("noncharacter", "﷐", "a"), ("extended_pictographic", "😀", "a"), ("east_asian_wide", "日", "a"), ("mark", "́", "a"), ("initial_punctuation", "«", "»"), ("final_punctuation", "»", "«"), ("common_or_inherited", ".", "a"), ("unassigned", "͸", "a")):
        assert ucd.predicate(name)[ord(yes)] and not ucd.predicate(name)[ord(no)]


def test_skeletons(spark):
    table = security.prototypes(spark)
    assert table.of("paypaI") == "paypai" and table.of("Аlpha") == table.of("Alpha") == table.of("Αlpha")
    assert of(spark, ["раураl", None], security.is_confusable(F.col("t"), F.lit("paypal"), table))[0] is True
    status, mask, types = security.identifier_of(ord("a"), security.identifier_properties(spark))
    assert (status, types) == ("Allowed", ["Recommended"]) and mask == 1 << 11
    r = of(spark, ["ª"], security.identifier(F.col("t"), security.identifier_properties(spark)))[0]
    assert (r.status, r.type) == ("Restricted", "Not_NFKC")


def test_security_facts(spark):
    docs = spark.createDataFrame([(1, "Alpha Αlpha Аlpha beta beta"), (2, ""), (3, None)], "doc_id long, text string")
    table = security.prototypes(spark)
    got = {r.doc_id: tuple(r)[1:] for r in scan.security_facts(docs, table).collect()}
    assert got == {1: (5, 2, 1), 2: (0, 0, 0), 3: (0, 0, 0)}
    top = scan.skeleton_collisions(docs, table).collect()
    assert [(r.total, r.forms) for r in top] == [(3, 3)]


def test_findings(spark):
    raw = segment.to_utf16("A‍⁠‮️﷐B") + b"\x00\xd8"
    docs = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b""))], "doc_id long, text binary")
    kinds = [r.kind for r in scan.integrity_findings(docs).orderBy("place").collect()]
    assert kinds == ["default-ignorable", "join-control", "default-ignorable", "default-ignorable", "bidi-control", "default-ignorable", "variation-selector", "noncharacter", "lone-surrogate"]
    assert scan.integrity_findings(docs, ("bidi-control", "noncharacter")).count() == 2 and scan.integrity_findings(docs, most=2).count() == 2
    assert {r.kind: r["count"] for r in scan.integrity_samples(docs, 1).collect()}["default-ignorable"] == 4
    assert scan.ijson_violations(docs).count() == 2
    assert of(spark, [bytearray(raw)], protocol.is_well_formed(F.col("t")), "binary") == [False]
    assert of(spark, [bytearray(raw)], protocol.to_well_formed(F.col("t")), "binary")[0].endswith("B�")
    assert of(spark, [bytearray(raw)], protocol.lone_surrogates(F.col("t")), "binary")[0][0].kind == "high"


def test_envelopes(spark):
    texts = ["ab", "x﷐", "😀", "", None]
    for kind in protocol.KINDS:
        for other in protocol.KINDS:
            made = protocol.encode_envelope(F.col("t"), kind, other)
            assert of(spark, texts, protocol.decode_envelope(made)) == texts
            for t in texts[:4]:
                e = protocol.envelope(t, kind, other)
                assert protocol.open_envelope(e) == t
    lone = "a\ud800"
    assert protocol.envelope(lone)["kind"] == "utf16-code-units" and protocol.envelope(lone, "utf8-base64", "utf16le-base64")["kind"] == "utf16le-base64"
    for bad in ({"v": 2, "kind": "string", "text": "a"}, {"v": 1, "kind": "x"}, {"v": 1, "kind": "utf8-base64", "base64": "YQ"}, {"v": 1, "kind": "utf16-code-units", "codeUnits": [70000]}):
        with pytest.raises(ValueError, match="PROTOCOL_INVALID_ENVELOPE"):
            protocol.open_envelope(bad)
    assert of(spark, ["YQ==", "YQ=", "Y Q=", "", None], protocol.base64_decode(F.col("t"), strict=False)) == [bytearray(b"a"), None, None, bytearray(b""), None]
    with pytest.raises(Exception, match="BASE64_INVALID"):
        of(spark, ["YQ"], protocol.base64_decode(F.col("t")))


def test_spans_and_hashes(spark):
    assert of(spark, ["a😀bc"], protocol.slice_by_span(F.col("t"), F.lit(1), F.lit(4))) == ["😀b"]
    assert of(spark, ["abc"], text.u64_hex(kernels.hash64(F.col("t")))) == ["44bc2cf5ad770999"]
    assert of(spark, ["xabcx"], text.u64_hex(kernels.hash64_span(F.col("t"), F.lit(1), F.lit(4), "fnv1a64-utf16le"))) == ["cec64e155111225d"]
    assert of(spark, ["collision probe"], kernels.hash128_hex(F.col("t"))) == ["fd8855f76810c1b123ffca9476905efe"]
    assert of(spark, ["44bc2cf5ad770999", "ffffffffffffffff", "x"], kernels.parse_u64_hex(F.col("t"))) == [0x44BC2CF5AD770999, -1, None]
    assert of(spark, ["fd8855f76810c1b123ffca9476905efe"], kernels.parse_hash128_hex(F.col("t")))[0].right == 0x23FFCA9476905EFE
    with pytest.raises(ValueError, match="SEED"):
        kernels.hash64(F.col("t"), "fnv1a64-utf8", 1)


def test_json():
    for bad in ("﷐", "\ud800", {"￿": 1}):
        with pytest.raises(ValueError, match="IJSON"):
            kernels.jcs(bad)
    assert kernels.jcs({"aa": 1, "a": 2, "a\0": 3}) == '{"a":2,"a\\u0000":3,"aa":1}'
    loop: list = []
    loop.append(loop)
    with pytest.raises(ValueError, match="CYCLE"):
        kernels.assert_ijson(loop)
    assert kernels.canonical_json({"b": {2, 1}, "a": float("nan"), "c": 2**70, "d": b"\x01", "e": len}) == '{"a":null,"b":[1,2],"c":"1180591620717411303424","d":[1]}'


def test_normalization_stages(spark):
    r = of(spark, ["ệ", None], kernels.explain_normalization(F.col("t"), "NFC"))
    assert r[0].output == "ệ" and r[0].decomposed == [0x65, 0x323, 0x302] and r[0].composed == [0x1EC7] and r[1].output is None


def test_tokens_for_comparison(spark):
    docs = spark.createDataFrame([(1, "Straße STRASSE"), (2, None)], "doc_id long, text string")
    got = scan.comparison_tokens(docs, key="nfkcCaseFold").collect()
    assert [r.key for r in got] == ["strasse", " ", "strasse"] and got[0].key_hash == got[2].key_hash
    assert len(scan.comparison_tokens(docs, "anything else", most=4).collect()) == 4
    assert scan.comparison_tokens(docs, materialize="none").columns == ["doc_id", "tok_idx", "start_cu", "end_cu", "key_hash"]
    halves = scan.scan_tokens(docs, "custom", custom=lambda t: [(0, 6), (7, 14)]).collect()
    assert [r.raw for r in halves] == ["Straße", "STRASSE"]
    assert [r.raw for r in scan.segment_spans(docs, "word", 2).collect()] == ["Straße", " "]
    with pytest.raises(ValueError, match="custom"):
        pack.tokenize("a", "custom")


def test_ids_over_ranges(spark):
    from spanloom.sources.documents import with_ids

    rows = [(i, "" if i % 3 else f"id{i % 6}") for i in range(300)]
    got = {r.n: r.doc_id for r in with_ids(spark.createDataFrame(rows, "n long, doc_id string").repartition(5), "n").collect()}
    blank = [i for i, x in rows if not x]
    assert [got[i] for i in blank] == [f"doc-{k}" for k in range(1, len(blank) + 1)]
    assert got[0] == "id0" and got[6] == "id0#2" and got[3] == "id3" and len(set(got.values())) == 300


def test_variants(spark):
    docs = spark.createDataFrame([(1, "Alpha alpha Αlpha ALPHA alpha")], "doc_id long, text string")
    rows = scan.document_variants(docs, table=security.prototypes(spark)).collect()
    assert (rows[0].key, rows[0].total, [f.form for f in rows[0].forms], rows[0].mixed_script) == ("alpha", 4, ["alpha", "ALPHA", "Alpha"], False)
    assert rows[1].mixed_script and rows[1].scripts == ["Greek:1", "Latin:1"]
    assert [(s.start_cu, s.end_cu) for s in rows[0].forms[0].spans] == [(6, 11), (24, 29)]
    assert len(scan.document_variants(docs, most=1).collect()) == 1 and tokens.tokens(docs).count() == 5
