"""Packs, diffs, fingerprint indexes, schemas and chunk streams."""

import json
import random
import unicodedata
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import kernels, pack, protocol
from spanloom.operators import diff, fingerprint, packs
from spanloom.plans import registry
from spanloom.streaming import chunks


def digest(value):
    import hashlib

    return f"sha256:{hashlib.sha256(kernels.jcs(value).encode()).hexdigest()}"


def test_public_interchange_digests():
    """Digests that other implementations of the exchange formats publish for the same inputs."""
    hidden = protocol.open_envelope({"v": 1, "kind": "utf16le-base64", "base64": "QQANIGAgLiAP/tD9QgA="})
    assert digest({"profile": pack.integrity_profile(hidden)}) == "sha256:2017c5fecae79a0c4ee8aa461a89c40d6bf7d7b473fa0a57063252b0c69d4651"


def test_ratios_and_overlap():
    assert pack.ratio(0, 0) == {"num": "0", "den": "1"}
    r = pack.compare("a b c d e f g h i j", "a b c d e f g h x y", k=1, window=1, dedupe="none")["fingerprints"]
    assert r["overlapCount"] == "9" and r["jaccard"] == {"num": "9", "den": "13"} and r["containmentAinB"] == {"num": "9", "den": "11"}


def test_winnowing_orders_and_caps():
    rows, cut = pack.winnowing("alpha beta alpha beta gamma " * 20, 3, 4, "by-position", most=5)
    assert cut and len(rows) == 5 and [r["tokenIndex"] for r in rows] == sorted(r["tokenIndex"] for r in rows)
    assert pack.winnowing("one two", 5, 4) == ([], False)
    whole, _ = pack.winnowing("Alpha BETA " * 30, 2, 2, key="nfkcCaseFold")
    lower, _ = pack.winnowing("alpha beta " * 30, 2, 2, key="nfkcCaseFold")
    assert [r["hash64Hex"] for r in whole] == [r["hash64Hex"] for r in lower]


def test_packs_of_odd_texts(spark):
    texts = ["Hello world", "", "👩🏽‍💻 emoji ZWJ", "ABC ‮DEF‬", "x﷐", "One. Two. One. Two."]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "doc_id long, text string")
    options = {"includeInputText": True, "maxSpans": 3, "sections": {"security": True, "variants": True, "profile": True, "fingerprint": True}}
    for r in docs.select("text", packs.pack_v1(F.col("text"), options).alias("p")).collect():
        if r.text is None:
            assert r.p.json is None
            continue
        p = json.loads(r.p.json)
        assert p == json.loads(kernels.jcs(pack.pack_v1(r.text, options))) and digest(p) == r.p.sha256
        assert protocol.open_envelope(p["input"]["text"]) == r.text and p["segment"]["words"]["count"] >= len(p["segment"]["words"]["spans"])
    full = {"ngrams": {"n": 2}, "cooccurrence": {"windowSize": 3}, "includeRepetition": True, "includeDuplicateSentences": True, "includeBoundaries": True, "maxOutputBytes": 10}
    f = pack.fact_pack("One. Two. One. Two.", full | {"variants": {"canonicalKey": "nfkcCaseFold"}, "profile": {"ngrams": {"sizes": [2]}, "lengthBins": [1, 4]}, "fingerprint": {"k": 2, "window": 2}})
    assert [(i["text"], i["count"]) for i in f["repetition"]["duplicateSentences"]["items"]] == [("One. ", 2)]
    assert f["size"]["exceedsMax"] and f["ngrams"]["words"]["totalNgrams"] == f["frequencies"]["words"]["totalTokens"] - 1
    assert f["display"]["lineBreaks"]["mandatory"] == 1 and f["display"]["bidi"]["paragraphLevel"] == 0
    with pytest.raises(ValueError, match="FULL_MODE"):
        pack.fact_pack("abc", {"fullModeInputLimit": 2})
    assert pack.fact_pack("abc", {"fullModeInputLimit": 2, "mode": "lean"})["summary"]["codeUnits"] == 3


def test_corpus_pack(spark):
    docs = spark.createDataFrame([(1, "a b a b. a b."), (2, "Łódź a b"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.section, r.item): r["count"] for r in packs.corpus_pack(docs).collect()}
    assert got["summary", "documents"] == 4 and got["words", "a"] == 4 and got["ngrams", "a b"] == 4 and got["summary", "words"] == 9
    assert got["display", "left_to_right"] == 3 and got["safety", "control_chars"] == 0
    with pytest.raises(ValueError, match="CORPUS_TOO_LARGE"):
        packs.corpus_pack(docs, limit_code_units=5)


def test_text_diffs(spark):
    pairs = spark.createDataFrame([(1, "Alpha beta gamma", "Alpha gamma delta"), (2, None, "x"), (3, "same", "same")], "id long, a string, b string")
    got = {r.id: json.loads(r.diff) for r in diff.text_diffs(pairs).collect()}
    assert got[1]["summary"] == {"deletedTokens": 2, "equalTokens": 3, "insertedTokens": 2} and [e["op"] for e in got[3]["edits"]] == ["equal"]
    assert got[1]["edits"][0]["aSpans"][0] == {"startCU": 0, "endCU": 5} and got[2]["aTokens"] == 0
    c = {r.id: r for r in diff.compare_texts(pairs, k=1, window=1, dedupe="none").collect()}
    assert (c[1].overlap, c[1].jaccard_num, c[1].jaccard_den, c[1].equal) == (3, 3, 5, 3) and (c[2].jaccard_num, c[2].a_in_b_den) == (0, 1)


def test_long_diffs_are_least():
    rng = random.Random(6)
    a = [rng.choice("abcdefgh") for _ in range(700)]
    b = [x for x in a if rng.random() > 0.1]
    for i in range(40):
        b.insert(rng.randrange(len(b)), "z")
    runs, cut = diff.edit_script(a, b)
    made, kept = [], 0
    for op, a0, a1, b0, b1 in runs:
        made += a[a0:a1] if op == "equal" else b[b0:b1] if op == "insert" else []
        kept += a1 - a0 if op == "equal" else 0
    best = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
        best = row
    assert made == b and kept == best[-1] and not cut
    far, _ = diff.edit_script([f"a{i}" for i in range(1500)], [f"b{i}" for i in range(1500)])
    assert far == [("delete", 0, 1500, 0, 0), ("insert", 1500, 1500, 0, 1500)]


def test_fingerprint_index(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more words here"), (3, "short"), (4, None)], "doc_id long, text string")
    prints = fingerprint.fingerprints(docs)
    lists = fingerprint.posting_lists(prints, most=1).collect()
    assert any(r.documents == 2 and r.ids == [1] and r.truncated for r in lists)
    assert {r.kgrams for r in fingerprint.verified_buckets(docs).collect()} == {1}
    pairs = fingerprint.overlap(prints.where("doc_id = 2"), prints.where("doc_id = 1").withColumnRenamed("doc_id", "item_id")).collect()
    assert pairs[0].containment_num == pairs[0].containment_den and pairs[0].containment_back_num < pairs[0].containment_back_den
    # a plain version of the polynomial and the windows
    words = [x for i, w in enumerate(text.split()) for x in ([" "] if i else []) + [w]]
    import xxhash

    h = [xxhash.xxh64_intdigest(w.encode()) for w in words]
    s = []
    for i in range(len(h) - 4):
        v = 0
        for x in h[i : i + 5]:
            v = (v * 0x9E3779B185EBCA87 + x) % 2**64
        s.append(v)
    want = {max(range(i, i + 4), key=lambda j: (-s[j], j)) for i in range(len(s) - 3)}
    assert {r.tok_idx for r in fingerprint.fingerprints(docs, dedupe="by-position").where("doc_id = 1").collect()} == want and np.uint64(s[0]) >= 0


def test_registry():
    assert set(registry.SCHEMAS) == {"text-envelope-v1", "pack-v1", "idna-result-v1", "uts46-options-v1"} and len(registry.list_tool_specs()) == 9
    with pytest.raises(ValueError, match="TARGET"):
        registry.json_schema("pack-v1", "draft-07")
    for spec in registry.list_tool_specs():
        module, _, name = spec["operator"].rpartition(".")
        assert callable(getattr(__import__(module, fromlist=[name]), name))
        assert set(registry.to_mcp_tool(spec)) == {"name", "description", "inputSchema", "outputSchema"}
    made = pack.pack_v1("Hello", {"includeInputText": True})
    assert set(made) <= set(registry.json_schema("pack-v1")["properties"])


ODD = ["é", "각", "ạ̇̂b", "ﬁ", "ୋ", "plain text", "क़", "각"]


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_chunked_normalization_equals_the_whole(form):
    rng = random.Random(1)
    for _ in range(300):
        whole = "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 6)))
        n, out, i = chunks.Normalizer(form), "", 0
        raw = whole.encode()
        while i < len(raw):
            step = rng.randrange(1, 4)
            out += n.feed(raw[i : i + step])
            i += step
        assert out + n.finish() == unicodedata.normalize(form, whole)


def test_chunks_in_batch_and_stream(spark, tmp_path):
    rows = [("s", 0, "cafe", False), ("s", 1, "́ au", False), ("s", 2, " lait", True), ("t", 0, "ᄀ", False), ("t", 1, "ᅡ", True)]
    table = spark.createDataFrame(rows, "stream_id string, chunk_no long, chunk string, last boolean")
    joined = lambda df: {k: "".join(r.output for r in sorted(rs, key=lambda r: r.chunk_no)) for k, rs in __import__("itertools").groupby(sorted(df.collect(), key=lambda r: r.stream_id), key=lambda r: r.stream_id)}
    want = {"s": "café au lait", "t": "가"}
    assert joined(chunks.normalize_chunks(table)) == want
    for i in range(3):
        table.where(f"chunk_no = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"n{uuid.uuid4().hex}"
    query = chunks.normalize_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert joined(spark.table(name)) == want
    assert {r.doc_id: r.text for r in chunks.joined_chunks(table).collect()} == {"s": "café au lait", "t": "가"}
    assert chunks.profile_chunks(table).count() == 2
