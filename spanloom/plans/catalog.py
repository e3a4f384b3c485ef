"""The registered queries of the engine and their equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions import idna, kernels, protocol, security, text
from spanloom.operators import diff, facts, fingerprint, packs, profile, scan, tokens, variants
from spanloom.sources.documents import spread
from spanloom.streaming import facts as streaming

Query = Callable[[SparkSession, str], DataFrame]


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_docs = _table("documents")


def _over_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spread(_docs(spark, sf_dir)))


def _streaming_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = _docs(spark, sf_dir)
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/documents.parquet*")
    return streaming.drain(spark, streaming.word_counts(stream), uuid.uuid4().hex[:8])


FNV = "fnv1a64-utf8"


def _by_position(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    return fingerprint.fingerprints(docs, dedupe="by-position", algo=FNV, id_column=id_column)


def _benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _by_position(_table("benchmark")(spark, sf_dir), "item_id")
    return fingerprint.overlap(_by_position(spread(_docs(spark, sf_dir))), items)


def _posting_lists(docs: DataFrame) -> DataFrame:
    found = fingerprint.posting_lists(_by_position(docs), most=20)
    return found.select(text.u64_hex(F.col("hash")).alias("hash"), "documents", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "truncated")


def _with_table(f: Callable[[DataFrame, security.Skeletons], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(spread(_docs(spark, sf_dir)), security.prototypes(spark))


def _scanned(docs: DataFrame) -> DataFrame:
    found = scan.scan_tokens(docs, canonicalize="nfkcCaseFold", keep="word-like")
    return found.withColumn("scripts", F.array_join("scripts", " "))


def _integrity_wide(docs: DataFrame) -> DataFrame:
    """Findings of documents into which the characters of each kind are written."""
    planted = docs.select("doc_id", F.concat(F.substring("text", 1, 5), F.lit("\u00ad\u202e\u200d\ufe0f\ufdd0"), F.col("text")).alias("text"))
    return scan.integrity_findings(planted)


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table("conversations")(spark, sf_dir)
    order = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("text").over(order).alias("a"), F.col("text").alias("b")).where("a is not null")


def _envelope_kinds(docs: DataFrame) -> DataFrame:
    """Each text in an envelope of each kind, and whether it comes back."""
    made = F.array(*[F.struct(F.lit(k).alias("kind"), protocol.encode_envelope(F.col("text"), k).alias("e")) for k in protocol.KINDS])
    rows = docs.select("doc_id", "text", F.explode(made).alias("x"))
    return rows.select("doc_id", F.col("x.e.kind").alias("kind"), (protocol.decode_envelope(F.col("x.e")) == F.col("text")).alias("same"), F.length("x.e.base64").cast("long").alias("base64_length"), F.size("x.e.code_units").cast("long").alias("units"))


def _hosts_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _table("pages")(spark, sf_dir).select(text.host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = hosts.select("host", "pages", idna.uts46_to_ascii(F.col("host")).alias("r"), idna.uts46_to_unicode(F.col("host")).alias("u"))
    return found.select("host", "pages", F.col("r.ok").alias("ok"), F.col("r.value").alias("ascii"), F.col("u.value").alias("unicode"))


def _bidi_facts(docs: DataFrame) -> DataFrame:
    return packs.display_facts(docs, lines=False).select("doc_id", "bidi_runs", "paragraph_level", "mixed_direction", "bidi_controls")


def _compare_en_fr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return profile.compare_profiles(docs.where("lang = 'en'"), docs.where("lang = 'fr'"))


def _diff_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_texts(spread(_turn_pairs(spark, sf_dir)))


def _envelopes(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text", protocol.encode_envelope(F.col("text")).alias("e"))
    back = protocol.decode_envelope(F.col("e"))
    return rows.select("doc_id", F.col("e.kind").alias("kind"), (back == F.col("text")).alias("same"), text.sha256_text(back).alias("sha256"))


def _token_hashes(docs: DataFrame) -> DataFrame:
    words = tokens.word_counts(docs).select(F.col("raw").alias("token"))
    left, right = kernels.fnv1a64_utf16(F.col("token")), kernels.fnv1a64_utf8(F.col("token"))
    return words.select("token", text.u64_hex(left).alias("fnv_utf16"), text.u64_hex(right).alias("fnv_utf8"), F.concat(text.u64_hex(left), text.u64_hex(right)).alias("hash128"))


def _xxh64_tokens(docs: DataFrame) -> DataFrame:
    words = tokens.word_counts(docs).select(F.col("raw").alias("token"))
    return words.select("token", text.u64_hex(kernels.xxh64_utf8(F.col("token"))).alias("xxh64"))


def _casefolded(docs: DataFrame) -> DataFrame:
    forms = tokens.word_counts(docs).withColumnRenamed("count", "n")
    folded = forms.groupBy(tokens.case_fold(F.col("raw")).alias("token")).agg(F.sum("n").alias("count"))
    return facts.top(folded, 50, ["token"])


def _punycode_words(docs: DataFrame) -> DataFrame:
    words = tokens.word_counts(docs).select(F.col("raw").alias("token")).where("token rlike '[^\\\\x00-\\\\x7F]'")
    rows = words.withColumn("punycode", kernels.punycode_encode(F.col("token")))
    return rows.withColumn("back", kernels.punycode_decode(F.col("punycode")) == F.col("token"))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _table("pages")(spark, sf_dir).select(text.ascii_host(text.host_of(F.col("url"))).alias("host"))
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


def _events_jcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table("events")(spark, sf_dir)
    return events.select("event_id", kernels.jcs_of_json(F.col("props")).alias("jcs")).withColumn("sha256", F.sha2("jcs", 256))


PACK_OPTIONS = {"includeInputText": False, "maxSpans": 20, "sections": {"security": True, "variants": True, "fingerprint": True}}
FACT_OPTIONS = {"ngrams": {"n": 2, "minCount": 2}, "cooccurrence": {"windowSize": 3}, "includeRepetition": True, "includeDuplicateSentences": True, "allowUnsafeFullMode": True}

QUERIES: dict[str, Query] = {
    "text_summary": _over_documents(profile.summary),
    "word_frequencies": _over_documents(facts.word_frequencies),
    "word_frequencies_by_lang": _over_documents(lambda d: facts.word_frequencies(d, 20, within=["lang"])),
    "all_token_frequencies": _over_documents(lambda d: facts.word_frequencies(d, 50, keep="all")),
    "word_totals": _over_documents(facts.word_totals),
    "word_ngrams_2": _over_documents(lambda d: facts.word_ngrams(d, 2)),
    "word_ngrams_3": _over_documents(lambda d: facts.word_ngrams(d, 3)),
    "word_cooccurrence_w3": _over_documents(facts.word_cooccurrence),
    "repetition_2": _over_documents(facts.repetition),
    "char_ngrams": _over_documents(facts.char_ngrams),
    "word_length_histogram": _over_documents(facts.word_length_histogram),
    "duplicate_lines": _over_documents(facts.duplicate_lines),
    "grapheme_counts": _over_documents(facts.grapheme_counts),
    "general_categories": _over_documents(profile.general_categories),
    "punctuation_whitespace": _over_documents(profile.punctuation_whitespace),
    "safety_scan": _over_documents(profile.safety),
    "integrity_counts": _over_documents(profile.integrity),
    "normalization_flags": _over_documents(profile.normalization_flags),
    "casefold_tokens": _over_documents(_casefolded),
    "variant_index": _over_documents(variants.variant_index),
    "token_hashes": _over_documents(_token_hashes),
    "token_xxh64": _over_documents(_xxh64_tokens),
    "fingerprints_by_position": _over_documents(lambda d: _by_position(d).withColumn("hash", text.u64_hex(F.col("hash")))),
    "fingerprints_by_hash": _over_documents(fingerprint.fingerprints),
    "fingerprint_index_stats": _over_documents(lambda d: fingerprint.index_stats(_by_position(d))),
    "fingerprint_postings": _over_documents(_posting_lists),
    "fingerprint_verified": _over_documents(fingerprint.verified_buckets),
    "benchmark_overlap": _benchmark_overlap,
    "compare_profiles_en_fr": _compare_en_fr,
    "diff_turns": _diff_turns,
    "compare_turns": lambda spark, sf_dir: diff.compare_texts(spread(_turn_pairs(spark, sf_dir))),
    "diff_turns_detailed": lambda spark, sf_dir: diff.text_diffs(spread(_turn_pairs(spark, sf_dir)), key="nfkcCaseFold"),
    "envelope_roundtrip": _over_documents(_envelopes),
    "envelope_kinds": _over_documents(_envelope_kinds),
    "integrity_findings": _over_documents(_integrity_wide),
    "scan_tokens": _over_documents(_scanned),
    "comparison_tokens": _over_documents(lambda d: scan.comparison_tokens(d, "uax29-grapheme", "nfkcCaseFold", algo=FNV, most=200)),
    "security_facts": _with_table(scan.security_facts),
    "skeleton_collisions": _with_table(lambda d, t: scan.skeleton_collisions(d, t).drop("skeleton")),
    "bidi_facts": _over_documents(_bidi_facts),
    "line_break_facts": _over_documents(lambda d: packs.display_facts(d, directions=False).select("doc_id", "line_breaks", "mandatory_breaks")),
    "document_sentences": _over_documents(lambda d: scan.segment_spans(d, "sentence")),
    "repeated_sentences": _over_documents(scan.duplicate_sentences),
    "document_variants": _over_documents(scan.document_variants),
    "surface_profiles": _over_documents(packs.surface_profiles),
    "pack_v1": _with_table(lambda d, t: packs.pack_digests(d, PACK_OPTIONS, t)),
    "fact_packs": _over_documents(lambda d: packs.fact_digests(d, FACT_OPTIONS)),
    "corpus_pack": _over_documents(packs.corpus_pack),
    "hosts_ascii": _hosts_ascii,
    "punycode_words": _over_documents(_punycode_words),
    "token_spans": _over_documents(lambda d: tokens.spans(d)),
    "canonical_json": _events_jcs,
    "analyze_text": _over_documents(packs.analyze_text),
    "analyze_corpus": _over_documents(packs.analyze_corpus),
    "sentence_counts": _over_documents(facts.sentence_counts),
    "duplicate_sentences": _over_documents(facts.duplicate_sentences),
    "scripts": _over_documents(lambda d: profile.char_classes(d, "script")),
    "bidi_classes": _over_documents(lambda d: profile.char_classes(d, "bidi_class")),
    "hosts": _hosts,
    "streaming_word_counts": _streaming_word_counts,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


# The SQL states its own constants; its word pattern covers letters, digits and marks of ASCII and Latin-1, which is all the tables hold.
_WORD = "(?:[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[:.''][A-Za-zÀ-ÖØ-öø-ÿ]+)*|[0-9]+(?:[,.;''][0-9]+)*|_)+|\\r\\n| +|[\\s\\S]"
_LIKE = "[A-Za-zÀ-ÖØ-öø-ÿ0-9_]"
_ALL = f"SELECT doc_id, lang, regexp_extract_all(text, '{_WORD}') AS al FROM documents"
_ARR = f"SELECT doc_id, lang, list_filter(al, lambda x: regexp_matches(x, '{_LIKE}')) AS w FROM ({_ALL})"
_TOK = f"SELECT doc_id, lang, unnest(w) AS token FROM ({_ARR})"
_GRAM = "SELECT doc_id, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: {gram})) AS gram FROM (" + _ARR + ") WHERE len(w) >= {m}"


def _grams(n: int) -> str:
    return _GRAM.format(m=n, gram=" || ' ' || ".join(f"w[i + {j}]" for j in range(n)))


_FOLD = "replace(replace(lower({x}), 'ß', 'ss'), 'µ', 'μ')"
_CATEGORY = """CASE WHEN regexp_matches(c, '[A-ZÀ-ÖØ-Þ]') THEN 'Lu' WHEN regexp_matches(c, '[a-zß-öø-ÿµ]') THEN 'Ll' WHEN regexp_matches(c, '[0-9]') THEN 'Nd'
 WHEN c = ' ' THEN 'Zs' WHEN regexp_matches(c, '[\\x00-\\x1f\\x7f]') THEN 'Cc' WHEN c = '_' THEN 'Pc' WHEN c = '-' THEN 'Pd' WHEN c IN ('(', '[', '{') THEN 'Ps' WHEN c IN (')', ']', '}') THEN 'Pe'
 WHEN c IN ('$') THEN 'Sc' WHEN c IN ('+', '<', '=', '>', '|', '~') THEN 'Sm' WHEN c IN ('^', '`') THEN 'Sk' ELSE 'Po' END"""
_CATEGORIES = f"SELECT {_CATEGORY} AS category, CAST(sum(n) AS BIGINT) AS count FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c) GROUP BY 1"
_PROFILE = (
    "SELECT n, gram, count, row_number() OVER (PARTITION BY n ORDER BY count DESC, gram) AS rk FROM (SELECT n, substring(text, i, n) AS gram, count(*) AS count FROM ("
    "SELECT text, n, unnest(range(1, length(text) - n + 2)) AS i FROM documents, (VALUES (2), (3)) AS s(n) WHERE {where} length(text) >= n) GROUP BY n, gram)"
)
_CHAR_NGRAMS = f"SELECT n, gram, count FROM ({_PROFILE.format(where='')}) WHERE rk <= 50"
_SIDE = "SELECT n, gram, count FROM ({p}) WHERE rk <= 50"
_EN, _FR = "lang = 'en' AND", "lang = 'fr' AND"
_ENVELOPE = "'sha256:' || sha256(text)"

_KINDS = {
    "default_ignorable": "\\x{AD}\\x{34F}\\x{61C}\\x{115F}-\\x{1160}\\x{17B4}-\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{E0000}-\\x{E0FFF}",
    "bidi_control": "\\x{61C}\\x{200E}-\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}",
    "join_control": "\\x{200C}-\\x{200D}",
    "variation_selector": "\\x{180B}-\\x{180D}\\x{180F}\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}",
    "noncharacter": "\\x{FDD0}-\\x{FDEF}\\x{FFFE}-\\x{FFFF}\\x{1FFFE}-\\x{1FFFF}",
}
_U64 = "18446744073709551616::UHUGEINT"
_FNV = "CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, {bytes}), lambda h, x: (xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT))::UHUGEINT * 1099511628211::UHUGEINT) % " + _U64 + ") AS UBIGINT)"
_BYTES = "list_transform(range(0, len(hex(encode(token))) // 2), lambda i: CAST('0x' || substr(hex(encode(token)), CAST(2 * i + 1 AS INTEGER), 2) AS UHUGEINT))"
# UTF-16: Latin-1 characters are one byte and a zero
_UNITS = "flatten(list_transform(string_split(token, ''), lambda c: [ord(c)::UHUGEINT, 0::UHUGEINT]))"
_FNV8, _FNV16 = _FNV.format(bytes=_BYTES), _FNV.format(bytes=_UNITS)
_HEX = "format('{{:016x}}', {x})"


def _prints(table: str, name: str) -> str:
    """Winnowing by position over ``table``: 5-token shingles of FNV hashes, the rightmost least hash of 4."""
    shingle = "h0::UHUGEINT"
    for j in range(1, 5):
        shingle = f"(({shingle}) * 11400714785074694791::UHUGEINT + h{j}::UHUGEINT) % {_U64}"
    leads = ", ".join(f"lead(h, {j}) OVER (PARTITION BY id ORDER BY i) AS h{j}" for j in range(1, 5))
    return f"""
 {name}_w AS (SELECT {'doc_id' if table == 'documents' else 'item_id'} AS id, regexp_extract_all(text, '{_WORD}') AS al FROM {table}),
 {name}_t AS (SELECT id, unnest(range(0, len(al))) AS i, unnest(al) AS token FROM {name}_w),
 {name}_d AS (SELECT token, {_FNV8} AS h FROM (SELECT DISTINCT token FROM {name}_t)),
 {name}_h AS (SELECT id, i, h AS h0, {leads} FROM {name}_t JOIN {name}_d USING (token)),
 {name}_s AS (SELECT id, i, CAST({shingle} AS UBIGINT) AS s FROM {name}_h WHERE h4 IS NOT NULL),
 {name}_m AS (SELECT id, i, min({{'s': s, 'j': -i}}) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m, count(*) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM {name}_s),
 {name} AS (SELECT DISTINCT id, CAST(-m.j AS INTEGER) AS tok_idx, m.s AS hash FROM {name}_m WHERE n = 4)"""


_BIDI_CLASS = "CASE WHEN regexp_matches(c, '[A-Za-zÀ-ÖØ-öø-ÿªºµ]') THEN 'L' WHEN regexp_matches(c, '[0-9²³¹]') THEN 'EN' WHEN c IN ('+', '-') THEN 'ES' WHEN regexp_matches(c, '[#$%¢-¥°±]') THEN 'ET' WHEN regexp_matches(c, '[,./:\\x{A0}]') THEN 'CS' WHEN c = chr(9) THEN 'S' WHEN regexp_matches(c, '[\\n\\r]') THEN 'B' WHEN c = ' ' THEN 'WS' ELSE 'ON' END"
_SKELETON = "replace(replace(replace(" + _FOLD.format(x="token") + ", 'm', 'rn'), '1', 'l'), '0', 'O')"
_SPANS = f"SELECT doc_id, i, token, CAST(e - length(token) AS INTEGER) AS start_cu, CAST(e AS INTEGER) AS end_cu FROM (SELECT doc_id, i, token, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(al) + 1)) AS i, unnest(al) AS token FROM ({_ALL})))"

ORACLES: dict[str, str] = {
    "text_summary": "SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS code_units, CAST(length(text) AS BIGINT) AS code_points, CAST(strlen(text) AS BIGINT) AS bytes FROM documents",
    "word_frequencies": f"SELECT token, count(*) AS count FROM ({_TOK}) GROUP BY token ORDER BY count DESC, token LIMIT 50",
    "word_frequencies_by_lang": f"SELECT lang, token, count FROM (SELECT lang, token, count, row_number() OVER (PARTITION BY lang ORDER BY count DESC, token) AS rk FROM (SELECT lang, token, count(*) AS count FROM ({_TOK}) GROUP BY lang, token)) WHERE rk <= 20",
    "all_token_frequencies": f"SELECT token, count(*) AS count FROM (SELECT unnest(al) AS token FROM ({_ALL})) GROUP BY token ORDER BY count DESC, token LIMIT 50",
    "word_totals": f"SELECT doc_id, CAST(len(al) AS BIGINT) AS all_tokens, CAST(len(list_filter(al, lambda x: regexp_matches(x, '{_LIKE}'))) AS BIGINT) AS word_tokens FROM ({_ALL})",
    "word_ngrams_2": f"SELECT gram, count(*) AS count FROM ({_grams(2)}) GROUP BY gram ORDER BY count DESC, gram LIMIT 50",
    "word_ngrams_3": f"SELECT gram, count(*) AS count FROM ({_grams(3)}) GROUP BY gram ORDER BY count DESC, gram LIMIT 50",
    "word_cooccurrence_w3": "WITH v AS ("
    + f"SELECT w, unnest(range(1, len(w) - 1)) AS i FROM ({_ARR}) WHERE len(w) >= 3"
    + ") SELECT a, b, count(*) AS count FROM ("
    + " UNION ALL ".join(f"SELECT least(w[i + {p}], w[i + {q}]) AS a, greatest(w[i + {p}], w[i + {q}]) AS b FROM v" for p, q in ((0, 1), (0, 2), (1, 2)))
    + ") GROUP BY a, b ORDER BY count DESC, a, b LIMIT 50",
    "repetition_2": f"SELECT doc_id, count(*) AS repeated, CAST(sum(c) AS BIGINT) AS occurrences FROM (SELECT doc_id, gram, count(*) AS c FROM ({_grams(2)}) GROUP BY doc_id, gram HAVING count(*) >= 2) GROUP BY doc_id",
    "char_ngrams": _CHAR_NGRAMS,
    "word_length_histogram": f"SELECT CASE WHEN length(token) <= 1 THEN 1 WHEN length(token) <= 2 THEN 2 WHEN length(token) <= 4 THEN 4 WHEN length(token) <= 8 THEN 8 WHEN length(token) <= 16 THEN 16 END AS upto, count(*) AS count FROM ({_TOK}) GROUP BY 1",
    "duplicate_lines": "SELECT line, count(*) AS count FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY line HAVING count(*) > 1 ORDER BY count DESC, line LIMIT 50",
    "grapheme_counts": "SELECT doc_id, CAST(length(replace(text, chr(13) || chr(10), 'x')) AS BIGINT) AS graphemes FROM documents",
    "general_categories": _CATEGORIES,
    "punctuation_whitespace": f"SELECT CAST(coalesce(sum(CASE WHEN category LIKE 'P%' THEN count END), 0) AS BIGINT) AS punctuation, CAST(coalesce(sum(CASE WHEN category LIKE 'Z%' THEN count END), 0) AS BIGINT) AS whitespace FROM ({_CATEGORIES})",
    "safety_scan": "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{0000}-\\x{001F}\\x{007F}-\\x{009F}]', '', 'g')) AS BIGINT) AS control_chars, CAST(length(text) - length(regexp_replace(text, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]', '', 'g')) AS BIGINT) AS invisible_chars, CAST(0 AS BIGINT) AS unpaired_surrogates FROM documents",
    "integrity_counts": "SELECT doc_id, "
    + ", ".join(f"CAST(length(text) - length(regexp_replace(text, '[{chars}]', '', 'g')) AS BIGINT) AS {kind}" for kind, chars in _KINDS.items())
    + f", regexp_matches(text, '[{_KINDS['bidi_control']}]') AS has_bidi_controls FROM documents",
    "normalization_flags": "SELECT doc_id, nfc_normalize(text) = text AS is_nfc, NOT regexp_matches(text, '[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]') AS is_nfd, nfc_normalize(text) = text AS is_nfkc, NOT regexp_matches(text, '[À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ]') AS is_nfkd FROM documents",
    "casefold_tokens": f"SELECT {_FOLD.format(x='token')} AS token, count(*) AS count FROM ({_TOK}) GROUP BY 1 ORDER BY count DESC, token LIMIT 50",
    "variant_index": f"WITH f AS (SELECT token AS form, count(*) AS n, {_FOLD.format(x='token')} AS key FROM ({_TOK}) GROUP BY token), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, form) AS rk FROM f) SELECT key, CAST(sum(n) AS BIGINT) AS total, count(*) AS forms, string_agg(form || ':' || CAST(n AS VARCHAR), ' ' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_forms FROM r GROUP BY key",
    "compare_profiles_en_fr": f"WITH a AS ({_SIDE.format(p=_PROFILE.format(where=_EN))}), b AS ({_SIDE.format(p=_PROFILE.format(where=_FR))}), j AS (SELECT coalesce(a.n, b.n) AS n, CAST(coalesce(a.count, 0) AS HUGEINT) AS x, CAST(coalesce(b.count, 0) AS HUGEINT) AS y FROM a FULL OUTER JOIN b ON a.n = b.n AND a.gram = b.gram) SELECT n, CAST(sum(CASE WHEN x > 0 AND y > 0 THEN 1 ELSE 0 END) AS BIGINT) AS shared, count(*) AS \"union\", CAST(sum(x * y) AS VARCHAR) AS dot, CAST(sum(x * x) AS VARCHAR) AS norm_left, CAST(sum(y * y) AS VARCHAR) AS norm_right FROM j GROUP BY n",
    "envelope_roundtrip": f"SELECT doc_id, 'string' AS kind, true AS same, {_ENVELOPE} AS sha256 FROM documents",
    "analyze_text": f"SELECT d.doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT) AS code_units, CAST(length(text) AS BIGINT) AS code_points, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(al) AS BIGINT) AS tokens, CAST(len(list_filter(al, lambda x: regexp_matches(x, '{_LIKE}'))) AS BIGINT) AS words, CAST(length(replace(text, chr(13) || chr(10), 'x')) AS BIGINT) AS graphemes, CAST(length(text) - length(regexp_replace(text, '[\\x{{0000}}-\\x{{001F}}\\x{{007F}}-\\x{{009F}}]', '', 'g')) AS BIGINT) AS control_chars, regexp_matches(text, '[{_KINDS["bidi_control"]}]') AS has_bidi_controls, {_ENVELOPE} AS sha256 FROM documents d JOIN ({_ALL}) t ON d.doc_id = t.doc_id",
    "token_spans": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, CAST(e - length(raw) AS INTEGER) AS start_cu, CAST(e AS INTEGER) AS end_cu, raw FROM (SELECT doc_id, i, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(al) + 1)) AS i, unnest(al) AS raw FROM ({_ALL})))",
    "scripts": "SELECT CASE WHEN regexp_matches(c, '[A-Za-zÀ-ÖØ-öø-ÿªº]') THEN 'Latin' ELSE 'Common' END AS value, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1",
    "token_hashes": f"SELECT token, {_HEX.format(x='a')} AS fnv_utf16, {_HEX.format(x='b')} AS fnv_utf8, {_HEX.format(x='a')} || {_HEX.format(x='b')} AS hash128 FROM (SELECT token, {_FNV16} AS a, {_FNV8} AS b FROM (SELECT DISTINCT token FROM ({_TOK})))".replace("{{", "{").replace("}}", "}"),
    "fingerprints_by_position": f"WITH {_prints('documents', 'p')} SELECT id AS doc_id, tok_idx, format('{{:016x}}', hash) AS hash FROM p",
    "fingerprint_index_stats": f"WITH {_prints('documents', 'p')}, l AS (SELECT hash, count(DISTINCT id) AS n FROM p GROUP BY hash) SELECT CAST(sum(n) AS BIGINT) AS postings, count(*) AS hashes, max(n) AS longest, (SELECT count(DISTINCT id) FROM p) AS documents FROM l",
    "fingerprint_postings": f"WITH {_prints('documents', 'p')}, l AS (SELECT hash, list_sort(list(DISTINCT id)) AS ids FROM p GROUP BY hash) SELECT format('{{:016x}}', hash) AS hash, CAST(len(ids) AS BIGINT) AS documents, array_to_string(ids[1:20], ',') AS ids, len(ids) > 20 AS truncated FROM l",
    "benchmark_overlap": f"WITH {_prints('documents', 'p')}, {_prints('benchmark', 'q')}, a AS (SELECT DISTINCT id, hash FROM p), b AS (SELECT DISTINCT id, hash FROM q), na AS (SELECT id, count(*) AS n FROM a GROUP BY id), nb AS (SELECT id, count(*) AS n FROM b GROUP BY id), s AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS shared FROM a JOIN b ON a.hash = b.hash GROUP BY 1, 2) SELECT doc_id, item_id, shared, shared AS jaccard_num, na.n + nb.n - shared AS jaccard_den, shared AS containment_num, nb.n AS containment_den, shared AS containment_back_num, na.n AS containment_back_den FROM s JOIN na ON na.id = doc_id JOIN nb ON nb.id = item_id",
    "canonical_json": "SELECT event_id, replace(props, ' ', '') AS jcs, sha256(replace(props, ' ', '')) AS sha256 FROM events",
    "bidi_classes": f"SELECT {_BIDI_CLASS} AS value, count(*) AS count FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1",
    "bidi_facts": "SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE 1 END AS BIGINT) AS bidi_runs, 0 AS paragraph_level, false AS mixed_direction, CAST(0 AS BIGINT) AS bidi_controls FROM documents",
    "scan_tokens": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS tok_idx, start_cu, end_cu, token AS raw, {_FOLD.format(x='token')} AS canonical, CASE WHEN regexp_matches(token, '[A-Za-zÀ-ÖØ-öø-ÿ]') THEN 'Latin' ELSE 'Common' END AS scripts, false AS mixed_script, false AS bidi_controls FROM ({_SPANS}) WHERE regexp_matches(token, '{_LIKE}')",
    "comparison_tokens": f"SELECT g.doc_id, g.tok_idx, g.start_cu, g.end_cu, g.raw, g.key, {_HEX.format(x='d.h')} AS key_hash FROM (SELECT doc_id, CAST(i - 1 AS INTEGER) AS tok_idx, CAST(e - length(raw) AS INTEGER) AS start_cu, CAST(e AS INTEGER) AS end_cu, raw, {_FOLD.format(x='raw')} AS key FROM (SELECT doc_id, i, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(1, len(al) + 1)) AS i, unnest(al) AS raw FROM (SELECT doc_id, regexp_extract_all(text, '\\r\\n|[\\s\\S]')[1:200] AS al FROM documents)))) g JOIN (SELECT token, {_FNV8} AS h FROM (SELECT DISTINCT {_FOLD.format(x='c')} AS token FROM (SELECT unnest(regexp_extract_all(text, '\\r\\n|[\\s\\S]')) AS c FROM documents))) d ON d.token = g.key".replace("{{", "{").replace("}}", "}"),
    "security_facts": f"WITH c AS (SELECT doc_id, token, count(*) AS n FROM ({_TOK}) GROUP BY doc_id, token), k AS (SELECT doc_id, {_SKELETON} AS s, sum(n) AS n, count(*) AS f FROM c GROUP BY 1, 2), g AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN f > 1 THEN 1 ELSE 0 END) AS BIGINT) AS collisions FROM k GROUP BY doc_id) SELECT d.doc_id, coalesce(tokens, 0) AS tokens, CAST(0 AS BIGINT) AS mixed_script_tokens, coalesce(collisions, 0) AS collisions FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g USING (doc_id)",
    "skeleton_collisions": f"WITH c AS (SELECT token, count(*) AS n, {_SKELETON} AS s FROM ({_TOK}) GROUP BY token), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY n DESC, token) AS rk FROM c), g AS (SELECT s, CAST(sum(n) AS BIGINT) AS total, count(*) AS forms, string_agg(token, ' ' ORDER BY rk) FILTER (WHERE rk <= 5) AS examples FROM r GROUP BY s HAVING count(*) > 1) SELECT total, forms, examples FROM g ORDER BY total DESC, s LIMIT 50",
    "integrity_findings": "WITH f(place, kind, off, code_point) AS (VALUES (0, 'default-ignorable', 0, 173), (1, 'default-ignorable', 1, 8238), (2, 'bidi-control', 1, 8238), (3, 'default-ignorable', 2, 8205), (4, 'join-control', 2, 8205), (5, 'default-ignorable', 3, 65039), (6, 'variation-selector', 3, 65039), (7, 'noncharacter', 4, 64976)) SELECT doc_id, place, kind, CAST(least(5, length(text)) + off AS INTEGER) AS start_cu, CAST(least(5, length(text)) + off + 1 AS INTEGER) AS end_cu, code_point FROM documents, f",
    "envelope_kinds": "SELECT doc_id, kind, true AS same, CASE kind WHEN 'utf8-base64' THEN CAST(((strlen(text) + 2) // 3) * 4 AS BIGINT) WHEN 'utf16le-base64' THEN CAST(((2 * length(text) + 2) // 3) * 4 AS BIGINT) END AS base64_length, CASE WHEN kind = 'utf16-code-units' THEN CAST(length(text) AS BIGINT) END AS units FROM documents, (VALUES ('string'), ('utf8-base64'), ('utf16le-base64'), ('utf16-code-units')) AS k(kind)",
    "hosts_ascii": "SELECT host, count(*) AS pages, true AS ok, lower(host) AS ascii, lower(host) AS unicode FROM (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host FROM pages) GROUP BY host",
    "hosts": "SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
    "streaming_word_counts": f"SELECT token, count(*) AS count FROM ({_TOK}) GROUP BY token",
}
ORACLES["analyze_corpus"] = (
    "SELECT count(*) AS documents, "
    + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("code_units", "code_points", "bytes", "tokens", "words", "graphemes", "control_chars"))
    + f", CAST(coalesce(sum(CAST(has_bidi_controls AS BIGINT)), 0) AS BIGINT) AS with_bidi_controls FROM ({ORACLES['analyze_text']})"
)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
