"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, licenses, minhash, mixing, quality, secrets, sharding, substring_dedup, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), shards=8)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir)).drop("licenses")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and list of the spans that ``find_secrets`` returns."""
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["place"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("found")).alias("spans"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(secrets.find_secrets(_documents(spark, sf_dir)))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_quality, op4_substring_dedup, op5_mixing, op6_minhash, op7_licenses, op8_decontamination, op9_secrets, op10_html)}


# The same results by plain joins over all windows or pairs, for small tables.
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_ALNUM = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 k AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
 f AS (SELECT k, min(doc_id) AS lo FROM k GROUP BY k HAVING count(DISTINCT doc_id) > 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM k JOIN f USING (k) WHERE doc_id > lo),
 p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
 r AS (SELECT p.doc_id, count(*) AS n_words, count(g.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p.p) FILTER (WHERE g.p IS NULL), '') AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

_OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
 t AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON e.a = t.b)
SELECT a AS doc_id, min(b) AS class_id FROM t GROUP BY a"""

_OP8 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark),
 q AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
 k AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM q) WHERE len(w) >= n)),
 h AS (SELECT doc_id, i, q.n, item FROM k JOIN q ON q.n = k.n AND q.k = k.k),
 c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: kind, expression, counted group, least length
_SECRETS = (
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40), ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15), ("google", "AIza[A-Za-z0-9_-]+", 0, 39), ("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30),
)
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{regex}') AS m, regexp_extract_all(text, '{regex}', {group}) AS g, string_split_regex(text, '{regex}') AS gap FROM t"
    for place, (kind, regex, group, least) in enumerate(_SECRETS)
)
_OP9 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), a AS ({_MATCHES}),
 u AS (SELECT doc_id, place, kind, least, i, m[i] AS m, g[i] AS g, gap[i] AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a)),
 p AS (SELECT *, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS s FROM u WINDOW w AS (PARTITION BY doc_id, place ORDER BY i)),
 f AS (SELECT doc_id, place, kind, s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(m) AS BIGINT) AS VARCHAR) AS x FROM p WHERE length(g) >= least),
 r AS (SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
  string_agg(x, ',' ORDER BY s, place) FILTER (WHERE place < 3) AS base, string_agg(x, ',' ORDER BY s, place) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": _OP4, "op6_minhash": _OP6, "op8_decontamination": _OP8, "op9_secrets": _OP9}
