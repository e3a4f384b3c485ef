"""Winnowing fingerprints, their inverted index, and overlap with a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import kernels, segment

from . import rows
from .tokens import cutter


def shingle_hashes(token_hashes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of ``k`` consecutive token hashes, modulo 2**64, first token highest."""
    n = len(token_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * kernels.SHINGLE_BASE + token_hashes[j : j + n]
    return out


def winnow(hashes: np.ndarray, window: int, dedupe: str = "by-position") -> list[int]:
    """Chosen shingles: the rightmost least (unsigned) hash of each window of ``window`` shingles.

    by-position drops a choice equal to the one before; by-hash also drops one whose hash was
    the last chosen while that one is still inside the window.  Fewer shingles than a window
    give none.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return []
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    picked = np.arange(n) + window - 1 - np.argmin(views[:, ::-1], axis=1)
    if dedupe == "by-position":
        return picked[np.concatenate([[True], picked[1:] != picked[:-1]])].tolist()
    if dedupe != "by-hash":
        return picked.tolist()
    # windows that choose the same shingle stand together: the last of them is the first to let it go
    last = np.flatnonzero(np.append(picked[1:] != picked[:-1], True))
    at = picked[last]
    out: list[int] = []
    held = None
    for start, i, h in zip(last.tolist(), at.tolist(), hashes[at].tolist(), strict=True):
        if h != held or start > out[-1]:
            out.append(i)
            held = h
    return out


def token_hashes(words: list[str], algo: str) -> np.ndarray:
    """64-bit hashes of tokens, each distinct one hashed once."""
    import xxhash

    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if algo == "xxh64-utf8":
        known = np.array([xxhash.xxh64_intdigest(w.encode()) for w in number], np.uint64)
    else:
        known = kernels.fnv1a64([w.encode("utf-16-le" if algo == "fnv1a64-utf16le" else "utf-8") for w in number])
    return known[at] if len(at) else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, k: int = 5, window: int = 4, dedupe: str = "by-hash", id_column: str = "doc_id", repertoire: str = "auto", algo: str = "xxh64-utf8") -> DataFrame:
    """(id, tok_idx, hash): winnowing fingerprints over hashes of all word tokens.

    ``algo``: xxh64-utf8, fnv1a64-utf8 or fnv1a64-utf16le.  Null texts and texts of fewer shingles
    than a window have none.
    """

    def many(texts: list[str]) -> Iterator[tuple]:
        words = [cut(x) for x in texts]
        hashes, done = token_hashes([w for ws in words for w in ws], algo), 0
        for ws in words:
            h = shingle_hashes(hashes[done : done + len(ws)], k)
            at = winnow(h, window, dedupe)
            yield at, h[at].view(np.int64).tolist()
            done += len(ws)

    cut = cutter(repertoire)
    return rows.exploded(docs, [id_column], "text", "tok_idx:int,hash:bigint", None, many=many)


def fingerprint_set(prints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Distinct (id, hash)."""
    return prints.select(id_column, "hash").distinct()


def posting_lists(prints: DataFrame, id_column: str = "doc_id", most: int = 1000) -> DataFrame:
    """(hash, documents, ids, truncated): the ids of each hash in order, at most the ``most`` least ones.

    A hash that all documents share is counted whole, but its list stays bounded.
    """
    from pyspark.sql import Window

    # by hash and salt first, so that a common hash is not sorted in one task
    salted = fingerprint_set(prints, id_column).withColumn("salt", F.pmod(F.xxhash64(id_column), F.lit(64)))
    part = Window.partitionBy("hash", "salt")
    near = salted.select("hash", id_column, F.row_number().over(part.orderBy(id_column)).alias("r"), F.count(F.lit(1)).over(part).alias("n")).where(F.col("r") <= most)
    lists = near.groupBy("hash").agg(F.sum(F.when(F.col("r") == 1, F.col("n"))).alias("documents"), F.slice(F.array_sort(F.collect_list(id_column)), 1, most).alias("ids"))
    return lists.withColumn("truncated", F.col("documents") > most)


def verified_buckets(docs: DataFrame, k: int = 5, window: int = 4, dedupe: str = "by-hash", id_column: str = "doc_id") -> DataFrame:
    """(hash, kgrams, documents): different token k-grams behind each hash; more than one is a collision of hashes."""

    def many(texts: list[str]) -> Iterator[tuple]:
        words = [segment.pieces(x, "word") for x in texts]
        hashes, done = token_hashes([w for ws in words for w in ws], "xxh64-utf8"), 0
        for ws in words:
            h = shingle_hashes(hashes[done : done + len(ws)], k)
            marked = [f"{len(w)}:{w}" for w in ws]
            found = {(int(h[i].astype(np.int64)), " ".join(marked[i : i + k])) for i in winnow(h, window, dedupe)}
            yield [x for x, _ in found], [x for _, x in found]
            done += len(ws)

    found = rows.exploded(docs, [id_column], "text", "hash:bigint,kgram:string", None, many=many)
    pairs = found.groupBy("hash", "kgram").agg(F.count_distinct(id_column).alias("n"))
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("kgrams"), F.sum("n").alias("documents"))


def index_stats(prints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row: postings, distinct hashes, documents, and the longest posting list."""
    pairs = fingerprint_set(prints, id_column)
    lists = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    docs = pairs.select(id_column).distinct().agg(F.count(F.lit(1)).alias("documents"))
    return lists.agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("hashes"), F.max("n").alias("longest")).crossJoin(F.broadcast(docs))  # one row each


def overlap(prints: DataFrame, queries: DataFrame, id_column: str = "doc_id", query_id: str = "item_id") -> DataFrame:
    """(id, query, shared, and the fractions jaccard, containment and containment_back) of pairs that share a hash.

    ``queries`` is a query set; each of its hashes meets the postings of all documents, whose side
    is stored rows that Spark can deal anew where one hash is common.  Containment is the share of
    the query's hashes, containment_back that of the document's.  Pairs that share nothing have
    0/1 by ``ratio`` and are not listed.
    """
    a = fingerprint_set(prints, id_column)
    b = fingerprint_set(queries, query_id)
    size_a = a.groupBy(id_column).agg(F.count(F.lit(1)).alias("na"))
    size_b = b.groupBy(query_id).agg(F.count(F.lit(1)).alias("nb"))
    shared = a.join(b, "hash").groupBy(id_column, query_id).agg(F.count(F.lit(1)).alias("shared"))
    found = shared.join(size_a, id_column).join(size_b, query_id)
    fractions = {"jaccard": F.col("na") + F.col("nb") - F.col("shared"), "containment": F.col("nb"), "containment_back": F.col("na")}
    cols = [c for name, den in fractions.items() for c in ratio(F.col("shared"), den, name)]
    return found.select(id_column, query_id, "shared", *cols)


def ratio(num, den, name: str) -> list:
    """<name>_num and <name>_den; 0/1 where the denominator is 0."""
    none = den == 0
    return [F.when(none, F.lit(0)).otherwise(num).cast("long").alias(f"{name}_num"), F.when(none, F.lit(1)).otherwise(den).cast("long").alias(f"{name}_den")]
