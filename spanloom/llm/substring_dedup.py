"""Substring deduplication over a compacted de Bruijn graph of token k-mers.

1. Anchors.  In every run of ``window`` words the least k-mer (by hash) is an anchor, so each
   window holds one and equal windows hold the same one.  Anchors are the nodes of a sparse de
   Bruijn graph; an edge leads to the document's next anchor and is named by the hash of all
   words from one to the other.
2. Compaction.  One aggregation per node gives its documents' range and whether all its
   occurrences share one incoming and one outgoing edge.  Nodes of one document only are
   dropped.  Where each of two neighbours has only the edge between them, both occur in
   the same documents: such edges join into nonbranching paths, and every document of a path has
   its whole span.
3. Verification.  Spans of paths, and windows of repeated anchors that leave their path (at
   branches and ends), are looked up by a 128-bit hash of all their words, with document and word
   number as coordinates; one is repeated if the least document with these words is a smaller
   one.  Nothing is removed on the graph's word alone.

Joins are equi-joins on hashes with the counted side aggregated first, so a common passage
costs as many rows as it has occurrences; the counted sides are stored tables, so that the rows of
a very common node or window can be dealt to several tasks.  Texts move in two shuffles by row; no group is
collected beyond the word numbers of one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import NOT_SPACE, Words
from .staging import discard, stage

WINDOW = 50
K = 12

_ANCHORS = "rid bigint, doc bigint, at int, node bigint, came bigint, went bigint"
_FOUND = "rid bigint, doc bigint, h1 bigint, h2 bigint, start int, stop int"


def _window_starts(words: Words, window: int) -> np.ndarray:
    """Flags of the words at which a window of one document starts."""
    n = len(words.start)
    out = np.zeros(n, bool)
    if n >= window:
        out[: n - window + 1] = words.doc[: n - window + 1] == words.doc[window - 1 :]
    return out


def _anchors(words: Words, window: int, k: int) -> np.ndarray:
    gram, _ = words.grams(k)
    starts = np.flatnonzero(_window_starts(words, window))
    return kernels.sliding_min_at(gram, window - k + 1, starts), gram


def anchor_table(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Anchors of (rid, doc, text) rows with the edges by which the document comes and goes (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "text"):
                words = Words(part.column(2), NOT_SPACE)
                at, gram = _anchors(words, window, k)
                doc = words.doc[at]
                edge = np.zeros(len(at) + 1, np.uint64)
                if len(at) > 1:
                    same = doc[1:] == doc[:-1]
                    edge[1:-1] = np.where(same, words.span_hash(at[:-1], at[1:] + k) | np.uint64(1), 0)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(doc)),
                        part.column(1).take(pa.array(doc)),
                        pa.array((at - words.first[doc]).astype(np.int32)),
                        kernels.signed(gram[at]),
                        kernels.signed(edge[:-1]),
                        kernels.signed(edge[1:]),
                    ],
                    names=["rid", "doc", "at", "node", "came", "went"],
                )

    return docs.mapInArrow(run, _ANCHORS)


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """(rid, marks): the anchors of each row that other documents have too."""
    nodes = (
        anchors.groupBy("node")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("came").alias("c0"), F.max("came").alias("c1"), F.min("went").alias("w0"), F.max("went").alias("w1"))
        .where("lo < hi")
        .select("node", (F.expr("c0 = c1 and c0 <> 0")).alias("one_in"), (F.expr("w0 = w1 and w0 <> 0")).alias("one_out"))
    )
    mark = F.struct("at", "one_in", "one_out")
    shared = stage(nodes, "nodes", cleanup=True)
    return anchors.select("rid", "at", "node").join(shared, "node").groupBy("rid").agg(F.collect_list(mark).alias("marks"))


def path_spans(at: np.ndarray, doc: np.ndarray, one_in: np.ndarray, one_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last mark of each nonbranching path; marks are sorted by document and word."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = (doc[1:] == doc[:-1]) & one_out[:-1] & one_in[1:]
    return np.flatnonzero(np.concatenate([[True], ~joined])), np.flatnonzero(np.concatenate([~joined, [True]]))


def candidate_windows(marked: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Spans of paths and the windows outside them, with hashes to look them up by, of (rid, doc, text, marks) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "text"):
                words = Words(part.column(2), NOT_SPACE)
                n = len(words.start)
                marks = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(marks.offsets.to_numpy()))
                flat = marks.flatten()
                local = flat.field(0).to_numpy().astype(np.int64)
                order = np.lexsort((local, owner))
                owner, at = owner[order], words.first[owner[order]] + local[order]
                one_in, one_out = (flat.field(i).to_numpy(zero_copy_only=False)[order] for i in (1, 2))
                a, b = path_spans(at, owner, one_in, one_out)
                long = at[b] + k - at[a] >= window
                a, b = a[long], b[long]
                starts = _window_starts(words, window)
                low = np.maximum(at + k - window, words.first[owner])
                held = kernels.cover(n, low, at + 1) & starts
                held &= ~kernels.cover(n, at[a], at[b] + k - window + 1)
                look = np.flatnonzero(held)
                begin = np.concatenate([at[a], look])
                end = np.concatenate([at[b] + k, look + window])
                doc = words.doc[begin]
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(doc)),
                        part.column(1).take(pa.array(doc)),
                        *[kernels.signed(words.span_hash(begin, end, half)) for half in (0, 1)],
                        *[pa.array((x - words.first[doc]).astype(np.int32)) for x in (begin, end)],
                    ],
                    names=["rid", "doc", "h1", "h2", "start", "stop"],
                )

    return marked.mapInArrow(run, _FOUND)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(rid, start, stop) word ranges of (rid, doc, text) rows whose every window is found in a smaller document.

    Ranges of one row may overlap and touch; together they cover just the repeated words.
    """
    known = docs.where(F.col("doc").isNotNull())
    anchors = stage(anchor_table(known, window, k), "anchors")
    marked = known.join(repeated_anchors(anchors).hint("shuffle_hash"), "rid").select("rid", "doc", "text", "marks")
    found = stage(candidate_windows(marked, window, k), "windows", cleanup=True)
    discard(docs.sparkSession, anchors)
    least = found.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").drop("hi")
    return found.join(stage(least, "repeated", cleanup=True), ["h1", "h2"]).where("doc > lo").select("rid", "start", "stop")


DIGEST = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _row_id(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id), F.col(text))


def drop_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, keep_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    One row per row of ``docs``: see ``DIGEST``, plus ``kept_text`` (kept words joined by one
    space) with ``keep_text``.  Null texts have no words; a text shorter than a window keeps
    all; rows without an id are neither compared nor cut; rows with one id never cut each
    other and repeated rows fare alike; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(_row_id(doc_id, text).alias("rid"), F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    gone = repeated_spans(rows, window, k).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(gone.hint("shuffle_hash"), "rid", "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kernels.chunks(batch, "text"):
                words = Words(part.column(1), NOT_SPACE, hashes=False)
                spans = part.column(2)
                owner = np.repeat(np.arange(part.num_rows), np.asarray(spans.value_lengths().fill_null(0)))
                flat = spans.flatten()
                begin, stop = (words.first[owner] + flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                kept = ~kernels.cover(len(words.start), begin, stop)
                data, ends = _joined(words, kept)
                texts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                left = np.concatenate([[0], np.cumsum(kept)])
                removed = words.count - (left[words.first[1:]] - left[words.first[:-1]])
                out = [part.column(0), pa.array(words.count), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                if keep_text:
                    out.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.record_batch(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(out)])

    return joined.mapInArrow(run, DIGEST + ", kept_text string" * keep_text)


def _joined(words: Words, kept: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The kept words of all rows, joined by one space within a row, and each row's ends."""
    more = np.zeros(len(kept), bool)  # a kept word of the same row follows
    at = np.flatnonzero(kept)
    if len(at) > 1:
        more[at[:-1]] = words.doc[at[:-1]] == words.doc[at[1:]]
    raw = words.text.copy()
    raw[words.end[more]] = 0x20
    take = kernels.cover(len(raw), words.start[kept], words.end[kept] + more[kept])
    ends = np.concatenate([[0], np.cumsum(take)])[words.offsets]
    return memoryview(raw[take].tobytes()), ends
