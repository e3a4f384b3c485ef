"""Benchmark decontamination with a distributed positional inverted index.

Index: each task turns its documents into *segments*.  A segment is an inverted file of its own:
its distinct terms (the words themselves, so no two terms can be taken for one) and for each term
the positions at which it stands (word numbers over the segment's documents laid end to end);
postings of a term are contiguous and rising.  Segments are stored
as Parquet rows, so the index is partitioned by document and needs no shuffle: a hot term or
a hot source is spread over all segments.  With one block of test items only postings of
terms in that block are stored, as no other list can be asked for.

Search: the test items are the query set.  It is read in blocks of about ``BLOCK_WORDS`` words.
Per segment a phrase starts from its rarest term there; the offset-adjusted list of that term is
intersected with those of the phrase's other terms, rarest first, until only true starts are
left.  Several blocks are passes over the stored index, one after the other: one block is
broadcast at a time and freed before the next, and each pass writes only the spans it found.
Proximity search asks for all terms of a phrase within ``slop`` extra words by the same lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import ALNUM, Words
from .staging import discard, stage

WINDOW = 13
BLOCK_WORDS = 200_000

SEGMENT = "segment bigint, doc_id array<bigint>, n_words array<int>, term array<binary>, upto array<int>, position array<int>"
_SEGMENT_ARROW = pa.schema(
    [
        ("segment", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("term", pa.list_(pa.binary())),
        ("upto", pa.list_(pa.int32())),
        ("position", pa.list_(pa.int32())),
    ]
)


class Segment:
    """Postings of one chunk of documents: ``position[upto[i]:upto[i+1]]`` for ``term[i]``."""

    def __init__(self, count: np.ndarray, term: pa.Array, upto: np.ndarray, position: np.ndarray):
        self.count, self.term, self.upto, self.position = count, term, upto, position
        self.ends = np.cumsum(count)

    @staticmethod
    def of(words: Words, vocabulary: pa.Array | None) -> Segment:
        wanted = np.ones(len(words.terms), bool) if vocabulary is None else pc.is_in(words.terms, value_set=vocabulary.cast(words.terms.type)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(wanted[words.term])
        number = (np.cumsum(wanted) - 1)[words.term[at]]
        upto = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=int(wanted.sum())))])
        return Segment(words.count, words.terms.filter(pa.array(wanted)).cast(pa.binary()), upto, at[np.argsort(number, kind="stable")])

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """Number of each term here, -1 for those that no document has."""
        return pc.fill_null(pc.index_in(terms, value_set=self.term), -1).to_numpy().astype(np.int64)

    def lists(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the lists with these numbers."""
        if not len(self.term):
            return np.zeros_like(number), np.zeros_like(number)
        return np.where(number < 0, 0, self.upto[number]), np.where(number < 0, 0, self.upto[number + 1])

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")

    def term_at(self) -> np.ndarray:
        """Number of the term at each position from 0, -1 where no list has it: all lists, laid out by position."""
        out = np.full(int(self.count.sum()), -1, np.int64)
        out[self.position] = np.repeat(np.arange(len(self.term)), np.diff(self.upto))
        return out


class Queries:
    """Phrases of a block of test items: ``window`` consecutive words, or a shorter item whole."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        self.ids = ids
        starts, lengths, owner = [], [], []
        for i, n in enumerate(words.count):
            if n:
                size = min(window, int(n))
                s = np.arange(words.first[i], words.first[i] + n - size + 1)
                starts.append(s)
                lengths.append(np.full(len(s), size))
                owner.append(np.full(len(s), i))
        whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.start, self.length, self.owner = whole(starts), whole(lengths), whole(owner)
        self.phrase = self.start - words.first[self.owner]
        self.vocabulary, self.term = words.terms.cast(pa.binary()), words.term
        self.width = int(self.length.max(initial=0))

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by offset: the term's number in ``vocabulary``, and whether the phrase reaches that far."""
        offset = np.arange(self.width)
        reach = offset[None, :] < self.length[:, None]
        return self.term[np.minimum(self.start[:, None] + offset, max(len(self.term) - 1, 0))], reach


def phrase_starts(segment: Segment, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start position) of each exact occurrence, none across two documents."""
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(queries.start) or not len(segment.position):
        return empty
    here = segment.numbers(queries.vocabulary)
    terms, reach = queries.terms()
    number = here[terms]
    # a phrase with a term that no document has is nowhere
    rows = np.flatnonzero(((number >= 0) | ~reach).all(axis=1))
    if not len(rows):
        return empty
    number, reach, length = number[rows], reach[rows], queries.length[rows]
    begin, end = segment.lists(number)
    df = np.where(reach, end - begin, np.iinfo(np.int64).max)
    order = np.argsort(df, axis=1, kind="stable")  # the rarest term first
    size = df[np.arange(len(rows)), order[:, 0]]
    phrase = np.repeat(np.arange(len(rows)), size)
    inner = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size)
    start = segment.position[begin[phrase, order[phrase, 0]] + inner] - order[phrase, 0]
    total = int(segment.count.sum())
    keep = (start >= 0) & (start + length[phrase] <= total)
    phrase, start = phrase[keep], start[keep]
    at = segment.term_at()
    for j in range(1, queries.width):
        o = order[phrase, j]
        keep = (j >= length[phrase]) | (at[np.minimum(start + o, total - 1)] == number[phrase, o])
        phrase, start = phrase[keep], start[keep]
    keep = segment.document(start) == segment.document(start + length[phrase] - 1)
    return rows[phrase[keep]], start[keep]


def near_spans(segment: Segment, queries: Queries, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first, last position): all terms of the phrase, in order, in at most ``slop`` more words.

    From each posting of the phrase's first term the next posting of each further term is taken.
    """
    found: list[tuple[int, int, int]] = []
    here = segment.numbers(queries.vocabulary)
    terms, _ = queries.terms()
    for p in range(len(queries.start)):
        begin, end = segment.lists(here[terms[p, : queries.length[p]]])
        if (end == begin).any():
            continue
        first = at = segment.position[begin[0] : end[0]]
        for b, e in zip(begin[1:], end[1:], strict=True):
            postings = segment.position[b:e]
            k = np.searchsorted(postings, at, side="right")
            keep = k < len(postings)
            first, at = first[keep], postings[k[keep]]
        keep = (at - first + 1 <= queries.length[p] + slop) & (segment.document(first) == segment.document(at))
        found += [(p, int(a), int(b)) for a, b in zip(first[keep], at[keep], strict=True)]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def read_queries(items: DataFrame, item_id: str, text: str, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """The test items in blocks of about ``block_words`` words; they stream through the driver, one block at a time."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        ids.append(row["i"])
        texts.append(row["t"] or "")
        size += len(texts[-1]) // 2 + 1
        if size >= block_words:
            yield Queries(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Queries(ids, texts, window)


def _first_blocks(items: DataFrame, window: int, block_words: int, item_id: str = "item_id", text: str = "text") -> tuple[list[Queries], Iterator[Queries]]:
    """The first block or two, and the blocks after them."""
    blocks = read_queries(items, item_id, text, window, block_words)
    return list(islice(blocks, 2)), blocks


def build_index(docs: DataFrame, vocabulary: pa.Array | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the documents (see ``SEGMENT``), one row each; not yet stored.  With a vocabulary, its terms only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in kernels.chunks(batch, "t"):
                s = Segment.of(words := Words(part.column(1), ALNUM, lower=True), vocabulary)
                row = [part.column(0), pa.array(words.count.astype(np.int32)), s.term, pa.array(s.upto.astype(np.int32)), pa.array(s.position.astype(np.int32))]
                yield pa.record_batch([pa.array([number], pa.int64()), *[pa.ListArray.from_arrays([0, len(x)], x) for x in row]], schema=_SEGMENT_ARROW)
                number += 1

    return docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(run, SEGMENT)


def _stored_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, Segment]]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids, count, term, upto, position = (batch.column(i)[r].values for i in range(1, 6))
            whole = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.column(0)[r].as_py(), ids, Segment(whole(count), term.cast(pa.binary()), whole(upto), whole(position))


def _hits(segment: Segment, q: Queries) -> tuple[np.ndarray, list[set[str]]]:
    """Flags of the words inside occurrences, and the items that occur in each document."""
    items: list[set[str]] = [set() for _ in segment.count]
    phrase, start = phrase_starts(segment, q)
    for d, i in np.unique(np.stack([segment.document(start), q.owner[phrase]]), axis=1).T:
        items[d].add(q.ids[i])
    return kernels.cover(int(segment.count.sum()), start, start + q.length[phrase]), items


def _per_document(segment: Segment, hit: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(hit)])
    return before[segment.ends] - before[segment.ends - segment.count]


DIGEST = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def _digest(ids: pa.Array, count: np.ndarray, n_hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    return pa.record_batch(
        [
            ids,
            pa.array(count),
            pa.array(n_hit),
            pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
            pa.array((n_hit > 0) & (20 * n_hit >= count)),
        ],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def contamination(index: DataFrame, block: Queries) -> DataFrame:
    """One row per document of a stored index, by one block of items: see ``DIGEST``."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, segment in _stored_segments(batches):
            hit, items = _hits(segment, shared.value)
            yield _digest(ids, segment.count, _per_document(segment, hit), items)

    return index.mapInArrow(run, DIGEST)


_PASS = "segment bigint, start array<int>, stop array<int>, place array<int>, item array<string>"


def _search_pass(index: DataFrame, block: Queries) -> DataFrame:
    """Stored spans and (document place, item) of each segment with an occurrence from one block."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, segment in _stored_segments(batches):
            hit, items = _hits(segment, shared.value)
            if hit.any():
                edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
                row = {"segment": number, "start": np.flatnonzero(edge == 1), "stop": np.flatnonzero(edge == -1), "place": [d for d, x in enumerate(items) for _ in x], "item": [i for x in items for i in x]}
                yield pa.RecordBatch.from_pylist([row], pa.schema([("segment", pa.int64()), *[(c, pa.list_(pa.int32())) for c in ("start", "stop", "place")], ("item", pa.list_(pa.string()))]))

    found = stage(index.mapInArrow(run, _PASS), "pass")
    shared.destroy()
    return found


def _merged(index: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """``DIGEST`` rows from the passes of several blocks; they meet by segment, with the document ids and counts only."""
    found = reduce(DataFrame.unionAll, passes).groupBy("segment").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("start", "stop", "place", "item")])
    rows = index.select("segment", "doc_id", "n_words").join(found, "segment", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                segment = Segment(np.array(r["n_words"], np.int64), pa.array([], pa.binary()), np.zeros(1, np.int64), np.zeros(0, np.int64))
                items: list[set[str]] = [set() for _ in r["n_words"]]
                for d, i in zip(r["place"] or [], r["item"] or [], strict=True):
                    items[d].add(i)
                hit = kernels.cover(int(segment.count.sum()), np.array(r["start"] or [], np.int64), np.array(r["stop"] or [], np.int64))
                yield _digest(pa.array(r["doc_id"], pa.int64()), segment.count, _per_document(segment, hit), items)

    return rows.mapInArrow(run, DIGEST)


def score_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Build and store the index of ``docs``, search all items, return ``DIGEST`` rows.

    Null and empty texts have no words and are never contaminated; null ids stay null; repeated
    rows and ties give a row each; items without words are never found; empty tables give an
    empty result, or one without hits; other columns are ignored; a very long text is a segment
    of its own.
    """
    first, more = _first_blocks(items, window, block_words)
    if len(first) < 2:
        block = first[0] if first else Queries([], [], window)
        return contamination(stage(build_index(docs, block.vocabulary), "postings"), block)
    index = stage(build_index(docs), "postings")
    passes = []
    for block in (b for part in (first, more) for b in part):
        passes.append(_search_pass(index, block))
    digest = stage(_merged(index, passes), "contamination")
    discard(docs.sparkSession, index, *passes)
    return digest


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Occurrences: doc_id, item_id, phrase (word number in the item), start, end (words, exclusive).

    ``slop`` None: exact phrases; else phrases whose words come in order with at most ``slop`` others between.
    Null and empty texts and items have none; repeated rows give theirs each; empty tables give none.
    """
    index = stage(build_index(docs), "postings")

    def search(block: Queries) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = shared.value
            for _, ids, segment in _stored_segments(batches):
                if slop is None:
                    phrase, a = phrase_starts(segment, q)
                    b = a + q.length[phrase]
                else:
                    phrase, a, b = near_spans(segment, q, slop)
                    b = b + 1
                d = segment.document(a)
                base = (segment.ends - segment.count)[d]
                yield pa.record_batch(
                    [ids.take(pa.array(d)), pa.array([q.ids[o] for o in q.owner[phrase]], pa.string()), pa.array(q.phrase[phrase]), pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())],
                    names=["doc_id", "item_id", "phrase", "start", "end"],
                )

        found = stage(index.mapInArrow(run, "doc_id bigint, item_id string, phrase bigint, start bigint, end bigint"), "matches")
        shared.destroy()
        return found

    found = [search(b) for b in read_queries(items, "item_id", "text", window, block_words)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], "doc_id bigint, item_id string, phrase bigint, start bigint, end bigint")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of ``docs`` that hold no window of a test item, all columns, without a shuffle.

    One occurrence is enough to drop a row, however long its text: the share of hit words only
    decides the column ``contaminated`` of ``score_documents``.  Null and empty texts have no
    words and stay, as do all rows if there are no items; an empty table stays empty; no column
    is renamed or looked at but the text.  The same segments and search as ``score_documents``,
    held in memory per chunk: each row is judged where it is read, so rows that share an id are
    judged apart and repeated rows alike.
    """
    first, more = _first_blocks(items, window, block_words)

    def judged(block: Queries, dirty: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(part.column(part.schema.get_field_index(text)), ALNUM, lower=True)
            segment = Segment.of(words, shared.value.vocabulary)
            n_hit = _per_document(segment, _hits(segment, shared.value)[0])
            return part.filter(pa.array((n_hit > 0) == dirty))

        run = kernels.by_chunk(of, text)
        if not dirty:
            return docs.mapInArrow(run, docs.schema)
        only = docs.select(text)
        found = stage(only.mapInArrow(run, only.schema).select(F.sha2(text, 256).alias("__dirty")).distinct(), "dirty")
        shared.destroy()
        return found

    if len(first) < 2:
        return judged(first[0], False) if first else docs
    # several blocks: each is a pass that writes the checksums of the texts it rejects
    dirty = reduce(DataFrame.unionAll, [judged(b, True) for part in (first, more) for b in part]).distinct()
    return docs.withColumn("__dirty", F.sha2(text, 256)).join(dirty, "__dirty", "left_anti").drop("__dirty")
