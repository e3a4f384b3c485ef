"""Toxicity by compression distance: how much shorter do toxic and ordinary dictionaries make a window?

Two zstandard dictionaries are trained on labelled text by zstandard's own trainer, one on windows
of ordinary documents, one on the passages of toxic documents that make them so.  A label holds for
a whole document, so those passages must be found first: words with a byte fragment that is much
commoner in toxic documents than in ordinary ones and that stands in many different contexts (a
fragment that only copies of one document share has few).  The toxic compressor has the ordinary
content too, so the gain of a window, its length under the ordinary dictionary less its length
under the toxic one, is 0 for ordinary language and positive where toxic wording is matched.

Two thresholds are calibrated on labelled documents that did not train the dictionaries.  Windows
whose gain reaches the first one count; a document is toxic if the sum of their gains, over the
square root of its number of windows (a longer text has more chance matches), reaches the second.
The score is that evidence against the threshold: 0.5 where they are equal.

Bounds: at most ``DICTIONARY_DOCS`` documents a class and ``CALIBRATION_DOCS`` in all are
fitted on, the first by hash of their id, none over ``TRAIN_CHARS`` characters.  Every text is
scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

DICTIONARY_DOCS = 1500
CALIBRATION_DOCS = 4000
TRAIN_CHARS = 20_000
WINDOW_WORDS = 5
ORDINARY_BYTES, TOXIC_BYTES = 8192, 4096
#: Segments of the toxic dictionary's trainer and the length of what it counts: insults are short.
TOXIC_SEGMENT, TOXIC_GRAM = 32, 6
#: What a clean document called toxic weighs against a toxic one missed, in calibration.
CLEAN_WEIGHT = 4
MAX_GAIN = 6
FRAGMENT = 5
SIGNIFICANT = 20.0
LEVEL = 9
_TRIM = b".,;:!?"


def windows(text: bytes) -> list[bytes]:
    """Consecutive windows of words, lower-cased, each with a space at both ends; the last may be shorter."""
    w = text.lower().split()
    return [b" " + b" ".join(w[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(w), WINDOW_WORDS)]


def _fragments(word: bytes) -> set[bytes]:
    padded = b" " + word + b" "
    return {padded[i : i + FRAGMENT] for i in range(len(padded) - FRAGMENT + 1)}


def marked_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of the toxic texts with a fragment that marks them, once per occurrence."""

    def spread(texts: list[bytes]) -> Counter:
        found: Counter = Counter()
        for t in texts:
            found.update(set().union(*map(_fragments, {w.strip(_TRIM) for w in t.lower().split()})))
        return found

    in_toxic, in_ordinary = spread(toxic), spread(ordinary)
    share = len(toxic) / (len(toxic) + len(ordinary) or 1)
    least = max(3, len(toxic) * 3 // 1000)

    def marks_toxic(n: int, other: int) -> bool:
        """A tenfold rate, too far from chance (G statistic) to be one of many fragments' luck."""
        both = n + other
        g = 2 * (n * np.log(n / (both * share)) + (other * np.log(other / (both * (1 - share))) if other else 0))
        return n * (1 - share) >= 10 * share * other and g >= SIGNIFICANT

    common = {f for f, n in in_toxic.items() if n >= least and marks_toxic(n, in_ordinary[f])}
    contexts: dict[bytes, set] = defaultdict(set)
    seen: Counter = Counter()
    for t in toxic:
        w = [b"", *(x.strip(_TRIM) for x in t.lower().split()), b""]
        for i in range(1, len(w) - 1):
            for f in _fragments(w[i]) & common:
                contexts[f].add((w[i - 1], w[i + 1]))
                seen[f] += 1
    marks = {f for f in common if len(contexts[f]) >= least and len(contexts[f]) >= 0.6 * seen[f]}
    return [b" " + w + b" " for t in toxic for x in t.lower().split() if not marks.isdisjoint(_fragments(w := x.strip(_TRIM)))]


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """Content of a dictionary trained on the samples; too few of them are the content themselves."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=64, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=known)


@dataclass
class Model:
    """``threshold``: least gain of a window that counts; ``limit``: evidence of a toxic document, 0 if nothing was learned."""

    ordinary: bytes
    toxic: bytes
    threshold: int = 1
    limit: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def gains(self, text: bytes) -> np.ndarray:
        if not hasattr(self, "_pair"):
            self._pair = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        plain, other = self._pair[0].compress, self._pair[1].compress
        return np.array([len(plain(w)) - len(other(w)) for w in windows(text)] or [0], np.int64)

    def score(self, text: bytes) -> float:
        if not self.limit:
            return 0.0
        found = evidence(self.gains(text), self.threshold)
        return found / (found + self.limit)


def evidence(gain: np.ndarray, threshold: int) -> float:
    return float(gain[gain >= threshold].sum() / len(gain) ** 0.5)


def calibrated(gains: list[np.ndarray], labels: np.ndarray) -> tuple[int, float]:
    """The window threshold and the limit that serve the labels best: share of toxic documents found plus ``CLEAN_WEIGHT`` times that of clean ones left alone."""
    best = (-1.0, 1, 0.0)
    for threshold in range(1, MAX_GAIN + 1):
        found = np.array([evidence(g, threshold) for g in gains])
        order = np.argsort(-found, kind="stable")
        toxic = np.cumsum(labels[order])
        clean = np.cumsum(1 - labels[order])
        value = toxic / labels.sum() + CLEAN_WEIGHT * (1 - clean / (1 - labels).sum())
        last = np.append(found[order][1:] < found[order][:-1], True) & (found[order] > 0)  # equal evidence falls together
        if last.any():
            i = int(np.argmax(np.where(last, value, -1)))
            below = found[order][found[order] < found[order][i]].max(initial=0.0)
            best = max(best, (float(value[i]), threshold, float((found[order][i] + below) / 2) or float(found[order][i])))
    return best[1], best[2]


def fit(toxic: list[bytes], ordinary: list[bytes], calibration: list[tuple[bytes, int]]) -> Model:
    """Dictionaries from the first two, thresholds from the third; without both classes every score is 0."""
    plain = [w for t in ordinary for w in windows(t)]
    marked = marked_words(toxic, ordinary)
    model = Model(_trained(plain, ORDINARY_BYTES), _trained(marked, TOXIC_BYTES, k=TOXIC_SEGMENT, d=TOXIC_GRAM))
    labels = np.array([y for _, y in calibration], np.int64)
    if marked and 0 < labels.sum() < len(labels):
        model.threshold, model.limit = calibrated([model.gains(t) for t, _ in calibration], labels)
    return model


def held_out(doc_id: str):
    """Rows never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out, within the bounds of this module.

    Rows without id, label or text are passed over; an id labelled twice has its higher label.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & ~held_out(doc_id)).groupBy(doc_id).agg((F.max(label) > 0).cast("int").alias("y"))
    short = docs.where(F.col(text).isNotNull() & (F.length(text) <= TRAIN_CHARS)).select(doc_id, text)
    spread = F.xxhash64(doc_id)
    # ids of a bounded sample, more than needed since some have no short text
    part = lambda c, n: known.where(c).orderBy(spread).limit(n).select(doc_id, "y", F.lit(n).alias("take"))
    sample = part("y = 1", 2 * DICTIONARY_DOCS).unionAll(part("y = 0", 4 * DICTIONARY_DOCS))
    rows = short.join(F.broadcast(sample), doc_id).select(doc_id, "y", text, spread.alias("h")).dropDuplicates([doc_id]).collect()
    rows.sort(key=lambda r: r["h"])
    toxic, ordinary = ([r for r in rows if r["y"] == y] for y in (1, 0))
    a, b = _learned(len(toxic)), _learned(len(ordinary))
    rest = toxic[a:], ordinary[b:]
    # calibration keeps the corpus's own share of toxic documents
    share = known.agg(F.avg("y")).first()[0] or 0.0
    most = min(CALIBRATION_DOCS, len(rest[0]) / share if share else 0, len(rest[1]) / (1 - share) if share < 1 else 0)
    calibration = [*rest[0][: round(most * share)], *rest[1][: round(most * (1 - share))]]
    raw = lambda rs: [r[text].encode() for r in rs]
    return fit(raw(toxic[:a]), raw(ordinary[:b]), [(r[text].encode(), r["y"]) for r in calibration])


def _learned(n: int) -> int:
    """Documents of a class that train dictionaries: two thirds of the sample, up to the bound."""
    return min(DICTIONARY_DOCS, n * 2 // 3)


def _scores(column: pa.Array, model: Model) -> pa.Array:
    texts = pc.cast(pc.fill_null(column, ""), pa.binary())
    return pa.array([model.score(t.as_py()) for t in texts], pa.float64())


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null texts count as empty and have a score too (that of a text without gains); rows without
    an id are not held out; repeated rows have equal scores; without labels of both classes
    every score is 0; an empty table gives an empty result; other columns are never looked at;
    very long texts are scored whole.
    """
    model = train(docs, labels, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch.column(2), model)
            predicted = pc.cast(pc.greater_equal(score, 0.5), pa.int32())
            yield pa.record_batch([batch.column(0), batch.column(1), score, predicted], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def ordinary_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Rows of ``docs`` with a score under 0.5, all columns; texts are treated as by ``score_documents``."""

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        score = _scores(part.column(part.schema.get_field_index(text)), model)
        return part.filter(pc.less(score, 0.5))

    return docs.mapInArrow(kernels.by_chunk(of, text), docs.schema)
