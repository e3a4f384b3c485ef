"""Texts that arrive in chunks: incremental normalization and profiles, in batch and as streams.

Chunks are rows (stream_id, chunk_no, chunk, last); those of one stream come in order of
``chunk_no``, each once, ``last`` marking the end.  A chunk is a string or UTF-8 bytes, which may be
cut inside a character.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPOSING = {"NFC", "NFKC"}


def _starts_anew(c: str, form: str) -> bool:
    """Nothing before this character can change by what comes from it on."""
    if c < "\u0300":
        return True
    decomposed = unicodedata.normalize("NFKD" if "K" in form else "NFD", c)
    if unicodedata.combining(decomposed[0]):
        return False
    # Hangul vowels and finals, and the few starters that compose with one before them
    cp = ord(decomposed[0])
    return not (0x1161 <= cp <= 0x11FF or form in _COMPOSING and _composes_back(decomposed[0]))


def _composes_back(c: str) -> bool:
    return c in _SECOND_STARTERS


def _second_starters() -> frozenset[str]:
    """Starters that stand second in a canonical composition, by their decompositions."""
    found = set()
    for cp in range(0x300, 0x20000):
        d = unicodedata.decomposition(chr(cp)).split()
        if len(d) == 2 and not d[0].startswith("<") and not unicodedata.combining(chr(int(d[1], 16))):
            found.add(chr(int(d[1], 16)))
    return frozenset(found)


_SECOND_STARTERS = _second_starters()


class Normalizer:
    """Feeds of one stream: ``feed`` gives what is closed, ``finish`` the rest."""

    def __init__(self, form: str, carry: str = "", partial: bytes = b""):
        if form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError(f"NORMALIZATION_FORM_UNSUPPORTED: {form}")
        self.form, self.carry, self.partial = form, carry, partial

    def feed(self, chunk: str | bytes | None) -> str:
        if isinstance(chunk, bytes | bytearray):
            decoder = codecs.getincrementaldecoder("utf-8")("strict")
            text = decoder.decode(self.partial + bytes(chunk))
            self.partial = decoder.getstate()[0]
        else:
            text = chunk or ""
        text = self.carry + text
        cut = len(text) - 1
        while cut > 0 and not _starts_anew(text[cut], self.form):
            cut -= 1
        closed, self.carry = text[: max(cut, 0)], text[max(cut, 0) :]
        return unicodedata.normalize(self.form, closed)

    def finish(self) -> str:
        if self.partial:
            raise ValueError("INVALID_UTF8: the stream ends inside a character")
        out, self.carry = unicodedata.normalize(self.form, self.carry), ""
        return out


OUT = "stream_id string, chunk_no long, output string"
_STATE = "carry string, partial binary"


def normalize_chunks(chunks: DataFrame, form: str = "NFC") -> DataFrame:
    """(stream_id, chunk_no, output) of a batch of chunks: joined, the outputs of a stream are its normalized text.

    Streams are dealt by id, and one is held by one task a batch at a time.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, out = Normalizer(form), []
        for r in rows.sort_values("chunk_no").itertuples():
            text = n.feed(r.chunk)
            out.append((key[0], int(r.chunk_no), text + n.finish() if r.last else text))
        if n.carry:
            out[-1] = (*out[-1][:2], out[-1][2] + n.finish())
        return pd.DataFrame(out, columns=["stream_id", "chunk_no", "output"])

    return chunks.groupBy("stream_id").applyInPandas(run, OUT)


def normalize_stream(chunks: DataFrame, form: str = "NFC") -> DataFrame:
    """``normalize_chunks`` over a streaming table: the open end of each stream is kept as state until it closes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        carry, partial = state.get if state.exists else ("", b"")
        n, out, done = Normalizer(form, carry, bytes(partial)), [], False
        for r in pd.concat(list(batches)).sort_values("chunk_no").itertuples():
            text = n.feed(r.chunk)
            done = bool(r.last)
            out.append((key[0], int(r.chunk_no), text + n.finish() if done else text))
        if done:
            state.remove()
        else:
            state.update((n.carry, n.partial))
        yield pd.DataFrame(out, columns=["stream_id", "chunk_no", "output"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, T._parse_datatype_string(OUT), T._parse_datatype_string(_STATE), "append", "NoTimeout")


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_id, text) of string chunks: segments cross chunk borders, so a profile needs the whole text."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return chunks.groupBy(F.col("stream_id").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: F.coalesce(x["chunk"], F.lit(""))), "").alias("text"))


def profile_chunks(chunks: DataFrame) -> DataFrame:
    """Surface profiles of texts given in chunks."""
    from spanloom.operators.packs import surface_profiles

    return surface_profiles(joined_chunks(chunks))
