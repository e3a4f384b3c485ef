"""Rows and counts of texts in Arrow batches of bounded size.

A worker holds the texts of one batch as Arrow has them, the values of about ``ROWS`` rows or
``CHARS`` characters, and at most about ``ENTRIES`` counts: its memory follows none of the rows
of a batch, the tokens of its texts or the size of the corpus (one text is taken whole).
"""

from __future__ import annotations

import gc
import itertools
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

#: Rows of a batch that leaves a worker.
ROWS = 20_000
#: Characters of the texts whose rows are made together.
CHARS = 1 << 20
#: Counts that a worker holds.
ENTRIES = 100_000


class _Column:
    """Values of one Arrow column; a list is given as (sizes, flat values), a struct as its fields' columns."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.values = kind, []
        self.parts = [_Column(kind.value_type)] if pa.types.is_list(kind) else [_Column(f.type) for f in kind] if pa.types.is_struct(kind) else []

    def add(self, got: Iterable) -> None:
        if pa.types.is_list(self.kind):
            self.values.extend(got[0])
            self.parts[0].add(got[1])
        elif self.parts:
            for part, x in zip(self.parts, got, strict=True):
                part.add(x)
        else:
            self.values.extend(got)

    def take(self) -> pa.Array:
        """What was added, which is then gone."""
        values, self.values = self.values, []
        if pa.types.is_list(self.kind):
            ends = pa.array(itertools.accumulate(values, initial=0), pa.int32())
            return pa.ListArray.from_arrays(ends, self.parts[0].take(), type=self.kind)
        if self.parts:
            return pa.StructArray.from_arrays([p.take() for p in self.parts], fields=list(self.kind))
        return pa.array(values, self.kind)


def _schema(docs: DataFrame, kept: list[str], kind: str, place: str | None = None) -> StructType:
    numbered = [StructField(place, IntegerType(), False)] if place else []
    return StructType([*[docs.schema[c] for c in kept], *numbered, *StructType.fromDDL(kind).fields])


def _texts(batch: pa.RecordBatch, n: int) -> Iterator[list[tuple]]:
    """(row, text, ...) of the last ``n`` columns, some ``CHARS`` characters at a time."""
    columns, part, size = batch.columns[-n:], [], 0
    for i in range(batch.num_rows):
        values = [c[i].as_py() for c in columns]
        part.append((i, *values))
        size += sum(len(x) for x in values if isinstance(x, str | bytes))
        if size >= CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _map(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow``; the many small values made on the way hold no cycles, so that no time goes into looking for them."""

    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return docs.mapInArrow(quiet, schema)


def exploded(docs: DataFrame, kept: list[str], column: str, kind: str, make: Callable[[str], tuple], place: str | None = None, many: Callable[[list[str]], Iterable[tuple]] | None = None) -> DataFrame:
    """``kept``, then a row for each item of a text, numbered by ``place``; null texts have none.

    ``make`` gives the columns of ``kind`` of one text, each as a list, or as ``_Column`` takes it; ``many`` those of several texts.
    """
    schema = _schema(docs, kept, kind, place)
    arrow = to_arrow_schema(schema)
    first = len(kept) + bool(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [_Column(f.type) for f in list(arrow)[first:]]
        for batch in batches:
            at: list[int] = []
            places: list[int] = []

            def full() -> Iterator[pa.RecordBatch]:
                where = pa.array(at, pa.int32())
                numbers = [pa.array(places, pa.int32())] if place else []
                out = pa.RecordBatch.from_arrays([*[c.take(where) for c in batch.columns[:-1]], *numbers, *[c.take() for c in columns]], schema=arrow)
                at.clear()
                places.clear()
                for i in range(0, out.num_rows, ROWS):
                    yield out.slice(i, ROWS)

            for part in _texts(batch, 1):
                known = [(i, x) for i, x in part if x is not None]
                found = many([x for _, x in known]) if many else (make(x) for _, x in known)
                for (i, _), got in zip(known, found, strict=True):
                    n = len(got[0])
                    if not n:
                        continue
                    at.extend(itertools.repeat(i, n))
                    if place:
                        places.extend(range(n))
                    for c, x in zip(columns, got, strict=True):
                        c.add(x)
                    if len(at) >= ROWS:
                        yield from full()
            if at:
                yield from full()

    return _map(docs.select(*kept, column), run, schema)


def each(docs: DataFrame, kept: list[str], columns: list[str], kind: str, make: Callable[..., tuple], nulls: bool = True) -> DataFrame:
    """``kept``, then what ``make`` gives for the texts of ``columns``, in one row each.

    For a single column a null text has nulls only; ``make`` gets the nulls of several.
    """
    schema = _schema(docs, kept, kind)
    arrow = to_arrow_schema(schema)
    n, width = len(columns), len(schema) - len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [_Column(f.type) for f in list(arrow)[len(kept) :]]
        for batch in batches:
            done = 0
            for part in _texts(batch, n):
                for _, *texts in part:
                    got = (None,) * width if n == 1 and texts[0] is None else make(*texts)
                    for c, x in zip(made, got, strict=True):
                        c.values.append(x)
                yield pa.RecordBatch.from_arrays([*[c.slice(done, len(part)) for c in batch.columns[:-n]], *[c.take() for c in made]], schema=arrow)
                done += len(part)

    return _map(docs.select(*kept, *columns), run, schema)


def _leave(counts: Counter, arrow: pa.Schema, keys: int, front: list) -> Iterator[pa.RecordBatch]:
    """The rows of counts in batches; ``front``: values before the keys."""
    items = iter(counts.items())
    while part := list(itertools.islice(items, ROWS)):
        names = [[k for k, _ in part]] if keys == 1 else [[k[j] for k, _ in part] for j in range(keys)]
        values = [*[[x] * len(part) for x in front], *names, [n for _, n in part]]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)


def counted(docs: DataFrame, groups: list[str], column: str, kind: str, items: Callable[[str], Iterable]) -> DataFrame:
    """(groups, the columns of ``kind``, count): how often ``items`` names each key in the texts of a group.

    A key is a value, or a tuple if ``kind`` has several columns.  Workers add up what they can hold, so that sums are shuffled.
    """
    keys = StructType.fromDDL(kind).fieldNames()
    schema = _schema(docs, groups, f"{kind},count:bigint")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = {}
        size = 0
        for batch in batches:
            for part in _texts(batch, len(groups) + 1):
                for _, *group, x in part:
                    if x is not None:
                        if (counts := held.get(name := tuple(group))) is None:
                            counts = held[name] = Counter()
                        size -= len(counts)
                        counts.update(items(x))
                        size += len(counts) + 1
                        if size >= ENTRIES:
                            for name, counts in held.items():
                                yield from _leave(counts, arrow, len(keys), list(name))
                            held, size = {}, 0
        for name, counts in held.items():
            yield from _leave(counts, arrow, len(keys), list(name))

    return _map(docs.select(*groups, column), run, schema).groupBy(*groups, *keys).agg(F.sum("count").alias("count"))


def by_document(docs: DataFrame, id_column: str, column: str, kind: str, make: Callable[[Iterable[str]], tuple | None]) -> DataFrame:
    """One row for each id of what ``make`` gives for all its texts, none where that is None; null texts are left out, null ids are one id.

    The texts are shuffled by id and taken one at a time.
    """
    schema = _schema(docs, [id_column], kind)
    arrow = to_arrow_schema(schema)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for part in _texts(batch, 2):
                for _, key, x in part:
                    yield key, x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for key, group in itertools.groupby(texts(batches), key=lambda r: r[0]):
            got = make(x for _, x in group if x is not None)
            if got is not None:
                made.append((key, *got))
            if len(made) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
                made.clear()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return _map(docs.select(id_column, column).repartition(F.col(id_column)).sortWithinPartitions(id_column), run, schema)
