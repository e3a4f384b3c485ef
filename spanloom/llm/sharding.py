"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Every record hashes into one of ``slots`` virtual slots, by its key and text.  One aggregation gives the bytes and rows of each slot.  A ``SlotMap``
assigns slots to shards: version 1 by the longest-processing-time rule over slot bytes,
later versions by *edits* that move as few slots as the change needs.  Only the map is
edited; a record never changes its virtual slot.

The driver holds one number per virtual slot, never anything per record.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

SLOTS = 4096
PIECE = 65_536


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record, by its key and text, so that many records of one key or without a key are spread over all slots."""
    hashed = F.xxhash64(F.coalesce(key.cast("string"), F.lit("no key")), text)
    return F.pmod(hashed, F.lit(slots)).cast("int")


def slot_totals(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of every virtual slot (0 for slots without records)."""
    grouped = (
        docs.select(virtual_slot(F.col(key), F.col(text), slots).alias("s"), record_size(F.col(text)).alias("b"))
        .groupBy("s")
        .agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    )
    size, rows = [0] * slots, [0] * slots
    for r in grouped.collect():  # at most one row per virtual slot
        size[r["s"]], rows[r["s"]] = r["b"], r["n"]
    return size, rows


def _array(values: list[int], kind: str) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


@dataclass
class SlotMap:
    """Versions of the map; ``versions[i]`` is the shard of each slot in version ``i + 1``."""

    versions: list[list[int]] = field(default_factory=list)

    @property
    def current(self) -> list[int]:
        return self.versions[-1]

    @property
    def shards(self) -> int:
        return max(self.current) + 1

    @staticmethod
    def balanced(size: list[int], shards: int) -> SlotMap:
        """Version 1: slots by falling bytes, each to the lightest shard so far."""
        heap = [(0, s) for s in range(shards)]
        found = [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda i: (-size[i], i)):
            load, shard = heapq.heappop(heap)
            found[slot] = shard
            heapq.heappush(heap, (load + size[slot], shard))
        return SlotMap([found])

    def _loads(self, size: list[int], shards: int) -> list[int]:
        loads = [0] * shards
        for slot, shard in enumerate(self.current):
            loads[shard] += size[slot]
        return loads

    def grow(self, size: list[int]) -> SlotMap:
        """A further version with one more shard, which only takes slots."""
        new = self.shards
        loads, found = self._loads(size, new + 1), list(self.current)
        goal = sum(size) / (new + 1)
        by_shard = [sorted((s for s, h in enumerate(found) if h == k), key=lambda i: (size[i], -i)) for k in range(new)]
        while loads[new] < goal:
            donor = max(range(new), key=lambda k: (loads[k] if by_shard[k] else -1, -k))
            if not by_shard[donor]:
                break
            slot = by_shard[donor].pop()
            if loads[new] + size[slot] > goal and loads[new] + size[slot] - goal > goal - loads[new]:
                continue
            loads[donor] -= size[slot]
            loads[new] += size[slot]
            found[slot] = new
        return SlotMap([*self.versions, found])

    def rebalance(self, size: list[int], tolerance: float = 0.01) -> SlotMap:
        """A further version after bytes have changed: slots leave the heaviest shard for the
        lightest while that narrows the gap, until all are within ``tolerance`` of the mean."""
        found, shards = list(self.current), self.shards
        loads = self._loads(size, shards)
        mean = sum(size) / shards
        while True:
            high, low = max(range(shards), key=loads.__getitem__), min(range(shards), key=loads.__getitem__)
            gap = loads[high] - loads[low]
            movable = [s for s, h in enumerate(found) if h == high and 0 < size[s] < gap]
            if gap <= tolerance * mean or not movable:
                return SlotMap([*self.versions, found])
            slot = min(movable, key=lambda s: (abs(size[s] - gap / 2), s))
            found[slot] = low
            loads[high] -= size[slot]
            loads[low] += size[slot]

    def shard_of(self, slot: Column, version: int | None = None) -> Column:
        return F.get(_array(self.versions[(version or len(self.versions)) - 1], "int"), slot)

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard) rows."""
        slots = spark.range(0, len(self.current), 1, 1).select(F.col("id").cast("int").alias("slot"))
        parts = [slots.select(F.lit(v).alias("version"), "slot", self.shard_of(F.col("slot"), v).alias("shard")) for v in range(1, len(self.versions) + 1)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SlotMap:
        """Read what ``save`` wrote: one row per slot and version."""
        rows = spark.read.parquet(path).collect()
        versions: list[list[int]] = [[0] * (1 + max(r["slot"] for r in rows)) for _ in range(max(r["version"] for r in rows))]
        for r in rows:
            versions[r["version"] - 1][r["slot"]] = r["shard"]
        return SlotMap(versions)


def place(docs: DataFrame, slot_map: SlotMap, rows: list[int], key: str = "doc_id") -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0, to rows with ``virtual_slot``.

    ``rows`` are the row counts per virtual slot.  A place is the rows of the shard's earlier
    virtual slots plus the rank within the own one, so the only shuffle is by virtual slot and
    no task sees a whole shard.  Rank is by key, then text checksum; rows equal in both are
    interchangeable.  Columns of ``docs`` with these names are replaced.  Only rows equal in key
    and text cannot be parted: they are sorted in one task, which holds none of their texts.
    """
    shards = slot_map.current
    filled: dict[int, int] = {}
    first = []
    for slot, shard in enumerate(shards):
        first.append(filled.get(shard, 0))
        filled[shard] = first[-1] + rows[slot]
    v = F.col("virtual_slot")
    order = Window.partitionBy("virtual_slot").orderBy(F.col(key).asc_nulls_first(), F.col("text_crc32"), F.col("size"))
    return (
        docs.withColumn("shard", slot_map.shard_of(v))
        .withColumn("slot", F.get(_array(first, "bigint"), v) + F.row_number().over(order) - 1)
    )


def place_in_order(docs: DataFrame, slot_map: SlotMap, piece: int = PIECE) -> DataFrame:
    """Add ``shard`` and ``slot`` as ``place`` does, but along ``written`` (part, file, row), which is dropped.

    Files are cut into pieces of ``piece`` rows.  A place is the shard's rows in earlier pieces plus
    the rank within the own one, so no task sees more of a shard than a piece of a file, or one
    count for each piece.
    """
    cut = {"__part": F.col("written.part"), "__file": F.col("written.file"), "__piece": F.expr(f"written.row div {piece}"), "__row": F.col("written.row")}
    keyed = docs.withColumns({"shard": slot_map.shard_of(F.col("virtual_slot")), **cut}).drop("written")
    group = ["shard", "__part", "__file", "__piece"]
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy("__row")))
    placed = ranked.join(first, group).withColumn("slot", F.col("__first") + F.col("__rank") - 1)
    return placed.drop(*group[1:], "__row", "__first", "__rank")


def shard_documents(
    docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None, key: str = "doc_id", text: str = "text", ordered: bool = False, piece: int = PIECE
) -> DataFrame:
    """Put every row of ``docs`` into a shard so that shard bytes are near equal.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under
    this law), virtual_slot, map_version.  Null texts count one byte and have the checksum of
    the empty text; records of one key and those without are spread by text; repeated rows each get
    a place of their own; an empty table gives an empty result; other columns are ignored; a very
    long text counts whole, and its shard gets fewer others.  The map is stored at
    ``map_path`` (default: the shared folder) and used as read back from there.  With ``ordered``
    the places in each shard follow the order in which the rows of ``docs`` were written (see
    ``staging.written_order``), else that of virtual slots; the shards are the same.
    """
    from .staging import new_path, written_order

    spark = docs.sparkSession
    docs, written = written_order(docs) if ordered else (docs, None)
    size, rows = slot_totals(docs, key, text, slots)
    path = map_path or new_path(spark, "slot-map")
    SlotMap.balanced(size, shards).save(spark, path)
    slot_map = SlotMap.load(spark, path)
    lean = docs.select(
        F.col(key).alias("doc_id"),
        record_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        virtual_slot(F.col(key), F.col(text), slots).alias("virtual_slot"),
        *([written.alias("written")] if ordered else []),
    )
    placed = place_in_order(lean, slot_map, piece) if ordered else place(lean, slot_map, rows)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(len(slot_map.versions)).alias("map_version"),
    )
