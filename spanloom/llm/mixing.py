"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in hash order, are cut into blocks of about ``block_bytes``.  With
target weight w, block j (from 1) of a source is released at slot floor((j-1)/w) and due at
slot ceil(j/w); slots are dealt one block each, earliest deadline first among the released.
With weights that add to 1 every block meets its deadline, so after any number of slots each
source is less than one block away from its target.

Weights are taken exactly as given.  The schedule repeats after their common denominator: where
a phase is longer than that, one cycle is simulated and block j finds its slot by arithmetic,
else the phase itself is.  The driver simulates, keeping only the counts at every ``period``
slots; executors replay the pieces between.  When a source runs
out its share is dealt to the others in proportion, and the schedule goes on from there
(``phase``); nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

PERIOD = 1000
BLOCK_BYTES = 65536
BUCKETS = 4096
BROADCAST_SLOTS = 200_000


def exact_shares(weights: list[Fraction]) -> list[int]:
    """The least whole numbers in exactly the proportion of ``weights``; their sum is the period."""
    scale = lcm(*[w.denominator for w in weights])
    whole = [int(w * scale) for w in weights]
    common = gcd(*whole)
    return [w // common for w in whole]


def exact_weight(value: float) -> Fraction:
    """A weight as it is written: the decimal 0.1 is 1/10."""
    got = Fraction(str(value)) if isinstance(value, float) else Fraction(value)
    if got <= 0:
        raise ValueError(f"weight {value} is not positive")
    return got


def windows(share: int, period: int, j: int) -> tuple[int, int]:
    """Release and deadline of block ``j`` (from 1) of a source with ``share`` of ``period`` slots."""
    return (j - 1) * period // share, -(-j * period // share)


def deal(shares: list[int], done: list[int], start: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Earliest deadline first from slot ``start``, where ``done`` blocks of each source are dealt.

    Gives (source, block from 0, release, deadline) of each slot, without end.
    """
    period = sum(shares)
    waiting = [(windows(s, period, d + 1)[0], k, d + 1) for k, (s, d) in enumerate(zip(shares, done, strict=True))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    t = start
    while True:
        while waiting and waiting[0][0] <= t:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (windows(shares[k], period, j)[1], k, j, release))
        due, k, j, release = heapq.heappop(ready)
        assert t < due
        yield k, j - 1, release, due
        heapq.heappush(waiting, (windows(shares[k], period, j + 1)[0], k, j + 1))
        t += 1


def schedule(shares: list[int]) -> list[tuple[int, int]]:
    """One period of earliest-deadline-first: (source, block from 0) of each slot."""
    return [(k, j) for k, j, _, _ in islice(deal(shares, [0] * len(shares)), sum(shares))]


def phases(blocks: list[int], weights: list[Fraction], period: int) -> list[dict]:
    """Cut the run into phases at whose ends a source runs out.

    Each phase has the live sources, their shares, the first block of each, the first slot, how
    many blocks of each it takes and the pieces to replay: (slot, end, blocks dealt before).  They
    cover ``length`` slots, one cycle, or the whole phase where ``length`` is 0.
    """
    done, out, start = [0] * len(blocks), [], 0
    while live := [k for k in range(len(blocks)) if done[k] < blocks[k]]:
        shares = exact_shares([weights[k] for k in live])
        length = sum(shares)
        whole = min((blocks[k] - done[k]) // s for k, s in zip(live, shares, strict=True))
        left = [blocks[k] - done[k] - whole * s for k, s in zip(live, shares, strict=True)]
        step = max(period, 16 * len(live))
        dealt, took, cut, pieces = [0] * len(live), None, 0, []
        for t, (k, j, _, _) in enumerate(deal(shares, dealt)):
            if took is None and j >= left[k]:
                cut, took = t, list(dealt)
            if took is not None and (whole == 0 or t == length):
                break
            if t % step == 0:
                pieces.append((t, list(dealt)))
            dealt[k] += 1
        ends = [at for at, _ in pieces[1:]] + [t]
        took = [whole * s + n for s, n in zip(shares, took, strict=True)]
        slots = whole * length + cut
        out.append(
            {"live": live, "shares": shares, "first": [done[k] for k in live], "start": start, "slots": slots, "took": took, "length": length if whole else 0}
            | {"pieces": [(at, end, n) for (at, n), end in zip(pieces, ends, strict=True)]}
        )
        for i, k in enumerate(live):
            done[k] += took[i]
        start += slots
    return out


def _blocks(docs: DataFrame, block_bytes: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's block, and (source, total); no task holds a whole source."""
    docs = docs.drop(*[c for c in docs.columns if c.startswith(("mix_", "__mix_"))])
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    keyed = docs.withColumns({"__mix_size": size, "__mix_hash": F.xxhash64("doc_id", "text"), "__mix_key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))})
    keyed = keyed.withColumn("__mix_bucket", F.shiftrightunsigned("__mix_hash", 40) % buckets)
    sums = keyed.groupBy("__mix_key", "__mix_bucket").agg(F.sum("__mix_size").alias("__mix_sum"))
    before = Window.partitionBy("__mix_key").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__mix_key", "__mix_bucket", F.coalesce(F.sum("__mix_sum").over(before), F.lit(0)).alias("__mix_offset"))
    inside = Window.partitionBy("__mix_key", "__mix_bucket").orderBy("__mix_hash", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    placed = (  # the join finds the rows in the window's order, so texts are sorted once
        keyed.withColumn("__mix_inside", F.coalesce(F.sum("__mix_size").over(inside), F.lit(0)))
        .join(offsets, ["__mix_key", "__mix_bucket"])
        .withColumn("mix_block", F.expr(f"(__mix_offset + __mix_inside) div {block_bytes}"))
    )
    return placed, sums.groupBy("__mix_key").agg(F.sum("__mix_sum").alias("__mix_total"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, period: int = PERIOD, buckets: int = BUCKETS) -> DataFrame:
    """Give every document its place in the mixture: slot ``mix_slot``, then ``mix_hash`` inside it.

    Adds mix_block (from 0 in its source), mix_phase, mix_release, mix_deadline, mix_slot and
    mix_hash; all rows and all other columns of ``docs`` are kept, but for columns with names
    that start with mix_ or __mix_.  ``weights`` maps sources to
    positive weights (default: every source the same; sources not named: the smallest weight
    named); ``period`` is the least number of slots replayed as one piece.  A null source is a source of its own; null and empty texts count one byte; a
    document longer than a block leaves the block numbers it spans empty, as it uses their
    share; repeated rows are rows; an empty table gives an empty result.
    """
    return _mixed(docs, weights, block_bytes, period, buckets)[0]


def mix_in_order(docs: DataFrame, parts: int, weights: dict[str | None, float] | None = None, block_bytes: int = BLOCK_BYTES, period: int = PERIOD, buckets: int = BUCKETS) -> DataFrame:
    """What ``mix`` gives in ``parts`` partitions that follow the schedule, as do the rows of each, by ``mix_slot`` and ``mix_hash``.

    Each takes an equal run of slots, so of bytes.  The number of slots is known, so the texts are
    not gone through a first time to find ranges, as ``repartitionByRange`` does.
    """
    mixed, slots = _mixed(docs, weights, block_bytes, period, buckets)
    part = F.expr(f"mix_slot * {parts} div {max(1, slots)}").cast("int")
    return mixed.repartitionById(parts, part).sortWithinPartitions("mix_slot", "mix_hash")


def _mixed(docs: DataFrame, weights: dict[str | None, float] | None, block_bytes: int, period: int, buckets: int) -> tuple[DataFrame, int]:
    """What ``mix`` gives, and the number of slots of the schedule."""
    spark = docs.sparkSession
    placed, totals = _blocks(docs, block_bytes, buckets)
    counted = sorted((r["__mix_key"], -(-r["__mix_total"] // block_bytes)) for r in totals.collect())  # a name and a number for each source
    named = {"n" if k is None else f"s{k}": exact_weight(v) for k, v in (weights or {}).items()}
    least = min(named.values(), default=Fraction(1))
    names = [s for s, _ in counted]
    given = [named.get(s, least) for s in names]
    runs = phases([n for _, n in counted], given, period)

    rows, pieces = [], []
    for p, run in enumerate(runs):
        for i, k in enumerate(run["live"]):
            share = run["shares"][i] if run["length"] else max(1, run["took"][i])
            rows.append((names[k], p, run["first"][i], run["first"][i] + run["took"][i], share, run["length"], run["start"]))
        pieces += [(p, at, end, run["live"], dealt) for at, end, dealt in run["pieces"]]
    spans = spark.createDataFrame(rows, "__mix_key string, mix_phase int, __mix_first_ long, __mix_end_ long, __mix_share_ long, __mix_length_ long, __mix_start_ long")
    table = _replay(spark.createDataFrame(pieces, "p int, at long, end long, live array<int>, dealt array<long>"), names, given)
    if sum(end - at for _, at, end, _, _ in pieces) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    rel = F.col("mix_block") - F.col("__mix_first_")
    cycle = F.col("__mix_start_") + F.expr("(mix_block - __mix_first_) div __mix_share_") * F.col("__mix_length_")
    out = (
        placed.join(F.broadcast(spans), (placed["__mix_key"] == spans["__mix_key"]) & F.col("mix_block").between(F.col("__mix_first_"), F.col("__mix_end_") - 1))
        .drop(spans["__mix_key"])
        .withColumn("__mix_j_", F.pmod(rel, F.col("__mix_share_")))
        .join(table, ["__mix_key", "mix_phase", "__mix_j_"])
    )
    out = out.select(
        *[c for c in docs.columns if not c.startswith(("mix_", "__mix_"))],
        "mix_block",
        "mix_phase",
        (cycle + F.col("__mix_release_")).alias("mix_release"),
        (cycle + F.col("__mix_due_")).alias("mix_deadline"),
        (cycle + F.col("__mix_slot_")).alias("mix_slot"),
        F.col("__mix_hash").alias("mix_hash"),
    )
    return out, sum(run["slots"] for run in runs)


def _taken(run: dict, i: int) -> int:
    return run["took"][i]


def _replay(pieces: DataFrame, names: list[str], weights: list[Fraction]) -> DataFrame:
    """Slot, release and deadline of each block of the pieces, counted from the start of the phase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                shares = exact_shares([weights[k] for k in x["live"]])
                got = list(islice(deal(shares, x["dealt"], x["at"]), x["end"] - x["at"]))
                yield pa.record_batch(
                    [
                        pa.array([names[x["live"][k]] for k, _, _, _ in got], pa.string()),
                        pa.array([x["p"]] * len(got), pa.int32()),
                        pa.array([j for _, j, _, _ in got], pa.int64()),
                        pa.array(range(x["at"], x["end"]), pa.int64()),
                        pa.array([r for _, _, r, _ in got], pa.int64()),
                        pa.array([min(d, 2**62) for _, _, _, d in got], pa.int64()),
                    ],
                    names=["__mix_key", "mix_phase", "__mix_j_", "__mix_slot_", "__mix_release_", "__mix_due_"],
                )

    return pieces.mapInArrow(run, "__mix_key string, mix_phase int, __mix_j_ long, __mix_slot_ long, __mix_release_ long, __mix_due_ long")
