"""Near-duplicate documents by DartMinHash signatures and banded joins.

Signature.  A text is the weighted set of its shingles.  Darts fall on each shingle as a
Poisson process over rank and weight, by hashes of the shingle alone, region by region of the
weight axis ([0,1), [1,2), [2,4), ...); a dart counts if it falls below the shingle's weight.
Every dart belongs to one of ``k`` coordinates; each coordinate keeps its earliest dart.  Two
texts agree on a coordinate with the probability of their weighted Jaccard similarity.  Only
about k ln k + 2k darts are thrown per text, whatever its length; where a coordinate stays
empty the same process is followed to later ranks.

Join.  Texts with one shingle set form a class, stood for by its least document.  Classes that
share a band (``rows`` coordinates) are candidates.  In a bucket all members are first
compared to the least one.  Classes of buckets that then still hold several components are
joined exactly: two similar sets share one of their rarest shingles (prefix filter), while
sets that differ much have theirs alone.  Members of a shingle that few have are paired; those
of a common one form families with all they share such shingles with, and the members outside
a family's largest component are compared to all of other components.
Candidates are verified on their shingle sets (32-bit fingerprints of the distinct shingles),
and components of verified links are the classes returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import kernels
from .components import components
from .kernels import NOT_SPACE, Words, mixed
from .staging import discard, stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Keys of the exact join with more members are joined by families, in parts of about so many rows.
SMALL = 32
PART = 1024
SKETCH = 1024

_SIGNATURES = "doc bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>"


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes row by row, their counts, and each row's ends; a text of fewer words is one shingle."""
    gram, inside = words.grams(k)
    size = np.where(words.count >= k, words.count - k + 1, np.minimum(words.count, 1))
    ends = np.concatenate([[0], np.cumsum(size)])
    hashes = np.empty(ends[-1], np.uint64)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    full = np.ones(ends[-1], bool)
    full[ends[short]] = False
    hashes[full] = gram[inside]
    hashes[ends[short]] = words.span_hash(words.first[short], words.first[short + 1]) if len(short) else 0
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    starts = ends[:-1][size > 0]
    new[starts] = True
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(hashes)]]))
    return hashes[new], counts, np.concatenate([[0], np.cumsum(new)])[ends]


def dart_signatures(hashes: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """One row of ``k`` dart names per set; rows of empty sets are 0."""
    n = len(ends) - 1
    size = np.diff(ends)
    owner = np.repeat(np.arange(n), size)
    weight = np.bincount(owner, weights, n)
    rank = np.full(n * k, np.inf)
    name = np.zeros(n * k, np.uint64)
    todo = np.flatnonzero(size > 0)
    reach = (k * math.log(k) + 2 * k) / np.maximum(weight, 1e-300)
    while len(todo):
        pick = np.isin(owner, todo) if len(todo) < n else slice(None)
        _throw(hashes[pick], weights[pick], owner[pick], reach, k, rank, name)
        todo = todo[np.isinf(rank.reshape(n, k)[todo]).any(axis=1)]
        reach[todo] *= 2
    return name.reshape(n, k)


def _throw(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, reach: np.ndarray, k: int, rank: np.ndarray, name: np.ndarray) -> None:
    slots, ranks, names = [], [], []
    region, low, width = 0, 0.0, 1.0
    while (here := weights > low).any():
        e, w, o = hashes[here], weights[here], owner[here]
        limit = reach[o]
        at = np.zeros(len(e))
        dart = 0
        while len(e):
            h = mixed(e ^ mixed(np.array([region << 32 | dart], np.uint64) + np.uint64(0x5851F42D4C957F2D)))
            at = at - np.log(((h >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / width
            keep = at <= limit
            e, w, o, at, limit, h = e[keep], w[keep], o[keep], at[keep], limit[keep], h[keep]
            g = mixed(h ^ np.uint64(0x14057B7EF767814F))
            under = low + width * ((g >> np.uint64(32)) * 2.0**-32) < w if (w < low + width).any() else slice(None)
            slots.append((o * k + (g & np.uint64(0xFFFFFFFF)).astype(np.int64) % k)[under])
            ranks.append(at[under])
            names.append(h[under])
            dart += 1
        region, low, width = region + 1, low + width, low + width
    slot, at, h = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
    np.minimum.at(rank, slot, at)
    won = rank[slot] == at
    name[slot[won]] = h[won]


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for i in range(rows):
        key = mixed(key ^ parts[:, :, i])
    return key


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc, n, s1, s2, keys) of (doc, text) rows: distinct shingles, a 128-bit hash of their set, band keys."""

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts, ends = shingle_sets(Words(part.column(1), NOT_SPACE), shingle)
        weights = counts.astype(float) if weighted else np.ones(len(hashes))
        key = band_keys(dart_signatures(hashes, weights, ends, bands * rows), bands, rows)
        full = np.diff(ends) > 0
        sums = []
        for salt in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append(total[ends[1:]] - total[ends[:-1]])
        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)), kernels.signed(np.ascontiguousarray(key[full]).ravel()))
        return pa.record_batch([part.column(0), pa.array(np.diff(ends)), kernels.signed(sums[0]), kernels.signed(sums[1]), keys], names=["doc", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(kernels.by_chunk(of, "text"), _SIGNATURES)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc, prints, odd) of (doc, text) rows: 32-bit fingerprints of the distinct shingles, and an odd sketch.

    The sketch has the parity of the prints under each of ``SKETCH`` bits.  Where two sketches
    differ some print is in one set only, so sets differ in as many prints at least.
    """

    def of(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, _, ends = shingle_sets(Words(part.column(1), NOT_SPACE), shingle)
        prints = (hashes >> np.uint64(32)).astype(np.uint32)
        n = part.num_rows
        place = np.repeat(np.arange(n), np.diff(ends)) * SKETCH + prints % SKETCH
        odd = np.packbits((np.bincount(place, minlength=n * SKETCH) & 1).astype(bool)).view(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for at, x in ((ends, prints.view(np.int32)), (np.arange(n + 1) * (SKETCH // 64), odd))]
        return pa.record_batch([part.column(0), *lists], names=["doc", "prints", "odd"])

    return docs.mapInArrow(kernels.by_chunk(of, "text"), "doc bigint, prints array<int>, odd array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least this Jaccard similarity."""
    left = sets.select(F.col("doc").alias("a"), F.col("prints").alias("pa"))
    right = sets.select(F.col("doc").alias("b"), F.col("prints").alias("pb"))
    alike = F.size(F.array_intersect("pa", "pb")) * (1 + similarity) >= similarity * (F.size("pa") + F.size("pb")) - 1e-9
    return pairs.join(left, "a").join(right, "b").where(alike).select("a", "b")


def links(members: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b), enough to connect all similar classes, from (key, x, n) bucket members."""
    spark = members.sparkSession
    # a stored side lets Spark deal the members of a very common bucket to several tasks
    pivot = stage(members.groupBy("key").agg(F.min_by("n", "x").alias("pn"), F.min("x").alias("p")), "pivots")
    found = stage(_contracted(_verified(_pairs(members.join(pivot, "key"), similarity), sets, similarity)), "links")
    rest = _open(members, found).select(F.col("x").alias("doc")).distinct()
    left = stage(sets.join(rest, "doc", "left_semi"), "rest")
    shared = stage(_rare_members(left, similarity), "rare")
    # keys of few members: their pairs are at most SMALL / 2 for each member
    size = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sized = stage(_open(shared, found).join(size, "key"), "sized")
    near = stage(_verified(_small_pairs(sized.where(F.col("size") <= SMALL), similarity), sets, similarity), "links")
    both = found.unionAll(near)
    large = _open(sized.where(F.col("size") > SMALL).select("key", "x", "n"), both)
    out = both.unionAll(stage(_across(_families(large), sets, similarity), "links"))
    discard(spark, pivot, left, shared, sized)
    return out


def _contracted(edges: DataFrame) -> DataFrame:
    """The same components by fewer links: each b keeps its least a, which is linked to b's other a's.

    A member has at most one pivot for each band, and many members share theirs, so the links
    between pivots fall together.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    both = F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))
    return edges.withColumn("m", least).select(F.explode(both).alias("e")).select("e.*").where("a <> b").distinct()


def _small_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs within keys of at most ``SMALL`` members, of different components and of sizes that allow the similarity."""
    other = members.select("key", F.col("x").alias("p"), F.col("n").alias("pn"), F.col("label").alias("pl"))
    rows = members.join(other, "key").where("x > p and label <> pl")
    return _pairs(rows, similarity)


def _rare_members(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, x, n): each set under its rarest elements, so many that two similar sets must share one.

    A set of n elements that reaches the similarity with another misses at most
    n - ceil(similarity * n) of its own there; of any order of elements common to all sets, its
    first n - ceil(similarity * n) + 1 hold a shared one.  The order is by frequency among these
    sets.  Elements of one set only take their places but are no keys.
    """
    rows = sets.select("doc", F.size("prints").alias("n"), F.explode("prints").alias("p"))
    common = rows.groupBy("p").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = rows.join(common, "p").groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("df", "p"))).alias("held"))
    places = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("held"))
    keys = held.where(places > 0).select("doc", "n", F.explode(F.slice("held", F.lit(1), places.cast("int"))).alias("h"))
    return _shared(keys.select(F.col("h.p").cast("long").alias("key"), F.col("doc").alias("x"), F.col("n").cast("long").alias("n")))


def _shared(members: DataFrame) -> DataFrame:
    """Members of buckets with two members at least."""
    return members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").drop("size"), "key")


def _pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of x and p whose set sizes allow the similarity."""
    near = F.least("n", "pn") >= similarity * F.greatest("n", "pn")
    return rows.where(near & (F.col("x") != F.col("p"))).select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")).distinct()


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of the buckets that hold two components or more, with their component."""
    label = components(found)
    known = members.join(label.withColumnRenamed("node", "x"), "x", "left").select("key", "x", "n", F.coalesce("label", "x").alias("label"))
    several = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return known.join(several, "key")


def _families(members: DataFrame) -> DataFrame:
    """(family, x, label, minor, parts): members joined through common keys, whether they are outside the family's largest component, and the parts that its work is cut into."""
    members = stage(members, "buckets")
    heads = members.groupBy("key").agg(F.min("x").alias("p"))
    family = components(_contracted(members.join(heads, "key").where("x <> p").select(F.col("p").alias("a"), F.col("x").alias("b")).distinct())).withColumnsRenamed({"node": "x", "label": "family"})
    rows = members.select("x", "label").distinct().join(family, "x")
    sizes = rows.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.groupBy("family").agg(F.max_by("label", F.struct("size", "label")).alias("major"), F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
    out = stage(rows.join(whole, "family").select("family", "x", "label", (F.col("label") != F.col("major")).alias("minor"), "parts"), "families")
    discard(out.sparkSession, members)
    return out


def _across(families: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between the components of a family: each minor member against the members of other components.

    Sets are compared inside the join, which makes no row but a link; a family's members are
    dealt to as many parts as its size asks for, and each minor one meets them all.
    """
    n = int(families.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = families.join(sets.withColumnRenamed("doc", "x"), "x")
    part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    one = rows.select("family", part.alias("part"), F.col("x").alias("a"), F.col("label").alias("la"), F.col("prints").alias("pa"), F.col("odd").alias("oa"))
    two = rows.where("minor").select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("x").alias("b"), F.col("label").alias("lb"), F.col("prints").alias("pb"), F.col("odd").alias("ob"))
    one, two = one.repartition(n, "family", "part").alias("l"), two.repartition(n, "family", "part").alias("r")
    na, nb = F.size("pa"), F.size("pb")
    # cheapest first; the sketches bound the difference of the sets, which similarity bounds too
    apart = F.bit_count(F.get("oa", F.lit(0)).bitwiseXOR(F.get("ob", F.lit(0))))
    for i in range(1, SKETCH // 64):
        apart = apart + F.bit_count(F.get("oa", F.lit(i)).bitwiseXOR(F.get("ob", F.lit(i))))
    near = (
        (F.col("la") != F.col("lb"))
        & (F.least(na, nb) >= similarity * F.greatest(na, nb))
        & (apart * (1 + similarity) <= (1 - similarity) * (na + nb) + 1e-9)
        & (F.size(F.array_intersect("pa", "pb")) * (1 + similarity) >= similarity * (na + nb) - 1e-9)
    )
    return one.join(two, (F.col("l.family") == F.col("r.family")) & (F.col("l.part") == F.col("r.part")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every row of ``docs``: documents linked by similar texts share a class, named by its least id.

    Similarity is Jaccard over sets of ``shingle``-word shingles; ``weighted`` lets counts
    weigh in the signatures.  A text of fewer words is one shingle; texts without words (null,
    empty, blank) are copies of each other.  Rows without an id are not compared and get a null
    class; rows that share an id share a class; an empty table gives an empty result; other
    columns are ignored.  Very long texts take part whole.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    signed = stage(signatures(lean, shingle, bands, rows, weighted), "signatures")
    named = signed.where("doc is not null")
    reps = stage(named.groupBy("n", "s1", "s2").agg(F.min("doc").alias("doc"), F.first("keys").alias("keys")), "classes")
    members = stage(_shared(reps.select(F.explode("keys").alias("key"), F.col("doc").alias("x"), "n")), "buckets")
    wanted = members.select(F.col("x").alias("doc")).distinct()
    sets = stage(fingerprints(lean.join(wanted.hint("shuffle_hash"), "doc", "left_semi"), shingle), "prints")
    label = components(links(members, sets, similarity))
    classed = reps.join(label.withColumnRenamed("node", "doc"), "doc", "left").select("n", "s1", "s2", F.coalesce("label", "doc").alias("class_id"))
    discard(spark, members, sets)
    # all texts under one id belong together
    merged = named.join(classed, ["n", "s1", "s2"]).select(F.col("doc").alias("doc_id"), "class_id")
    return merged.unionAll(signed.where("doc is null").select(F.col("doc").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))
