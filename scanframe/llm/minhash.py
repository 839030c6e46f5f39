"""Near-duplicates of whole texts: b-bit MinHash signatures, band candidates, confirmation on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from scanframe.functions.cluster import counted, materialize
from scanframe.llm.common import blocks, components, keyed, replaced, sieved, smallest_reachable

BITS = 4  # kept low bits of each minimum
_LOW = 0x1111111111111111  # lowest bit of each group of four
TILE = 256  # members of a bucket that are compared with each other at a time
FEW = 8  # buckets of so many classes give their pairs as rows


@dataclass(frozen=True)
class Likeness:
    """Words per shingle, least likeness in per cent, and the chance that a pair just at it shares no band."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-5

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))

    @property
    def hashes(self) -> int:
        return -(-self.bands * self.rows // 16) * 16  # whole longs of packed bits

    @property
    def most_different(self) -> int:
        """Positions whose bits may differ; a pair at the least likeness has more with a chance of about 10^-6.

        Two bits groups agree by chance once in 2^BITS, so the expected share of differing
        ones is (1 - likeness) * (1 - 2^-BITS); five and a half deviations come on top.
        """
        p = (1 - self.percent / 100) * (1 - 2.0 ** -BITS)
        return math.ceil(self.hashes * p + 5.5 * math.sqrt(self.hashes * p * (1 - p)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; ASCII letters in lower case, ASCII white space between words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = _mixed(acc + h[k:k + n])
    return np.unique(acc)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minima(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """One row of minima per non-empty set, computed over blocks of sets that fit the processor's cache."""
    a, b = _coefficients(hashes)
    out = np.empty((len(sets), hashes), np.uint64)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 16384):
            size += len(sets[end])
            end += 1
        block = np.concatenate(sets[begin:end])
        starts = np.cumsum([0, *[len(s) for s in sets[begin:end - 1]]])
        for k in range(hashes):
            out[begin:end, k] = np.minimum.reduceat(block * a[k] + b[k], starts)
        begin = end
    return _mixed(out)


def signatures(batches: Iterator[pa.RecordBatch], like: Likeness) -> Iterator[pa.RecordBatch]:
    """(id, key, mark, text) to (id, key, mark, n, digest, bands, bits); the last three null for empty sets."""
    for batch in blocks(batches, lambda b: b.column("text")):
        sets = [shingles(t, like.words) for t in batch.column("text").to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        digest, bands, bits = ([None] * len(sets) for _ in range(3))
        if full:
            low = minima([sets[i] for i in full], like.hashes)
            buckets = np.zeros((len(full), like.bands), np.uint64)
            for r in range(like.rows):
                buckets = _mixed(buckets + low[:, r:like.bands * like.rows:like.rows])
            nibbles = (low & np.uint64(15)).reshape(len(full), -1, 16)
            packed = np.zeros(nibbles.shape[:2], np.uint64)
            for k in range(16):
                packed |= nibbles[:, :, k] << np.uint64(BITS * k)
            for place, i in enumerate(full):
                digest[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
                bands[i] = buckets[place].view(np.int64)
                bits[i] = packed[place].view(np.int64)
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("id", "key", "mark")], pa.array([len(s) for s in sets], pa.int64()),
            pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
        ], ["id", "key", "mark", "n", "digest", "bands", "bits"])


def different(a: Column, b: Column, longs: int) -> Column:
    """Number of differing bit groups of two packed signatures."""
    total = F.lit(0)
    for k in range(longs):
        x = F.get(a, k).bitwiseXOR(F.get(b, k))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(_LOW)))
    return total


def _members(classes: DataFrame) -> DataFrame:
    """Classes in the buckets that more than one shares, with the smallest of each: (band, bucket, cid, hub)."""
    members = classes.select("cid", F.posexplode("bands").alias("band", "bucket"))
    hubs = members.groupBy("band", "bucket").agg(F.min("cid").alias("hub"), F.count("*").alias("size"))
    hubs = materialize(hubs.where("size > 1").drop("size"))
    return materialize(members.join(hubs, ["band", "bucket"]))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (band, bucket, cid, root, size) of the buckets whose classes are not all in one component yet."""
    label = labels.select(F.col("node").alias("cid"), "root")
    placed = materialize(members.join(label, "cid", "left").select(
        "band", "bucket", "cid", F.coalesce("root", "cid").alias("root")))
    still = placed.groupBy("band", "bucket").agg(
        F.count("*").alias("size"), F.min("root").alias("least"), F.max("root").alias("most"))
    still = materialize(still.where("least <> most").select("band", "bucket", "size"))
    return materialize(placed.join(still, ["band", "bucket"]))


def _few_pairs(inside: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of different components in buckets of at most FEW classes whose signatures are near enough."""
    few = inside.where(F.col("size") <= FEW)
    a = few.select("band", "bucket", F.col("cid").alias("a"), F.col("root").alias("root_a"))
    b = few.select("band", "bucket", F.col("cid").alias("b"), F.col("root").alias("root_b"))
    pairs = a.join(b, ["band", "bucket"]).where("a > b and root_a <> root_b").select("a", "b").distinct()
    return _near(pairs, classes, like)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of blocks of the incidence matrix."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    on = times[place] > 1  # what occurs once is shared by none
    column = np.cumsum(times > 1)[place[on]] - 1
    owner = owner[on]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 8192
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [k, k + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[low:high], column[low:high] - k] = 1
        total += block @ block.T
    return total.astype(np.int64)


def _tile_links(like: Likeness):
    def run(group: pa.Table) -> pa.Table:
        """Classes of one tile or two, to links (a, b) that join what is linked there: one a class, not one a pair."""
        group = group.sort_by("cid")
        cid, root, tile = (group.column(c).to_numpy() for c in ("cid", "root", "tile"))
        bits = group.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(cid), -1)
        unlike = np.zeros((len(cid), len(cid)), np.int64)
        for k in range(bits.shape[1]):
            x = bits[:, None, k] ^ bits[None, :, k]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            unlike += np.bitwise_count(x & np.uint64(_LOW))
        near = (unlike <= like.most_different) & (root[:, None] != root[None, :])
        if group.column("t1")[0] != group.column("t2")[0]:
            near &= tile[:, None] != tile[None, :]
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        stored = group.column("shingles").combine_chunks()
        sets = [np.frombuffer(stored[int(k)].as_buffer(), np.uint64) for k in some]
        both, size = _shared(sets), np.array([len(x) for x in sets])
        linked = near[np.ix_(some, some)] & (100 * both >= like.percent * (size[:, None] + size[None, :] - both))
        i, j = np.nonzero(np.triu(linked, 1))
        to = smallest_reachable(len(some), i, j)
        on = to != np.arange(len(some))
        return pa.table({"a": cid[some[on]], "b": cid[some[to[on]]]})

    return run


def _tiled_links(inside: DataFrame, classes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) inside the larger open buckets, cut into tiles by hash.

    Each pair of tiles of a bucket is one group of at most two tiles, sifted by the bits and
    confirmed on the full sets where it lies; what comes out is linear in the tile.
    """
    many = inside.where(F.col("size") > FEW)
    sets = _sets(many.select("cid").distinct(), classes, rows, like)
    many = many.join(classes.select("cid", "bits"), "cid").join(sets, "cid")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    many = many.withColumn("tile", F.pmod(F.xxhash64("cid"), tiles).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    many = many.withColumns({"t1": F.least("tile", "other"), "t2": F.greatest("tile", "other")})
    return many.select("band", "bucket", "t1", "t2", "tile", "cid", "root", "bits", "shingles").groupBy(
        "band", "bucket", "t1", "t2").applyInArrow(_tile_links(like), "a long, b long").distinct()


def _set_bytes(words: int):
    @arrow_udf("binary")
    def sets(text: pa.Array) -> pa.Array:
        return pa.array([shingles(t, words).tobytes() for t in text.to_pylist()], pa.binary())

    return sets


def _links(percent: int):
    @arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return linked


def _sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """(cid, shingles) of some classes, from the texts of their first documents."""
    wanted = materialize(wanted.join(classes.select("cid", "key", "mark"), "cid"))
    texts = sieved(rows.select("key", "mark", F.col("row")["text"].alias("text")), wanted, ["key", "mark"]).where("possible")
    texts = texts.select("key", "mark", "text").join(wanted, ["key", "mark"])
    return materialize(texts.select("cid", _set_bytes(like.words)("text").alias("shingles")).dropDuplicates(["cid"]))


def confirmed(pairs: DataFrame, classes: DataFrame, rows: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are alike enough; texts are read for their classes only."""
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = _sets(wanted, classes, rows, like)
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(b, "b").join(a, "a").where(_links(like.percent)("set_a", "set_b")).select("a", "b")


def near_classes(rows: DataFrame, like: Likeness) -> DataFrame:
    """Per row: id, key, mark, n (set size), first (struct of key and mark: the component's smallest)."""
    texts = rows.select(F.col("row")["doc_id"].alias("id"), "key", "mark", F.col("row")["text"].alias("text"))
    schema = texts.select("id", "key", "mark").schema.add("n", "long").add("digest", "binary").add(
        "bands", ArrayType(LongType())).add("bits", ArrayType(LongType()))
    marked = materialize(texts.mapInArrow(lambda batches: signatures(batches, like), schema))
    # equal sets are one class: copies are never compared with each other
    groups = marked.where("n > 0").groupBy("digest").agg(
        F.min(F.struct("key", "mark")).alias("first"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = materialize(groups.select(
        F.monotonically_increasing_id().alias("cid"), "digest", "first", "first.key", "first.mark", "bands", "bits"))
    members = _members(classes)

    # first a star per bucket, one pair a class; then what the stars left open
    pairs = members.where("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct()
    stars = _near(pairs, classes, like).groupBy("a").agg(F.min("b").alias("b"))
    tried = materialize(stars)
    links = materialize(confirmed(tried, classes, rows, like))
    labels = components(links)
    inside = _open_buckets(members, labels)
    opened = materialize(_few_pairs(inside, classes, like).join(tried, ["a", "b"], "left_anti"))
    more = confirmed(opened, classes, rows, like).unionByName(_tiled_links(inside, classes, rows, like))
    more, n = counted(more)
    if n:
        labels = components(links.unionByName(more))
    root = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "digest", "first", F.coalesce("root", "cid").alias("root"))
    root = materialize(root)
    least = materialize(root.groupBy("root").agg(F.min("first").alias("least")))
    of_digest = materialize(root.join(least, "root").select("digest", "least"))
    own = F.struct("key", "mark")
    return marked.select("id", "key", "mark", "n", "digest").join(of_digest, "digest", "left").select(
        "id", "key", "mark", "n", F.coalesce("least", own).alias("first"))


def _near(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    bits = classes.select("cid", "bits")
    a = bits.select(F.col("cid").alias("a"), F.col("bits").alias("bits_a"))
    b = bits.select(F.col("cid").alias("b"), F.col("bits").alias("bits_b"))
    near = different(F.col("bits_a"), F.col("bits_b"), like.hashes // 16) <= like.most_different
    return pairs.join(b, "b").join(a, "a").where(near).select("a", "b")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008 frozen
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id).

    Two documents are linked when ``100 * intersection >= percent * union`` for their sets of
    distinct shingles of ``words`` words. Fewer words make one shingle; no words an empty set,
    linked with nothing. Candidates come from bands of minima, are sifted by the bit count of
    the packed signatures and confirmed on the full sets; a pair exactly at the threshold shares
    no band with a chance of ``miss``. Equal sets are one class, so groups of copies cost no
    pairs. Defined cases: null text counts as empty; a null doc_id takes part as id 0 and is
    returned as null, kept null; rows that repeat a doc_id each get a row.
    """
    rows = keyed(docs.select("doc_id", "text"))
    return near_classes(rows, like).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.key").alias("component_id"),
        (F.col("id") == F.col("first.key")).alias("kept"))


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:  # noqa: B008 frozen
    """The documents without all but the first (by doc_id, then text hash) of each group of near-duplicates.

    Columns stay as they are. Texts without words are linked with nothing and all stay. Rows
    equal in doc_id and text are one document, of which one row stays. Only rows that may be
    lost or repeated are shuffled, the others are left as they lie.
    """
    rows = keyed(docs)
    found = materialize(near_classes(rows, like))
    lost = materialize(found.where(F.struct("key", "mark") != F.col("first")).select("key", "mark").distinct())
    again = found.groupBy("key", "mark").count().where("count > 1").select("key", "mark")
    marked = sieved(rows, materialize(lost.unionByName(again)), ["key", "mark"])
    doubtful = marked.where("possible").join(lost, ["key", "mark"], "left_anti").dropDuplicates(["key", "mark"])
    return replaced(marked.where("not possible").unionByName(doubtful))
