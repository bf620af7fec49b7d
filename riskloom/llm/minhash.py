"""Operator 12: near-duplicates by MinHash, banding, and exact confirmation.

A text is the set of its distinct word shingles. Many universal hash functions of the
shingles give each set a signature of minima; ROWS minima in turn make the key of a band.
Texts whose sets overlap by the wanted Jaccard similarity meet in one of the bands but
for a chance of MISS, from which the number of bands follows. Texts of one set are one
class throughout, so exact copies, however many, cost one.

Those that share a band's key are a bucket. Rows never grow with the square of a bucket:
every member is paired with one of them, the leader, alone. Pairs whose signatures agree
too little are ruled out, the others are confirmed on the full sets, and links become
components by alternating large-star and small-star. Members that are then still parted
from their leader are compared, by their full sets, with all members of the leader's
buckets, block by block; a task holds two blocks of bounded bytes and gives only links
that connect what it connects. So every two texts that meet are linked or told apart, and
only the components of links are kept.

Words are runs of anything but the six ASCII white-space characters, A-Z in lower case.
Shingles are known by 64-bit hashes, classes by 128-bit hashes of their sets.

Defined results: texts without words (null, empty, blank) are linked with nothing, not even
each other; a text of fewer words than the width is one shingle. Repeated rows are alike.
A row without doc_id is linked like any other, but names no component: without any doc_id
in it, component_id is null and the row is kept. Rows of one doc_id with different texts
are judged each by its text. An empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate, chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, text_slices
from .simhash import BROADCAST_ROWS, components

WIDTH, SEED = 5, 42

#: Minima in a band, and the chance that two texts just similar enough meet in none.
ROWS, MISS = 6, 1e-9

#: Bytes of sets in one block of a group, and parts that the texts paired with one leader are dealt to.
BLOCK_BYTES, SALTS = 2 << 20, 64

#: For classes of texts without a doc_id: where they are looked up.
NOWHERE = -(1 << 63)


@dataclass(frozen=True)
class Likeness:
    """A Jaccard similarity of ``over / under`` or more of shingles of ``width`` words, in lower case (A-Z alone, or ``any_case``); ``rows`` minima make a band."""

    over: int
    under: int
    width: int = WIDTH
    any_case: bool = False
    rows: int = ROWS

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.over / self.under) ** self.rows))

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    def least(self, p: float) -> int:
        """Of all minima, how many are of a kind that each is with chance ``p``, but for a chance of MISS."""
        n, tail = self.minima, 0.0
        for k in range(n):
            tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            if tail > MISS:
                return k
        return n

    @property
    def least_equal(self) -> int:
        """Equal minima, of all, that similar texts have."""
        return self.least(self.over / self.under)

    @property
    def least_bits(self) -> int:
        """Equal bits that their signatures have: of unequal minima, every other bit is equal."""
        return self.least((1 + self.over / self.under) / 2)

    def enough(self, shared, sizes):
        """Whether ``shared`` of two sets whose sizes add up to ``sizes`` suffice."""
        return (self.over + self.under) * shared >= self.over * sizes

    def sized(self, a: str, b: str) -> str:
        """SQL: whether sets of these sizes can be similar."""
        return f"{self.over} * greatest({a}, {b}) <= {self.under} * least({a}, {b})"


NEAR = Likeness(85, 100)


def shingle_set(text: str, width: int, any_case: bool = False) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    import xxhash

    words = (text.lower() if any_case else text).encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    k = min(width, len(words))
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(chain((0,), ends), ends[k - 1 :], strict=False)]
    return np.unique(np.array(hashes, "<u8"))


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """``count`` minima of each set, none of them empty, under universal hash functions of 32 bits."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, count, np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), count), np.uint32)
    for j in range(count):
        out[:, j] = np.minimum.reduceat(x * factors[j] + shifts[j], first)
    return out


def band_keys(low: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key for every set and band."""
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(low), bands)).copy()
    for m in np.moveaxis(low.reshape(len(low), bands, -1), 2, 0):
        key = (key ^ m) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def signatures(low: np.ndarray) -> np.ndarray:
    """A well-mixed bit of every minimum, in 64-bit words."""
    h = low * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    bits = np.zeros((len(low), -(-low.shape[1] // 64) * 64), np.uint8)
    bits[:, : low.shape[1]] = h >> np.uint32(31)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def with_sets(docs: DataFrame, alike: Likeness) -> DataFrame:
    """doc_id, at and th (where a text is looked up), high and low (its set), n, sig and keys of every row; n is 0 without words."""
    import xxhash

    names = ["doc_id", "at", "th", "high", "low", "n", "sig", "keys"]
    bands, words = alike.bands, -(-alike.minima // 64)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch, 3):
                sets = [shingle_set(t, alike.width, alike.any_case) for t in texts]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig, keys = np.zeros((len(sets), words), np.int64), np.zeros((len(sets), bands), np.uint64)
                if full:
                    low = minima([sets[i] for i in full], alike.minima)
                    sig[full], keys[full] = signatures(low), band_keys(low, bands)
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(-1, 2)
                columns = [*(batch.column(c)[lo:hi] for c in range(3)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([len(s) for s in sets], pa.int32())]
                columns += [lists(sig), lists(keys.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "doc_id long, at long, th long, high long, low long, n int, sig array<long>, keys array<long>"
    return looked_up(docs).mapInArrow(run, kind)


def looked_up(docs: DataFrame) -> DataFrame:
    doc, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(NOWHERE)).alias("at"), F.xxhash64(text).alias("th"), text.alias("text"))


def classes_of(known: DataFrame) -> DataFrame:
    """A row for each distinct set: id (a number of its own), first (its smallest doc_id), at, th, n, sig and keys."""
    same = [F.first(c).alias(c) for c in ("n", "sig", "keys")]  # equal sets have equal ones
    found = known.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.min(F.struct("at", "th")).alias("where"), *same)
    return stash(found.select(F.monotonically_increasing_id().alias("id"), "high", "low", "first", "where.at", "where.th", "n", "sig", "keys"))


def led_pairs(classes: DataFrame) -> DataFrame:
    """leader and id: every member of a bucket with the bucket's smallest id, once."""
    rows = classes.select(F.explode("keys").alias("key"), "id")
    leaders = rows.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("m")).where("m > 1").select("key", "leader")
    return stash(rows.join(leaders, "key").where("id <> leader").groupBy("leader", "id").agg(F.lit(1).alias("one")).select("leader", "id"))


def agreeing(pairs: DataFrame, classes: DataFrame, alike: Likeness) -> DataFrame:
    """The pairs (leader, id) that sizes and signatures do not rule out."""
    of = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(c + "_n"), F.col("sig").alias(c + "_sig"))
    both = pairs.join(of("id"), "id").join(of("leader"), "leader").where(alike.sized("id_n", "leader_n"))
    unequal = sum(F.bit_count(F.col("id_sig")[i].bitwiseXOR(F.col("leader_sig")[i])) for i in range(-(-alike.minima // 64)))
    return both.where(unequal <= alike.minima - alike.least_bits).select("leader", "id")


def whole_sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, alike: Likeness) -> DataFrame:
    """id and set of the wanted classes (id)."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([shingle_set(t, alike.width, alike.any_case).tobytes() for t in texts], pa.binary())], names=["id", "set"])

    refs = stash(classes.join(wanted, "id").select("id", "at", "th"))
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_ROWS else refs
    rows = looked_up(docs).join(refs, ["at", "th"]).select("id", "text")
    return stash(rows.mapInArrow(run, "id long, set binary").dropDuplicates(["id"]))  # repeated rows have one set


def confirmed(pairs: DataFrame, sets: DataFrame, alike: Likeness) -> DataFrame:
    """The pairs (leader, id) whose full sets are similar. A leader's set goes to SALTS tasks at most, a member's to one."""

    def run(batches):
        centre = of = None
        for batch in batches:
            leader, member, ids = (batch.column(c).to_pylist() for c in (0, 2, 3))
            out = []
            for i, s in enumerate(batch.column(4)):
                s = np.frombuffer(s.as_buffer(), "<u8")
                if not member[i]:
                    centre, of = s.copy(), leader[i]
                elif of == leader[i] and alike.enough(len(np.intersect1d(centre, s, assume_unique=True)), len(centre) + len(s)):
                    out.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out, pa.int64())), batch.column(3).take(pa.array(out, pa.int64()))], names=["leader", "id"])

    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    centres = salted.select("leader", "salt").distinct().select("leader", "salt", F.lit(False).alias("member"), F.col("leader").alias("id"))
    rows = centres.unionByName(salted.select("leader", "salt", F.lit(True).alias("member"), "id")).join(sets, "id")
    rows = rows.select("leader", "salt", "member", "id", "set").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "member")
    return stash(rows.mapInArrow(run, "leader long, id long"))


def spanning(sets: list[np.ndarray], roots: list[int], alike: Likeness) -> list[tuple[int, int]]:
    """Links between sets of different roots that connect just what similar sets connect."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, holders = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
    of, found = np.unique(roots, return_inverse=True)[1], []
    for a, s in enumerate(sets):
        if (of == of[a]).all():
            break
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        meets = np.concatenate([holders[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
        shared = np.bincount(meets, minlength=len(sets))
        for b in np.flatnonzero((of != of[a]) & alike.enough(shared, sizes + sizes[a])).tolist():
            if of[b] != of[a]:
                found.append((a, b))
                of[of == of[b]] = of[a]
    return found


def block_links(alike: Likeness):
    """Links u > v of roots, from rows (leader, i, inner, j, root, set) sorted by the first four."""

    def rows(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(5)]
            for k, s in enumerate(batch.column(5)):
                yield tuple(c[k] for c in columns[:4]), columns[4][k], np.frombuffer(s.as_buffer(), "<u8").copy()

    def run(batches):
        for _, group in groupby(rows(batches), lambda r: r[0]):  # two blocks at most
            _, roots, sets = zip(*group, strict=True)
            links = spanning(list(sets), list(roots), alike)
            if links:
                ends = np.array([sorted((roots[a], roots[b])) for a, b in links], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 1]), pa.array(ends[:, 0])], names=["u", "v"])

    return run


def rest_of_groups(docs: DataFrame, classes: DataFrame, led: DataFrame, linked: DataFrame, alike: Likeness) -> DataFrame:
    """Links u > v of roots: of components in ``linked`` (u, v: the smallest one) that similar members of a leader's buckets join."""
    root = lambda c: linked.select(F.col("u").alias(c), F.col("v").alias(c + "_root"))
    rooted = lambda df, c: df.join(root(c), c, "left").withColumn(c + "_root", F.coalesce(c + "_root", c))
    state = stash(rooted(rooted(led, "id"), "leader").join(classes.select("id", "n"), "id"))
    apart = F.col("id_root") != F.col("leader_root")
    open_ = state.groupBy("leader", "leader_root").agg(F.sum(F.when(apart, F.col("n"))).alias("far_n"), F.sum(F.when(~apart, F.col("n"))).alias("near_n"), F.max(F.when(apart, F.col("n"))).alias("most"), F.min(F.when(apart, F.col("n"))).alias("least"))
    open_ = stash(open_.where("far_n > 0"))
    if open_.isEmpty():
        return linked.select("u", "v").where("false")
    # the leader itself has been compared with all; nearer members stay only if their size can match one that is apart
    fits = F.expr(f"({alike.over} * n <= {alike.under} * most) and ({alike.over} * least <= {alike.under} * n)")
    members = state.join(open_.drop("leader_root"), "leader").where(apart | fits)
    blocks = lambda total: F.greatest(F.lit(1), F.ceil(F.coalesce(total, F.lit(0)) * 8 / BLOCK_BYTES)).cast("int")
    members = members.select("leader", "id", F.col("id_root").alias("root"), (~apart).alias("near"), blocks(F.col("near_n")).alias("inner"), blocks(F.col("far_n")).alias("outer"))
    members = members.withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("near"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    key = lambda i, inner, j: F.struct(i.cast("int").alias("i"), F.lit(inner).alias("inner"), j.cast("int").alias("j"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    with_inner = F.transform(every(F.col("inner")), lambda j: key(F.col("own"), True, j))
    with_outer = F.transform(every(F.col("outer")), lambda j: key(F.least("own", j), False, F.greatest("own", j)))
    met = F.when(F.col("near"), F.transform(every(F.col("outer")), lambda i: key(i, True, F.col("own")))).otherwise(F.concat(with_inner, with_outer))
    members = stash(members)
    sets = whole_sets(docs, members.select("id").distinct(), classes, alike)
    rows = members.select("leader", "id", "root", F.explode(met).alias("k")).join(sets, "id").select("leader", "k.i", "k.inner", "k.j", "root", "set")
    rows = rows.repartition("leader", "i", "inner", "j").sortWithinPartitions("leader", "i", "inner", "j")
    return stash(rows.mapInArrow(block_links(alike), "u long, v long"))


def near_duplicates(docs: DataFrame, alike: Likeness = NEAR) -> DataFrame:
    """doc_id, at, th, n, root (a number of the component; null without words) and component_id of every row."""
    known = stash(with_sets(docs, alike))
    classes = classes_of(known)
    led = led_pairs(classes)
    pairs = stash(agreeing(led, classes, alike))
    wanted = pairs.select("id").unionByName(pairs.select(F.col("leader").alias("id"))).distinct()
    near = confirmed(pairs, whole_sets(docs, wanted, classes, alike), alike)
    links = near.select(F.col("id").alias("u"), F.col("leader").alias("v"))
    linked = components(links)
    more = rest_of_groups(docs, classes, led, linked, alike)
    rooted = classes.select("high", "low", "id", "first").join(linked.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left")
    rooted = rooted.select("high", "low", "first", F.coalesce("root", "id").alias("root"))
    if not more.isEmpty():
        joined = components(more.distinct()).select(F.col("u").alias("root"), F.col("v").alias("joined"))
        rooted = rooted.join(joined, "root", "left").select("high", "low", "first", F.coalesce("joined", "root").alias("root"))
    rooted = stash(rooted)
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("high", "low", "root", "component_id")
    rows = known.select("doc_id", "at", "th", "high", "low", "n")
    bare = rows.where("n = 0").select("doc_id", "at", "th", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(named, ["high", "low"]).select("doc_id", "at", "th", "n", "root", "component_id").unionByName(bare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", kept.alias("kept"))
