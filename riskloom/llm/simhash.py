"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; each is the majority of that bit over the XXH64 hashes
(seed 42) of a text's word shingles. Two fingerprints link at ``RADIUS`` (3) or
fewer differing bits.

The bits are cut into three blocks. If two fingerprints differ at all, leaving out
a block that holds one of the differing bits leaves two at most, and half of two is
one: so with every block left out in turn, each fingerprint emits all variants
within one bit of the rest. Linked fingerprints share a variant; shuffled on
variants, those that meet are verified by their distance, and each bucket gives
only enough links to connect what it connects. Distinct fingerprints go through
this, so exact copies, however many, cost one. A bucket holds distinct fingerprints
that share 42 bits but for a flip each, never a count of documents.

Components are found by alternating star contractions of the links.

Defined results: texts without words (null, empty, blank) have fingerprint zero and
are linked like any other; repeated rows give repeated results; a component without
any doc_id has a null id; an empty table gives an empty one. Only ``doc_id`` and
``text`` are read, so other columns never clash.
"""

from __future__ import annotations

from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, text_slices

WIDTH = 3
RADIUS = 3
SEED = 42

#: Removed doc_ids that are broadcast to the texts; beyond it, both sides are shuffled.
BROADCAST_ROWS = 500_000

BLOCKS = ((0, 22), (22, 43), (43, 64))


def simhash(texts: list[str], width: int) -> np.ndarray:
    """Fingerprints of texts, as unsigned 64-bit numbers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), "<u8")
    hashes, sizes, own = [], [], []
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        k = min(width, len(words))
        hashes.append([digest(joined[a : b - 1], SEED) for a, b in zip(chain((0,), ends), ends[k - 1 :], strict=False)])
        sizes.append(len(words) - k + 1)
        own.append(i)
    if own:
        h = np.fromiter(chain.from_iterable(hashes), "<u8", sum(sizes))
        begin = np.cumsum(sizes) - sizes
        ones = np.empty((len(own), 64), np.int64)
        for byte in range(8):
            bits = np.unpackbits(h.view(np.uint8)[byte::8].reshape(-1, 1), axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        most = 2 * ones > np.array(sizes)[:, None]
        out[own] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, kind: str = "long") -> DataFrame:
    """doc_id (of this kind) and f, the fingerprint as a signed 64-bit number, of every row."""

    def run(batches):
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                f = simhash(texts, width).view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(f, pa.int64())], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast(kind), F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, f long")


def variant_masks() -> list[tuple[int, int, int]]:
    """Block left out, bits kept, bit flipped: as signed 64-bit numbers."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for block, (lo, hi) in enumerate(BLOCKS):
        kept = ((1 << 64) - 1) ^ ((1 << hi) - (1 << lo))
        flips = [0, *(1 << b for b in range(64) if not lo <= b < hi)]
        out += [(block, signed(kept), signed(x)) for x in flips]
    return out


def spanning(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect just what links of RADIUS or fewer bits connect among distinct fingerprints."""
    left, found = np.sort(f), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:128], front[128:]
            near = np.bitwise_count(some[:, None] ^ left[None, :]) <= RADIUS
            hit = near.any(0)
            if hit.any():
                found.append((some[near.argmax(0)][hit], left[hit]))
                front, left = np.concatenate([front, left[hit]]), left[~hit]
    return found


def bucket_links(batches):
    """Verified links of buckets, from rows (block, key, f) sorted by block and key."""
    rest = [np.zeros(0, np.int64)] * 3

    def links(block, key, f):
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1])]))
        size = np.diff(np.append(first, len(key)))
        u = f.view(np.uint64)
        two = first[size == 2]
        two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= RADIUS]
        found = [(u[two], u[two + 1])]
        for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found += spanning(u[a : a + n])
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        rows = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns, strict=True)]
        if not len(rows[1]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        rest = [r[cut:] for r in rows]
        if cut:
            yield links(*(r[:cut] for r in rows))
    if len(rest[1]):
        yield links(*rest)


def links(distinct: DataFrame) -> DataFrame:
    """Links u > v that connect the fingerprints ``f``, each within RADIUS bits."""
    masks = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(k).cast("long").alias("kept"), F.lit(x).cast("long").alias("flip")) for b, k, x in variant_masks()))
    rows = distinct.select("f", F.explode(masks).alias("m"))
    rows = rows.select(F.col("m.block").alias("block"), F.col("f").bitwiseXOR(F.col("m.flip")).bitwiseAND(F.col("m.kept")).alias("key"), "f")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "block", "key").sortWithinPartitions("block", "key")
    return rows.mapInArrow(bucket_links, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u and v: every node with a link, but the smallest of its component, and that smallest one. ``edges`` has each link u > v once."""
    edges = stash(edges)
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        around = both.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))
        # stars already, if every node has larger neighbours alone or one smaller neighbour alone
        if not around.where("least < u and least <> most").count():
            return edges
        # large star: the larger neighbours of a node go to the smallest of them all
        large = edges.join(around.select(F.col("u").alias("v"), F.least("u", "least").alias("m")), "v").select("u", F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the smallest of these
        moved = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = moved.select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v")
        edges = stash(small.distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH, more: DataFrame | None = None) -> DataFrame:
    """doc_id, f and component_id (its smallest doc_id) of every row.

    ``more`` has further links u > v between fingerprints.
    """
    found = stash(fingerprints(docs, width))
    distinct = stash(found.groupBy("f").agg(F.min("doc_id").alias("first")))
    near = links(distinct.select("f"))
    linked = components(near if more is None else near.unionByName(more).distinct())
    nodes = linked.select(F.col("u").alias("f"), F.col("v").alias("root")).unionByName(linked.select(F.col("v").alias("f"), F.col("v").alias("root")).distinct())
    nodes = stash(nodes.join(distinct, "f"))
    least = nodes.groupBy("root").agg(F.min("first").alias("least"))
    of_node = distinct.join(nodes.join(least, "root").select("f", "least"), "f", "left")
    named = of_node.select("f", F.coalesce("least", "first").alias("component_id"))
    return found.join(named, "f").select("doc_id", "f", "component_id")


def similar_links(docs: DataFrame, width: int) -> DataFrame:
    """Links u > v of the fingerprints of texts that the Jaccard similarity of their shingles (0.8 or more) joins.

    All fingerprints of a component of similar texts are linked to the least of them.
    """
    from . import minhash

    alike = minhash.Likeness(4, 5, width, any_case=True, rows=5)
    joined = minhash.near_duplicates(docs, alike).where("root is not null").groupBy("at", "th").agg(F.min("root").alias("root"))
    prints = fingerprints(minhash.looked_up(docs).select(F.struct("at", "th").alias("doc_id"), "text"), width, "struct<at:long,th:long>")
    pairs = stash(prints.select("doc_id.*", "f").join(joined, ["at", "th"]).select("root", "f").distinct())
    least = pairs.groupBy("root").agg(F.min("f").alias("v"))
    return pairs.join(least, "root").where("f <> v").select(F.col("f").alias("u"), "v").distinct()


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those with a smaller doc_id in their component.

    Components are of links by SimHash and by the Jaccard similarity of shingles. Rows without doc_id stay.
    """
    gone = stash(near_duplicates(docs, width, similar_links(docs, width)).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
