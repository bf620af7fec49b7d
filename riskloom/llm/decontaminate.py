"""Operator 7: benchmark decontamination, in DataFrame operations only.

A test item leaks into a document that contains at least ``CONTAINMENT`` of its
distinct shingles of ``WIDTH`` words. Items are partitioned by size. Every
partition has a MinHash sketch length: the most shingles that a leak of that size
may lack, plus one. So of the shingles with the smallest hashes that make up an
item's sketch, a leak keeps at least one, and looking the sketches up among the
documents' shingle hashes finds every candidate. Candidates are verified by the
shingles themselves.

Words are runs of letters and digits, in lower case. An item of fewer words than
``WIDTH`` is one shingle of its own width, which is sought at that width.

Defined results: one row for each leak (document, item); null and empty texts, and
texts without words, leak nothing; rows with equal doc_id and text count as one
document; null doc_ids and item_ids are reported as null; items with equal ids but
other texts are separate items of that id, and the larger share counts; empty
tables give an empty result. Only ``doc_id``, ``item_id`` and ``text`` are read,
so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

WIDTH = 5
CONTAINMENT = 0.8

#: Rows of shingles or of candidates that are broadcast, and bytes of their text; beyond either, both sides are shuffled.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingles(width: int, of) -> Column:
    """``of(words of a shingle)`` for every ``width`` successive elements of column ``w``."""
    at = F.when(F.size("w") >= width, F.sequence(F.lit(1), F.size("w") - (width - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of(*(F.element_at("w", i + k) for k in range(width))))


def spelt(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def small(df: DataFrame) -> DataFrame:
    told = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(told, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def key_of(number: Column) -> Column:
    """A row told by its number and a SHA-256 digest of its text: only rows equal in both have the same."""
    return F.concat_ws(":", number.cast("string"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def item_shingles(items: DataFrame, width: int, containment: float) -> DataFrame:
    """item_id, item (its own key), width, n (distinct shingles), shingle, hash and whether the sketch has it."""
    own = items.select("item_id", key_of(F.col("item_id")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    own = own.dropDuplicates(["item"]).withColumn("width", F.least(F.size("w"), F.lit(width)))
    spelled = F.coalesce(*(F.when(F.col("width") == k, shingles(k, spelt)) for k in range(1, width + 1)))
    own = own.withColumn("s", F.array_distinct(spelled)).withColumn("n", F.size("s"))
    # partition by size: [2^p, 2^(p+1)); its sketch has one more shingle than its largest leak may lack
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    sketch = F.least(F.col("n"), F.floor(largest * (1 - containment) + 1e-9).cast("int") + 1)
    hashed = lambda x, k: F.xxhash64(*(F.element_at(F.split(x, " "), j + 1) for j in range(k)))

    def entry(x):
        h = F.coalesce(*(F.when(F.col("width") == k, hashed(x, k)) for k in range(1, width + 1)))
        return F.struct(F.xxhash64(h).alias("rank"), h.alias("hash"), x.alias("shingle"))

    ranked = F.array_sort(F.transform("s", entry))
    return own.select("item_id", "item", "width", "n", sketch.alias("sketch"), F.posexplode(ranked).alias("at", "x")).select(
        "item_id", "item", "width", "n", F.col("x.shingle").alias("shingle"), F.col("x.hash").alias("hash"), (F.col("at") < F.col("sketch")).alias("probe")
    )


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, key (of its text), item_id, n_shingles, n_shared and containment of every leak."""
    wanted = stash(item_shingles(items, width, containment))
    widths = [r.width for r in wanted.select("width").distinct().orderBy("width").collect()] or [width]  # at most WIDTH rows
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key_of(F.col("doc_id").cast("long")).alias("key"))
    split = docs.select("doc_id", "key", words(F.col("text")).alias("w"))

    hashes = F.flatten(F.array(*(shingles(k, F.xxhash64) for k in widths)))
    probes = small(wanted.where("probe").select("hash").distinct())
    found = split.select("key", F.explode(hashes).alias("hash")).join(probes, "hash", "left_semi").select("key").distinct()
    found = stash(found)

    spelled = F.flatten(F.array(*(shingles(k, lambda *w: F.struct(F.lit(len(w)).alias("width"), spelt(*w).alias("shingle"))) for k in widths)))
    text = docs.join(small(found), "key", "left_semi").select("doc_id", "key", words(F.col("text")).alias("w"))
    text = text.select("doc_id", "key", F.explode(spelled).alias("x")).select("doc_id", "key", "x.width", "x.shingle")
    shared = text.join(small(wanted.select("item_id", "item", "width", "n", "shingle")), ["width", "shingle"])
    # equal rows of documents give equal shingles, which count once
    pairs = shared.groupBy("doc_id", "key", "item_id", "item", "n", "shingle").agg(F.lit(1).alias("one")).groupBy("doc_id", "key", "item_id", "item", "n").count()
    kept = pairs.where(F.col("count") >= F.ceil(F.col("n") * containment - 1e-9))
    best = kept.groupBy("doc_id", "key", "item_id").agg(F.max(F.struct((F.col("count") / F.col("n")).alias("share"), "count", "n")).alias("x"))
    return best.select("doc_id", "key", "item_id", F.col("x.n").cast("long").alias("n_shingles"), F.col("x.count").alias("n_shared"), F.col("x.share").alias("containment"))


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no leak."""
    found = small(stash(leaks(docs, items).select("key").distinct()).withColumnRenamed("key", "leak"))
    return docs.join(found, key_of(F.col("doc_id").cast("long")) == found["leak"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


ORACLE = f"""
WITH item AS (SELECT item_id, text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
doc AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
item_s AS (SELECT DISTINCT item_id, text, least(len(w), {WIDTH}) AS k,
    unnest(list_transform(range(1, len(w) - least(len(w), {WIDTH}) + 2), lambda i: array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' '))) AS s FROM item WHERE len(w) > 0),
size AS (SELECT item_id, text, count(*) AS n FROM item_s GROUP BY ALL),
doc_s AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
    FROM doc, (SELECT DISTINCT k FROM item_s)),
pair AS (SELECT doc_id, item_id, text, count(*) AS c FROM doc_s JOIN item_s USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, max(n) AS n_shingles, max(c) AS n_shared, max(CAST(c AS DOUBLE) / n) AS containment
FROM pair JOIN size USING (item_id, text) WHERE c >= ceil(n * {CONTAINMENT} - 1e-9) GROUP BY doc_id, item_id
"""
