"""Operator 3: a quality classifier on hashed word n-grams.

A logistic regression learns from ``labels.quality`` by follow-the-regularised-
leader (FTRL-proximal) updates. Features of a text are its hashed word unigrams
and bigrams, log counts scaled to length one; a word directly repeated counts as
one common bigram. Every text is scored as a sparse dot product.

``TRAIN_ROWS`` labelled documents at most are learned from, those with the
smallest hash of their doc_id; they are dealt to ``SHARDS`` tasks, whose weights
are averaged (a vector of fixed size from each).

Defined results: a null text counts as empty and gets the score of the intercept
alone; several labels of one document count as their mean, 0.5 or more as 1; null
labels and null doc_ids teach nothing; without labels every score is 0.5; a null
doc_id counts as held out; repeated rows give repeated results; an empty table
gives an empty one. Only ``doc_id`` and ``text`` are read, so other columns never
clash.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_slices

TRAIN_ROWS = 8192
SHARDS = 2
EPOCHS = 12
BITS = 18

#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-4, 1e-5

#: Distinct words whose parts a task keeps; the memory is cleared beyond it.
KEPT_WORDS = 100_000


class Features:
    """Hashed features of texts; one object per task, for its memory of words."""

    def __init__(self):
        import regex
        import xxhash

        self.parts = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+").findall
        self.hash = xxhash.xxh32_intdigest
        self.of_word: dict[str, tuple] = {}


    def __call__(self, texts: list[str]):
        """Row, feature and value of every feature, ordered by row."""
        if len(self.of_word) > KEPT_WORDS:
            self.of_word.clear()
        words = [t.split() for t in texts]
        for w in set(chain.from_iterable(words)).difference(self.of_word):
            self.of_word[w] = tuple(self.hash(p.encode()) for p in self.parts(w))
        flat = [list(chain.from_iterable(map(self.of_word.__getitem__, ws))) for ws in words]
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        h = np.fromiter(chain.from_iterable(flat), np.uint64, int(lengths.sum()))
        row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
        within = row[1:] == row[:-1]
        pair = np.where(h[1:] == h[:-1], np.uint64(1), h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        shift = np.uint64(64 - BITS)
        spread = lambda x, salt: ((x + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)) >> shift
        key = np.concatenate([row << np.uint64(BITS) | spread(h, 0), (row[1:] << np.uint64(BITS) | spread(pair, 7))[within]])
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        value = np.log1p(np.diff(np.append(first, len(key)))).astype(np.float64)
        key = key[first]
        row = (key >> np.uint64(BITS)).astype(np.int64)
        norm = np.sqrt(np.bincount(row, value**2, minlength=len(texts)))
        return row, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), value / norm[row]


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal over (features, values, label); the last one is the intercept."""
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    for _ in range(epochs):
        for f, x, y in examples:
            zf, nf = z[f], n[f]
            w[f] = wf = np.where(np.abs(zf) <= L1, 0.0, (np.sign(zf) * L1 - zf) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(wf @ x, -35, 35))) - y) * x
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * wf
            n[f] = nf + g * g
    return w


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from the labelled documents outside the held-out fold."""
    label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = label.where(fold(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the chosen ones are TRAIN_ROWS rows of two numbers at most
    known = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).alias("shard"))
    known = known.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("text"), "label")

    def run(batches):
        features, examples, shard = Features(), [], None
        for batch in batches:
            shards, texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices([len(t) for t in texts]):
                row, f, x = features(texts[lo:hi])
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    if shards[lo + i] != shard:
                        if examples:
                            yield done(examples)
                        shard, examples = shards[lo + i], []
                    own = slice(ends[i], ends[i + 1])
                    examples.append((np.append(f[own], 1 << BITS).astype(np.int32), np.append(x[own], 1.0).astype(np.float32), batch.column(0)[lo + i].as_py()))
        if examples:
            yield done(examples)

    def done(examples):
        return pa.RecordBatch.from_pydict({"n": [len(examples)], "weights": [learn(examples).astype("<f4").tobytes()]})

    models = known.mapInArrow(run, "n long, weights binary").collect()
    if not models:
        return np.zeros((1 << BITS) + 1, np.float32)
    return np.average([np.frombuffer(m.weights, "<f4") for m in models], axis=0, weights=[m.n for m in models]).astype(np.float32)


def logits(features: Features, texts: list[str], weights: np.ndarray) -> np.ndarray:
    row, f, x = features(texts)
    return np.bincount(row, weights[f] * x, minlength=len(texts)) + weights[-1]


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches):
        features = Features()
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                logit = logits(features, texts, shipped.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(1 / (1 + np.exp(-logit)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs, train(docs, labels, rows))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score 0.5 or more."""
    shipped, place = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows)), docs.columns.index("text")

    def run(batches):
        features = Features()
        for batch in batches:
            for lo, hi, texts in text_slices(batch, place):
                yield batch.slice(lo, hi - lo).filter(pa.array(logits(features, texts, shipped.value) >= 0))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
