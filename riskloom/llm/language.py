"""Operator 8: language identification by prediction by partial matching.

Per language, counts of byte contexts of order 0 to ``ORDER`` form a context tree
whose statistics are frozen after training. A byte costs -log2 of its share in
the longest known context; where that context has not seen it, the escape
probability (distinct bytes over total plus distinct) is paid and the next
shorter context asked, down to an even share of 1/256. The language with the
shortest code for the whole text is the answer, and its posterior share the score.

``TRAIN_ROWS`` documents of each language, about, are learned from, or fewer where
these would have more than ``TRAIN_BYTES`` together: those whose hash is smallest.
Their whole texts count, and every context of them is kept. Spark counts the
contexts; languages are then put into groups whose tables stay within
``MODEL_BYTES``, and the groups score every text one after the other, so that the
result is that of all languages at once. The driver holds one row for each
language (``MOST_LANGS`` at most, else an error) and the counts of one group.

Defined results: null texts and texts without a letter give ``und`` with score 0;
ties go to the first language in order; null langs and null doc_ids teach
nothing; with nothing learned every row is ``und``; a null doc_id counts as held
out; repeated rows give repeated results; an empty table gives an empty one. Only
``doc_id``, ``text`` and (to learn) ``lang`` are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, table
from .quality import fold

ORDER = 3

#: The answer for texts that no language was tried on.
UNKNOWN = "und"

TRAIN_ROWS = 400

#: Bytes of text that one language is learned from, about, at most.
TRAIN_BYTES = 1 << 26

#: Bytes of one table of a group of languages at most.
MODEL_BYTES = 1 << 28

#: More kinds of ``lang`` than this are no languages.
MOST_LANGS = 10_000


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 of all texts, each after ORDER zeros, and where each text starts."""
    gap = bytes(ORDER)
    starts = np.fromiter(accumulate((len(t) + ORDER for t in texts), initial=ORDER), np.int64, len(texts) + 1)[:-1]
    mark = np.ones(sum(map(len, texts)) + ORDER * len(texts), bool)
    for k in range(1, ORDER + 1):
        mark[starts - k] = False
    joined = np.frombuffer(b"".join(gap + t for t in texts), np.uint8).astype(np.int64)
    joined[mark] += 1
    return joined, starts


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram and n: how often ORDER + 1 symbols follow each other (9 bits each, first highest)."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for lo, hi in slices([len(t) for t in own]):
                    s, starts = padded(own[lo:hi])
                    gram = sum(s[k : len(s) - ORDER + k] << 9 * (ORDER - k) for k in range(ORDER + 1))
                    gram, n = np.unique(gram[(s > 0)[ORDER:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram)), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

    found = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Code lengths of a symbol after a context, for every language, in sorted tables of what was seen.

    For each order: the grams (a context and a symbol) that some language has, with the
    code length in every language, and the contexts, with what escaping from each costs.
    """

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        symbols = lambda g, k: (g >> 9 * (ORDER - k)) & 511
        seen = np.unique(np.concatenate([symbols(g, ORDER) for g, _ in grams.values()]))
        self.code = np.zeros(257, np.int64)  # 0: the start of a text, and bytes that no training text has
        self.code[seen] = np.arange(1, len(seen) + 1)
        size = self.size = len(seen) + 1
        packed = {x: (sum(self.code[symbols(g, k)] * size ** (ORDER - k) for k in range(ORDER + 1)), n) for x, (g, n) in grams.items()}
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        for order in range(ORDER + 1):
            own = {x: self.summed(key % size ** (order + 1), n) for x, (key, n) in packed.items()}
            keys = np.unique(np.concatenate([k for k, _ in own.values()]))
            contexts = np.unique(keys // size)
            below = self.costs(order - 1, keys % size**order)
            bits, escapes = np.empty((len(keys), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
            for k, lang in enumerate(langs):
                key, n = own[lang]
                count, at = np.zeros(len(keys)), np.searchsorted(contexts, keys // size)
                count[np.searchsorted(keys, key)] = n
                total, kinds = np.bincount(at, count, len(contexts)), np.bincount(at, count > 0, len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    escapes[:, k] = np.where(total > 0, np.log2(total + kinds) - np.log2(kinds), 0)
                    bits[:, k] = np.where(count > 0, np.log2(total + kinds)[at] - np.log2(count), escapes[at, k] + below[:, k])
            for table, new in ((self.keys, keys), (self.bits, bits), (self.contexts, contexts), (self.escapes, escapes)):
                table.append(new)

    @staticmethod
    def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(key, return_inverse=True)
        return key, np.bincount(back.ravel(), n, len(key))

    def costs(self, order: int, key: np.ndarray) -> np.ndarray:
        """Bits of grams of an order (row) in each language (column)."""
        if order < 0:
            return np.full((len(key), len(self.langs)), 8.0, np.float32)
        at = np.minimum(np.searchsorted(self.keys[order], key), len(self.keys[order]) - 1)
        out, new = self.bits[order][at], np.flatnonzero(self.keys[order][at] != key)
        if len(new):
            context = key[new] // self.size
            at = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            known = self.contexts[order][at] == context
            out[new] = self.escapes[order][at] * known[:, None] + self.costs(order - 1, key[new] % self.size**order)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text (row) in each language (column)."""
        s, starts = padded(texts)
        c = self.code[s]
        key = sum(c[k : len(c) - ORDER + k] * self.size ** (ORDER - k) for k in range(ORDER + 1))[s[ORDER:] > 0]
        key, back = np.unique(key, return_inverse=True)
        bits, back = self.costs(ORDER, key), back.ravel()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        out = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            total = np.concatenate([[0.0], np.cumsum(bits[back, k], dtype=np.float64)])
            out[:, k] = total[ends] - total[ends - sizes]
        return out


def sample(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame | None:
    """lang and text of what is learned from, the same rows at every run."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(F.col("doc_id"), 4) != 2)
    counts = known.groupBy("lang").agg(F.count("*"), F.sum(F.octet_length("text"))).limit(MOST_LANGS + 1).collect()
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not counts:
        return None
    share = F.create_map(*(F.lit(x) for lang, n, total in counts for x in (lang, min(1.0, rows / n, size / max(total, 1)))))
    return known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")


def groups(sizes: dict[str, int]) -> list[list[str]]:
    """Languages in order, cut into groups whose tables stay within MODEL_BYTES even if no two share a gram."""
    out, held = [], 0
    for lang in sorted(sizes):
        # a row for each gram and one for each context, four bytes for each language
        if not out or 8 * (len(out[-1]) + 1) * (held + sizes[lang]) > MODEL_BYTES:
            out.append([])
            held = 0
        if 8 * sizes[lang] > MODEL_BYTES:
            raise ValueError(f"the statistics of {lang!r} alone do not fit a task's memory: learn from fewer bytes")
        out[-1].append(lang)
        held += sizes[lang]
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> list[Callable[[], Model]]:
    """What builds the model of each group of languages; nothing where there is nothing to learn."""
    chosen = sample(docs, rows, size)
    if chosen is None:
        return []
    grams = stash(count_grams(chosen))

    def build(langs: list[str]) -> Model:
        found = grams.where(F.col("lang").isin(langs)).toPandas()
        return Model(langs, {x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in found.groupby("lang")})

    return [partial(build, langs) for langs in groups(dict(grams.groupBy("lang").count().collect()))]


def scored(rows: DataFrame, model: Model, last: bool) -> DataFrame:
    """``rows`` (doc_id, text, lang_pred, bits, shares) with the languages of ``model`` tried too; the last one drops the text.

    ``bits`` is the shortest code so far, ``shares`` the sum of all languages' shares relative to it.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # MODEL_BYTES for each table at most

    def run(batches):
        import regex

        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [i for i, t in enumerate(texts) if t and letter(t)]
            lang, least, shares = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            coded = [texts[i].encode() for i in own]
            for lo, hi in slices([len(t) for t in coded]):
                bits = shipped.value.code_lengths(coded[lo:hi])
                shortest = bits.min(1)
                share = np.exp2(np.clip(shortest[:, None] - bits, -1000, 0)).sum(1)
                for i, b, x, p in zip(own[lo:hi], bits.argmin(1), shortest, share, strict=True):
                    if lang[i] == UNKNOWN:
                        lang[i], least[i], shares[i] = shipped.value.langs[b], x, p
                    elif x < least[i]:
                        lang[i], least[i], shares[i] = shipped.value.langs[b], x, p + shares[i] * 2 ** max(x - least[i], -1000.0)
                    else:
                        shares[i] += p * 2 ** max(least[i] - x, -1000.0)
            tried = [pa.array(lang, pa.string()), pa.array(least, pa.float64()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *tried] if last else [batch.column(0), batch.column(1), *tried], names=names)

    told = rows.drop("text") if last else rows
    names = told.columns
    return rows.mapInArrow(run, told.schema)


def identify(docs: DataFrame, models: list[Callable[[], Model]]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("bits"), F.lit(0.0).alias("shares")
    )
    for k, build in enumerate(models, 1):
        # each group after the first reads what the one before it wrote, so that a task holds one model
        rows = scored(rows if k == 1 else stash(rows), build(), k == len(models))
    return rows.select("doc_id", "lang_pred", F.when(F.col("shares") > 0, 1 / F.col("shares")).otherwise(0.0).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
