"""Operator 2: substring dedup by recompression.

Windows of ``WINDOW`` words that also start in a document with a smaller doc_id are
removed, word by word. Finding them among all windows of all documents would shuffle
every window. Recompression gives equal windows a common symbol instead:

* Names are global because they are hashes. The first round names runs of one word;
  every round then names pairs: a symbol's hash says whether it is a left or a right
  one, and a left one merges with a right one that follows.
* With each symbol goes the stretch of words that its making depended on. A window
  that holds this stretch holds the symbol, wherever the window occurs.
* A window's anchor is the symbol of the latest round that it holds so (of several
  the one with the smallest name, then the first). It depends on the window's words
  alone, so equal windows have equal anchors at equal places. Words themselves are
  round 0, so each window has one.

Neighbouring windows share their anchor. One row stands for such a stretch: the
anchor's name, a digest of the stretch, document and place. Names only bring
stretches together; what tells them equal is a cryptographic digest of their words
as they are written (BLAKE2b, 128 bits), so words or pairs whose hashes collide
remove nothing. Stretches found elsewhere word for word need no more; where an
anchor has several stretches, the windows of one document for each are compared
by the same kind of digest.

Defined results: words are separated by ASCII white space; null, empty and short
texts lose nothing; rows without doc_id neither lose words nor cost others any; of
rows with one doc_id none is smaller; repeated rows give repeated results; an empty
table gives an empty one. Only ``doc_id`` and ``text`` are read, so other columns
never clash.
"""

from __future__ import annotations

from functools import partial
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stash, table, with_text

WINDOW = 50
ROUNDS = 7

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def word_names(words: list[list[bytes]]) -> np.ndarray:
    import xxhash

    n = sum(map(len, words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, n)


def digests(words: list[bytes], begin: np.ndarray, end: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    """Digests of stretches [begin, end) of ``words``, and of a mark of each, as rows of two 64-bit numbers."""
    whole = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    at = np.concatenate([[0], np.cumsum(sizes)])
    salts = [b""] * len(begin) if marks is None else [int(m).to_bytes(8, "little") for m in marks]
    found = [blake2b(whole[a:b], digest_size=16, salt=m).digest() for a, b, m in zip(at[begin].tolist(), (at[end] - 1).tolist(), salts, strict=True)]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def symbols(names: np.ndarray, bounds: np.ndarray):
    """Symbols made in each round: name, first word, and the stretch [low, high) that they depend on.

    ``bounds`` has where documents begin, and the end. Stretches beyond WINDOW are left out.
    """
    n, far = len(names), np.int64(1) << 40
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    name, low, high = names, at, at + 1
    yield name, at, low, high
    for r in range(ROUNDS):
        joined = doc[1:] == doc[:-1]
        # what a symbol depends on if it depends on its neighbour: the end of a document is no neighbour
        left_low = np.concatenate([[-far], np.where(joined, low[:-1], -far)])
        right_high = np.concatenate([np.where(joined, high[1:], far), [far]])
        if r == 0:
            # runs: the last symbol of each has the run's length; single ones keep their name
            same = joined & (name[1:] == name[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            length = np.diff(np.append(first, len(name)))
            last = first + length - 1
            name = np.where(length > 1, mixed(name[first] + ODD * length.astype(np.uint64)), name[first])
            new, start = length > 1, at[first]
            low, high, at, doc = np.minimum(left_low[first], low[first]), np.maximum(right_high[last], high[last]), start, doc[first]
        else:
            bit = (mixed(name + np.uint64(r)) >> np.uint64(63)).astype(bool)  # True: a left one
            merges = np.concatenate([bit[:-1] & ~bit[1:] & joined, [False]])
            second = np.concatenate([[False], merges[:-1]])
            partner = np.concatenate([name[1:], name[:1]])
            pair_high = np.concatenate([high[1:], high[:1]])
            alone_low = np.where(bit, low, np.minimum(low, left_low))
            alone_high = np.where(bit, np.maximum(high, right_high), high)
            name = np.where(merges, mixed(name * ODD + mixed(partner + np.uint64(r))), name)
            low, high = np.where(merges, low, alone_low), np.where(merges, pair_high, alone_high)
            kept = ~second
            name, low, high, at, doc, new = name[kept], low[kept], high[kept], at[kept], doc[kept], merges[kept]
        fits = new & (high - low <= WINDOW)
        yield name[fits], at[fits], low[fits], high[fits]


def anchors(names: np.ndarray, bounds: np.ndarray):
    """First words of all windows, and for each the name and the first word of its anchor."""
    n = len(names)
    size = np.diff(bounds)
    windows = np.flatnonzero(np.arange(n) + WINDOW <= np.repeat(bounds[1:], size))
    anchor, place = np.zeros(len(windows), np.uint64), np.zeros(len(windows), np.int64)
    open_ = np.arange(len(windows))
    rounds = list(symbols(names, bounds))
    for r in range(len(rounds) - 1, -1, -1):
        name, at, low, high = rounds[r]
        if not len(open_) or not len(name):
            continue
        p = windows[open_]
        before = np.concatenate([[0], np.cumsum(np.bincount(low, minlength=n + 1))])
        lo = before[p]  # symbols whose stretch begins earlier
        hi = np.cumsum(np.bincount(high, minlength=n + 1))[p + WINDOW]  # symbols whose stretch ends in time
        has = np.flatnonzero(hi > lo)
        lo, hi = lo[has], hi[has]
        best = smallest(name, lo, hi)
        anchor[open_[has]], place[open_[has]] = mixed(name[best] + np.uint64(r)), at[best]
        open_ = np.delete(open_, has)
    return windows, anchor, place


def smallest(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the first smallest value in each [lo, hi), by tables of powers of two."""
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    best = np.arange(len(values))
    for k in range(int(power.max()) + 1 if len(power) else 0):
        own = np.flatnonzero(power == k)
        a, b = best[lo[own]], best[hi[own] - (1 << k)]
        out[own] = np.where(values[a] <= values[b], a, b)
        if len(best) > 1 << k:
            a, b = best[: -(1 << k)], best[1 << k :]
            best = np.where(values[a] <= values[b], a, b)
    return out


def parsed(batches, texts_at: int):
    """Slices of Arrow batches: rows lo..hi, their words and where each document's begin."""
    for batch in batches:
        texts = with_text(batch, texts_at)
        for lo, hi in slices([len(t) for t in texts]):
            words = [split(t) for t in texts[lo:hi]]
            yield batch, lo, hi, words, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def find_stretches(batches, naming=word_names):
    """name, h1, h2, doc_id, part, first, last: windows first..last of a document share an anchor; h1 and h2 are the stretch's digest."""
    for batch, lo, _, words, bounds in parsed(batches, 2):
        names = naming(words)
        if not len(names):
            continue
        window, anchor, place = anchors(names, bounds)
        doc = np.searchsorted(bounds, window, "right") - 1
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new[: len(window)])
        last = np.append(first[1:], len(window)) - 1
        a, b = window[first], window[last]
        # where the anchor lies in the stretch counts too
        shape = ((a - place[first] + (1 << 20)).astype(np.uint64) << np.uint64(32)) + (b - a).astype(np.uint64)
        own = doc[first]
        begin = np.searchsorted(own, np.arange(len(words) + 1))
        digest = [np.zeros((0, 2), np.int64)]
        for i in np.unique(own).tolist():
            some = slice(begin[i], begin[i + 1])
            digest.append(digests(words[i], a[some] - bounds[i], b[some] - bounds[i] + WINDOW, shape[some]))
        digest = np.concatenate(digest)
        rows = pa.array(own + lo)
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[first].view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), batch.column(0).take(rows), batch.column(1).take(rows),
             pa.array((a - bounds[own]).astype(np.int32)), pa.array((b - bounds[own]).astype(np.int32))],
            names=["name", "h1", "h2", "doc_id", "part", "first", "last"],
        )


def hash_windows(batches):
    """h1, h2, doc_id, part, at: digests of the windows of the stretches asked for."""
    for batch, lo, hi, words, _ in parsed(batches, 2):
        asked = batch.column(3)
        for i in range(lo, hi):
            spans = asked[i].as_py() or []
            p = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.arange(s["first"], s["last"] + 1) for s in spans)]))
            digest = digests(words[i - lo], p, p + WINDOW)
            ids = [pa.array([batch.column(k)[i].as_py()] * len(p), batch.column(k).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest[:, 0]), pa.array(digest[:, 1]), *ids, pa.array(p.astype(np.int32))],
                names=["h1", "h2", "doc_id", "part", "at"],
            )


def cut_words(batches):
    """doc_id, n_words, n_removed and the kept text, from doc_id, part, text and removed stretches."""
    for batch, lo, hi, words, bounds in parsed(batches, 2):
        gone = batch.column(3)
        removed, kept = [], []
        for i in range(lo, hi):
            own, n = words[i - lo], len(words[i - lo])
            spans = gone[i].as_py()
            if spans:
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, [s["first"] for s in spans], 1)
                np.add.at(depth, [s["last"] + WINDOW for s in spans], -1)
                stays = np.cumsum(depth)[:n] == 0
                own = [own[k] for k in np.flatnonzero(stays)]
            removed.append(n - len(own))
            kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
        sizes = pa.array(np.diff(bounds))
        yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], sizes, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def beside(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """``docs`` with the stretches of each document."""
    spans = stash(spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    return docs.join(spans, ["doc_id", "part"], how).select("doc_id", "part", "text", "spans")


def repeats(docs: DataFrame, naming=word_names) -> DataFrame:
    """doc_id, part, first, last: windows first..last start in a smaller doc_id too. ``docs`` has doc_id, part, text."""
    found = docs.where("doc_id is not null and length(text) >= 99")  # fifty words and the space between them
    found = stash(found.mapInArrow(partial(find_stretches, naming=naming), "name long, h1 long, h2 long, doc_id long, part int, first int, last int"))
    shared = found.groupBy("name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), (F.min(F.struct("h1", "h2")) != F.max(F.struct("h1", "h2"))).alias("several")).where("a < b")
    # what is aggregated is written before it is joined, so that Spark can split a hot name
    shared = stash(found.join(stash(shared.select("name", "several")), "name"))
    least = stash(shared.groupBy("name", "h1", "h2").agg(F.min("doc_id").alias("least")))
    shared = stash(shared.join(least, ["name", "h1", "h2"]).where("several or doc_id > least"))
    whole = shared.where("doc_id > least").select("doc_id", "part", "first", "last")
    # an anchor with several stretches: the windows of the first document of each are compared
    asked = beside(docs, shared.where("doc_id = least").select("doc_id", "part", "first", "last"), "inner")
    windows = stash(asked.mapInArrow(hash_windows, "h1 long, h2 long, doc_id long, part int, at int"))
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    single = windows.join(stash(least.drop("most")), ["h1", "h2"]).where("doc_id > least").select("doc_id", "part", F.col("at").alias("first"), F.col("at").alias("last"))
    return whole.unionByName(single)


def dedup(docs: DataFrame, naming=word_names) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every row. ``naming`` gives the 64-bit names of words."""
    docs = docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("part"), F.col("text").cast("string"))
    return beside(docs, repeats(docs, naming), "left").mapInArrow(cut_words, "doc_id long, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
