"""Operator 13: spelling variants grouped by a variable-length gram index.

Words are counted over all texts. Two are near if one inserted, deleted or replaced code
point parts them; every word is led to the much more frequent word next to it.

The gram dictionary is pruned by frequency: a gram of LEAST_GRAM code points or more
that at most RARE words contain is never extended, so words fall apart into grams of
LEAST_GRAM to MOST_GRAM code points, longer where short ones say little. A gram is fixed
by its own code points, hence an edit leaves alone every gram to its left that ends
before it, and every gram to its right that no changed gram can swallow. For each place
of an edit the word's own bound says which grams these are; as MOST_GRAM is at most half
of the shortest word, there is always one. Near words share all of them, so the lists of
these grams are merged at once, by grouping on their hash together with the length that
the edit leaves: one key for each place. The keys of a word follow from its grams in one
pass, so that long words cost no more than their length.

Words that share a key differ in the few code points that its grams do not cover, which
bounds a list by the alphabet and not by the corpus. What meets is verified by edit
distance. The dictionary's frequent grams, below the square of the alphabet in number,
are all that is broadcast.

Defined results: null texts have no words; a row without doc_id counts as if its doc_id
were an empty string; repeated rows count each time; an empty table gives an empty
result. Ties between forms go to the word that is first in code-point order. Texts are
cut at non-letters into parts of about PART_BYTES, whose counts add up. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table, text_slices

#: Words count from this many code points and occurrences; a form is this much more frequent than its word.
LEAST_LENGTH, LEAST_SEEN, TIMES = 6, 5, 5

#: One in so many runs of letters loses a code point.
EDIT_ONE_IN = 199

#: Sizes of grams, and words that may contain a gram that is not extended.
LEAST_GRAM, MOST_GRAM, RARE = 2, 3, 64

#: Bytes of a text that are split at once, and words and bytes that a task counts before it passes them on.
PART_BYTES, HELD_WORDS, HELD_BYTES = 1 << 20, 200_000, 32 << 20

# A-Z in lower case, letters of Latin-1 as they are, a space for anything else.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def parts(letters: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that end where a run does."""
    lo = 0
    while lo < len(letters):
        hi = letters.find(b" ", lo + size)
        hi = len(letters) if hi < 0 else hi
        yield letters[lo:hi]
        lo = hi


def runs(doc: str, text: str) -> Iterator[tuple[bytes, int]]:
    """Words of a document as Latin-1 bytes, one for each code point, with their counts."""
    start = zlib.crc32(f"{doc}:".encode())
    crc = zlib.crc32
    for part in parts(text.encode("latin-1", "replace").translate(LETTERS)):
        for word, n in Counter(part.split()).items():
            if len(word) < LEAST_LENGTH:
                continue
            h = crc(word if word.isascii() else word.decode("latin-1").encode(), start)
            if not h % EDIT_ONE_IN:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LEAST_LENGTH:
                    continue
            yield word, n


def words(docs: DataFrame) -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def batch_of(seen):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        seen, held = {}, 0
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                for doc, text in zip(batch.column(0)[lo:hi].to_pylist(), texts, strict=True):
                    for word, n in runs(doc, text):
                        if word in seen:
                            seen[word] += n
                        else:
                            seen[word] = n
                            held += len(word)
                            if len(seen) >= HELD_WORDS or held >= HELD_BYTES:
                                yield batch_of(seen)
                                seen, held = {}, 0
        if seen:
            yield batch_of(seen)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_SEEN)


def frequent_grams(vocabulary: DataFrame) -> set[str]:
    """Grams below MOST_GRAM code points that more than RARE words contain: those that are extended."""
    out = set()
    for size in range(LEAST_GRAM, MOST_GRAM):
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - size + 1), lambda at: F.substring("word", at, F.lit(size))))
        found = vocabulary.select(F.explode(grams).alias("gram")).groupBy("gram").count().where(F.col("count") > RARE)
        out.update(r.gram for r in found.collect())  # the alphabet to the power of ``size`` at most
    return out


def gram_sizes(word: str, frequent: set[str]) -> list[int]:
    """Code points of the gram that starts at each place; one that the word's end cuts off has MOST_GRAM."""
    out = []
    for at in range(len(word) - LEAST_GRAM + 1):
        size = LEAST_GRAM
        while size < MOST_GRAM and (at + size > len(word) or word[at : at + size] in frequent):
            size += 1
        out.append(size)
    return out


def kept_by_edits(word: str, sizes: list[int]) -> tuple[list[int], list[int]]:
    """For every place: where the grams end that an edit there leaves alone on its left, and where those on its right start."""
    n = len(word)
    ends = [0] * (n + 1)
    for at, size in enumerate(sizes):
        if at + size <= n:
            ends[at + size] = at + size
    for at in range(1, n + 1):
        ends[at] = max(ends[at], ends[at - 1])
    starts = [n] * (n + 2)
    for at in range(n - MOST_GRAM + 1):
        # the first gram here that reaches beyond what a changed gram on the left can swallow
        starts[at] = next(p for p in range(at, at + MOST_GRAM) if min(p + sizes[p], n) - at >= MOST_GRAM)
    return ends, starts


def places(word: str, frequent: set[str]) -> set[tuple[int, int, int]]:
    """(end, start, length left) for every place of an edit: word[:end] and word[start:] are what it leaves alone for certain."""
    n = len(word)
    ends, starts = kept_by_edits(word, gram_sizes(word, frequent))
    return {(ends[i], starts[i + 1], n - 1) for i in range(n)} | {(ends[i], starts[i], n) for i in range(n + 1)}


def keys(vocabulary: DataFrame, frequent: set[str]) -> DataFrame:
    """A row for each word and place: key (a hash), word and n."""
    from xxhash import xxh64

    if 2 * MOST_GRAM > LEAST_LENGTH:
        raise ValueError("grams must not exceed half of the shortest word")
    shipped = vocabulary.sparkSession.sparkContext.broadcast(frequent)  # below the square of the alphabet

    def hashes(codes: bytes, width: int) -> np.ndarray:
        """Hashes of the first 0, 1, ... code points."""
        state, out = xxh64(seed=13), [0]
        for at in range(0, len(codes), width):
            state.update(codes[at : at + width])
            out.append(state.intdigest())
        return np.array(out, np.uint64)

    def run(batches):
        grams = shipped.value
        for batch in batches:
            own, found = [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                p = np.array([*places(word, grams)], np.int64)
                left = hashes(word.encode("utf-32-le"), 4)[p[:, 0]]
                right = hashes(word[::-1].encode("utf-32-le"), 4)[len(word) - p[:, 1]]
                key = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right * np.uint64(0xC2B2AE3D27D4EB4F) + p[:, 2].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
                found.append(np.unique(key).view(np.int64))
                own.append(np.full(len(found[-1]), i))
            if own:
                each = pa.array(np.concatenate(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(each), batch.column(1).take(each)], names=["key", "word", "n"])

    return vocabulary.select("word", "n").mapInArrow(run, "key long, word string, n long")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, other and n (of the other) for all near words, both ways."""
    rows = stash(keys(vocabulary, frequent_grams(vocabulary)))
    other = rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    met = rows.select("key", "word").join(other, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return met.groupBy("word", "other").agg(F.first("other_n").alias("n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: from (word, form) along the forms to the last, by doubling the steps; n grows with each, so there is no circle."""
    up = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stash(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return up


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    vocabulary = stash(words(docs))
    best = F.max_by(F.struct("other", "n"), "n")
    near = near_words(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("other").alias("other"))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    found = vocabulary.join(near, "word", "left")
    has = F.col("best.n") >= TIMES * F.col("n")
    found = stash(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, F.col("best.n")).alias("form_n")))
    named = found.join(roots(found.where("form is not null")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
