"""Operator 9: byte-level BPE encoding and decoding with the tokenizers library.

The rank file gives the byte strings of the ids. ``tokenizer_json`` turns them
into a ``tokenizers`` model: bytes become printable characters (the table that
byte-level BPE files use) and the merge list follows from the ranks. Each task
takes Arrow batches, has the library encode every distinct chunk of a slice of
texts once, many of them joined in one text, and lays the ids out per document.
Decoding reverses the table of bytes over the characters that spell the ids; the
place of an id in its text is counted in the bytes decoded.

Defined results: a null text counts as empty; an empty text has no ids; a null
doc_id is kept; repeated rows give repeated results; an empty table gives an
empty one. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_slices

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Whether two white-space characters meet.
MET = re.compile(r"\s\s").search

#: Chunks that the library gets as one text.
JOINED = 256

#: Distinct chunks in each of the two generations of a task's memory.
KEPT_CHUNKS = 150_000


class Memory:
    """What the library gave for the chunks seen lately, packed as numbers.

    Two generations bound it: when the young one is full it becomes the old one,
    from which chunks that are seen again move back.
    """

    def __init__(self, encode, kept: int = KEPT_CHUNKS):
        self.encode, self.kept = encode, kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def each(self, chunks: list[str]) -> list[bytes]:
        """What the library gives for each of some distinct chunks."""
        if len(self.young) > self.kept:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, chunks))
        missing = [i for i, f in enumerate(found) if f is None]
        again = list(map(self.old.get, map(chunks.__getitem__, missing)))
        new = [chunks[i] for i, f in zip(missing, again, strict=True) if f is None]
        made = iter(self.encode(new))
        for i, f in zip(missing, again, strict=True):
            found[i] = self.young[chunks[i]] = next(made) if f is None else f
        return found


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by id from a rank file."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [ranks[i] for i in range(len(ranks))]


def split_by_ranks(token: bytes, rank_of: dict[bytes, int]) -> list[bytes]:
    """The two parts whose merge makes ``token``: merge below its own rank until two stay."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = rank_of[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: rank_of.get(parts[i] + parts[i + 1], own))
        if rank_of.get(parts[best] + parts[best + 1], own) >= own:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def tokenizer_json(tokens: list[bytes], pattern: str) -> str:
    """A ``tokenizers`` file for the ranks; each match of ``pattern`` is encoded separately."""
    shown = byte_characters()
    name = ["".join(shown[b] for b in t) for t in tokens]
    rank_of = {t: i for i, t in enumerate(tokens)}
    merges = []
    for t in tokens:
        if len(t) > 1 and len(parts := split_by_ranks(t, rank_of)) == 2:
            merges.append(["".join(shown[b] for b in p) for p in parts])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}]},
        "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": {n: i for i, n in enumerate(name)}, "merges": merges},
    })


def list_column(values: np.ndarray, lengths) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


class Coder:
    """Encodes and decodes texts by a tokenizer file; one object per process, for the chunks that it knows."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is enough
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.memory = Memory(self.packed)
        # decoding: the byte table reversed, over the characters that spell each id
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        names = sorted((i, name) for name, i in json.loads(file)["model"]["vocab"].items())
        spelt = [bytes(map(byte_of.__getitem__, name)) for _, name in names]
        self.every, self.width = np.frombuffer(b"".join(spelt), np.uint8), np.fromiter(map(len, spelt), np.int32, len(spelt))
        self.begin = np.cumsum(self.width, dtype=np.int32) - self.width

    def whole(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as 32-bit numbers."""
        for lo in range(0, len(texts), 5000):
            for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 5000], add_special_tokens=False):
                yield array("i", e.ids).tobytes()

    def packed(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as 32-bit numbers.

        Chunks that begin with their only space are joined to one text, which the pattern
        parts at these spaces, but for those that end in white space, where two would meet.
        """
        out: list[bytes] = [b""] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if c[:1] == " " and not c[-1].isspace()]
        alone = np.delete(np.arange(len(chunks)), joined).tolist()
        for lo in range(0, len(joined), 20 * JOINED):
            groups = [joined[g : g + JOINED] for g in range(lo, min(lo + 20 * JOINED, len(joined)), JOINED)]
            coded = self.tokenizer.encode_batch_fast(["".join(map(chunks.__getitem__, group)) for group in groups], add_special_tokens=False)
            for group, e in zip(groups, coded, strict=True):
                ids = np.array(e.ids, np.int32)
                ends = np.cumsum(self.width[ids])
                wanted = np.cumsum([len(chunks[i].encode()) for i in group])
                after = np.searchsorted(ends, wanted) + 1
                if not len(ends) or ends[-1] != wanted[-1] or (ends[after - 1] != wanted).any():  # an id goes over the end of a chunk
                    alone += group
                    continue
                packed, cuts = ids.tobytes(), (after * 4).tolist()
                for i, start, end in zip(group, [0, *cuts], cuts, strict=False):
                    out[i] = packed[start:end]
        for i, ids in zip(alone, self.whole([chunks[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each text has.

        Where no two white-space characters meet, the pattern never joins what a space
        parts, so a text is looked up space by space; other texts go to the library whole.
        """
        whole = [i for i, t in enumerate(texts) if MET(t)]
        others = np.delete(np.arange(len(texts)), whole)
        words = pc.split_pattern(pa.array([texts[i] for i in others], pa.string()), " ")
        coded, bounds = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        spaced = np.ones(len(coded), np.int32)  # all words but a text's first have their space
        spaced[bounds[:-1]] = 0
        kinds, key = np.unique(coded.indices.to_numpy() * 2 + spaced, return_inverse=True)
        spelt = coded.dictionary.to_pylist()
        chunks = [" " + spelt[k >> 1] if k & 1 else spelt[k >> 1] for k in kinds.tolist()]
        pieces = self.memory.each(chunks) + list(self.whole([texts[i] for i in whole]))
        flat = np.frombuffer(b"".join(pieces), np.int32)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        # chunks in the order of the texts
        n_chunks = np.ones(len(texts), np.int64)
        n_chunks[others] = np.diff(bounds)
        first = np.cumsum(n_chunks) - n_chunks
        order = np.empty(n_chunks.sum(), np.int64)
        is_whole = np.zeros(len(order), bool)
        is_whole[first[whole]] = True
        order[is_whole], order[~is_whole] = len(chunks) + np.arange(len(whole)), key.ravel()
        n = size[order]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(size) - size)[order] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        return flat[at], np.add.reduceat(n, first) if len(n) else n

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and where those of each end."""
        w = self.width[ids]
        ends = np.cumsum(w, dtype=np.int64)
        return self.every[np.repeat(self.begin[ids] - ends + w, w) + np.arange(ends[-1] if len(ends) else 0)], ends

    def decoded(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """One binary value for each run of ids: bytes are joined before anything reads them as characters."""
        return runs(*self.decode(ids), lengths)


def runs(out: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary value for each run of ids that end at ``ends`` of the bytes ``out``."""
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(cuts), pa.py_buffer(out)])


def first_characters(out: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The character of its text in which each id begins, for runs of ids that end at ``ends`` of the bytes ``out``."""
    if not len(ends):
        return np.zeros(0, np.int32)
    at = np.cumsum((out & 0xC0) != 0x80, dtype=np.int32)[np.concatenate([[0], ends[:-1]])]  # bytes that begin a character
    some = lengths[lengths > 0]
    return at - np.repeat(at[np.cumsum(some) - some], some)


#: The coder of this Python process: tasks that follow one another share it.
SHARED: dict[str, Coder] = {}


def shared_coder(file: str) -> Coder:
    if file not in SHARED:
        SHARED.clear()
        SHARED[file] = Coder(file)
    return SHARED[file]


def shipped(docs: DataFrame, path: str | None, pattern: str | None = None):
    """The tokenizer file for the ranks, broadcast: its size is fixed by the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(path or public_tokenizers.path(RANKS)), pattern or public_tokenizers.PATTERN))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array of int) and, if asked for, starts (each id's first character) and bytes (the ids decoded again).

    An id that begins inside a character has that character's place.
    """
    file = shipped(docs, path, pattern)
    schema = "doc_id long, ids array<int>" + ", starts array<int>" * offsets + ", bytes binary" * decoded
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        coder = shared_coder(file.value)
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                ids, lengths = coder.encode(texts)
                columns = [batch.column(0)[lo:hi], list_column(ids, lengths)]
                spelt = (*coder.decode(ids), lengths) if offsets or decoded else ()
                columns += ([list_column(first_characters(*spelt), lengths)] if offsets else []) + ([runs(*spelt)] if decoded else [])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and their bytes, from columns doc_id and ids.

    A character that several ids share comes back whole. An id outside the vocabulary fails.
    """
    file = shipped(encoded, path)

    def run(batches):
        coder = shared_coder(file.value)
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for lo, hi in slices(sizes.tolist()):
                ids = lists[lo:hi].flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], lists[lo:hi], coder.decoded(ids, sizes[lo:hi])], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def decode_text(tokens: list[bytes], ids: list[int], pending: bytes = b"") -> tuple[str, bytes]:
    """Text of some ids that follow ``pending``, and the bytes of a character still open at their end."""
    import codecs

    reader = codecs.getincrementaldecoder("utf-8")("replace")
    text = reader.decode(pending + b"".join(tokens[i] for i in ids))
    return text, reader.getstate()[0]


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
        *([F.try_element_at("starts", F.lit(-1)).alias("last_start")] if "starts" in decoded.columns else []),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents"), offsets=True, decoded=True))
