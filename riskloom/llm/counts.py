"""Operator 6: token counts by finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers, and is
not asked afterwards.

* The first reads characters (as symbols that know what follows them) and tells
  where a new piece starts. It has eight states. Texts are cut into chunks of
  ``CHUNK`` characters, which all run at once from every state: each yields a state
  map. The maps are composed by a parallel prefix scan, which gives the state in
  which every chunk begins, and the chunks run once more from there.
* The second reads the bytes of a piece, and is in its start state wherever a piece
  begins, which makes its part of every map constant there. It follows from the
  merges: of the tokens that a prefix of a piece can end with, just one fits the
  tokens before it, so each byte makes known the last token of the prefix that it
  ends, and how many tokens that prefix has. A state holds, for every place where a
  longer token may have begun, the node of the token tree reached from there, the
  last token before it, and its count against the present one. Its transitions are
  annotated with the tokens that they add. States are made when first reached, and
  kept for the process (at most ``KEPT_STATES``, then they are made anew).

Distinct pieces of a slice run once, all at the same time, byte by byte.

Defined results: a null text counts as empty and has no tokens; a special token's
string in a text is one token and parts the text, as the library has it; repeated
rows give repeated results; an empty table gives an empty one. A tokenizer that is
not of this kind (another pre-tokenizer, a normaliser, merges out of order) is
refused. Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import slices, table, text_slices

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 512

#: States of the second transducer that a process keeps, and bytes of pieces that run together.
KEPT_STATES = 400_000
TOGETHER_BYTES = 1 << 20

#: A piece of more bytes runs by itself.
LONG_PIECE = 1024

# Symbols: what a character is, and for white space and apostrophes what follows.
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, SHORT, LONG = range(8)
#: Added to the symbol of a text's first character; PAD fills the last chunk.
FIRST, PAD = 8, 16

# States: at a new piece; in letters, numbers, others; after the space that a piece may begin with;
# in white space; with one or two letters of a contraction to come.
NEW, LETTERS, NUMBERS, OTHERS, SPACED, WHITES, ONE_MORE, TWO_MORE = range(8)


def transition(state: int, symbol: int) -> tuple[int, int]:
    """Next state, and 1 if a piece begins at this character."""
    if symbol == PAD:
        return state, 0
    if symbol >= FIRST:
        return transition(NEW, symbol - FIRST)[0], 1
    if symbol == LETTER and state in (ONE_MORE, TWO_MORE):
        return (NEW if state == ONE_MORE else ONE_MORE), 0
    if symbol in (SHORT, LONG):
        if state in (OTHERS, SPACED):
            return OTHERS, 0
        return (ONE_MORE if symbol == SHORT else TWO_MORE), 1
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}[symbol]
        return run, int(state not in (run, SPACED))
    if symbol == WHITE:
        return WHITES, int(state != WHITES)
    return (SPACED if symbol == SPACE_LAST else NEW), 1


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions by symbol * 8 + state."""
    cells = [transition(s, x) for x in range(PAD + 1) for s in range(8)]
    return np.array([a for a, _ in cells], np.uint8), np.array([b for _, b in cells], np.uint8)


def character_classes(tokenizer) -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for every code point, as the tokenizer parts them."""
    pieces_of = tokenizer.pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, (*range(0x20), *range(0x21, 0xD800), *range(0xE000, 0x110000))))
    out = np.full(0x110000, WHITE, np.uint8)
    for _, (lo, hi) in pieces_of(every):  # each is of one kind
        kind = next((k for k, with_ in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(pieces_of(with_ + every[lo])) == 1), WHITE)
        out[ord(every[lo]) : ord(every[hi - 1]) + 1] = kind
    out[0x20] = WHITE
    return out


def symbols(points: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of the characters of texts that begin at ``starts``."""
    n = len(points)
    sym = classes[points]
    begins = np.zeros(n + 3, bool)
    begins[starts] = True
    after = np.full((2, n), -1, np.int32)  # the two characters that follow in the same text, or -1
    after[0, : n - 1] = np.where(begins[1:n], -1, points[1:])
    after[1, : n - 2] = np.where(begins[1 : n - 1] | begins[2:n], -1, points[2:]) if n > 1 else -1
    white = sym == WHITE
    followed = (after[0] >= 0) & (classes[after[0]] != WHITE)
    sym[white & followed] = WHITE_LAST
    sym[white & followed & (points == 32)] = SPACE_LAST
    quote = np.flatnonzero(points == 39)
    a, b = after[:, quote]
    sym[quote[np.isin(a, list(map(ord, "stmd")))]] = SHORT
    sym[quote[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]] = LONG
    sym[starts] += FIRST
    return sym


def piece_starts(sym: np.ndarray, step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Where pieces begin: state maps of chunks, their prefix scan, and the emissions."""
    n, lanes = len(sym), -(-len(sym) // CHUNK)
    tape = np.full(lanes * CHUNK, PAD, np.uint8)
    tape[:n] = sym
    tape = np.ascontiguousarray(tape.reshape(lanes, CHUNK).T).astype(np.int16) * 8
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, 1)
    for row in tape:
        maps = step[row + maps]
    reach = 1
    while reach < lanes:
        # the map of a chunk after the map of what precedes it
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.int64), 0)
        reach *= 2
    state = np.concatenate([[np.uint8(NEW)], maps[NEW, :-1]])
    flags = np.empty((CHUNK, lanes), np.uint8)
    for k, row in enumerate(tape):
        at = row + state
        flags[k], state = emit[at], step[at]
    return np.flatnonzero(flags.T.ravel()[:n])


class Transducer:
    """The second transducer: counts of the tokens that the merges make of a piece's bytes."""

    NEVER = 1 << 62

    def __init__(self, file: dict):
        model = file["model"]
        byte = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in file["added_tokens"]}
        self.rank, self.left, self.right, self.joins = {}, {}, {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, t = (model["vocab"][x] for x in (a, b, a + b))
            if t in self.rank or max(self.rank.get(a, -1), self.rank.get(b, -1)) >= r:
                raise ValueError("merges that cannot be compiled: a token comes before its parts or twice")
            self.rank[t], self.left[t], self.right[t], self.joins[a, b] = r, a, b, r
        # the tree of tokens by bytes; a token that is no byte and no merge never comes up
        self.child, self.token, self.inner = {}, [-1], [False]
        for name, t in model["vocab"].items():
            if name in special or (len(name) > 1 and t not in self.rank):
                continue
            node = 0
            for c in name:
                key = node << 8 | byte[c]
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = self.child[key]
            self.token[node] = t
        if any(b not in self.child for b in range(256)):
            raise ValueError("merges that cannot be compiled: a byte has no token")
        self.clear()

    def clear(self) -> None:
        self.known: dict[tuple[int, int], bool] = {}
        self.walked: dict[int, tuple[int, int]] = {}
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.numbered((0, -1, 0))
        self.keys, self.next, self.emit = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int16)
        self.filled = 0

    def numbered(self, state: tuple[int, ...]) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state]

    def follows(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay beside each other: no merge across their border comes before those that make them."""
        if (a, b) not in self.known:
            ends, begins = [a], [b]
            while ends[-1] in self.right:
                ends.append(self.right[ends[-1]])
            while begins[-1] in self.left:
                begins.append(self.left[begins[-1]])
            x, y = ends.pop(), begins.pop()
            while True:
                own, other = (self.rank[z[-1]] if z else self.NEVER for z in (ends, begins))
                across = self.joins.get((x, y), self.NEVER)
                if across < own and across <= other:  # of equal merges the leftmost comes first
                    self.known[a, b] = False
                    break
                if not ends and not begins:
                    self.known[a, b] = True
                    break
                if own <= other:
                    x = ends.pop()
                else:
                    y = begins.pop()
        return self.known[a, b]

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """Next state, and the tokens that this byte adds."""
        reached, last, added = [], None, 0
        parts = self.states[state]
        for node, before, count in zip(parts[::3], parts[1::3], parts[2::3], strict=True):
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            t = self.token[node]
            if t >= 0 and last is None and (before < 0 or self.follows(before, t)):
                last, added = t, count + 1
            if self.inner[node]:
                reached.append((node, before, count))
        new = tuple(x for node, before, count in reached for x in (node, before, count - added)) + (0, last, 0)
        return self.numbered(new), added

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) & (len(self.keys) - 1)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where the transitions of (state, byte) keys are in the table, or the empty place for each."""
        at = self.slots(keys)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return at

    def put(self, keys: np.ndarray, next_: np.ndarray, emit: np.ndarray) -> None:
        """Distinct new transitions."""
        self.filled += len(keys)
        if 3 * self.filled > len(self.keys):
            used = self.keys >= 0
            keys, next_, emit = (np.concatenate([old[used], new]) for old, new in ((self.keys, keys), (self.next, next_), (self.emit, emit)))
            size = 4 << max(16, int(self.filled).bit_length())
            self.keys, self.next, self.emit = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        while len(keys):
            at = self.places(keys)
            _, first = np.unique(at, return_index=True)  # keys that want one place: one of them gets it
            self.keys[at[first]], self.next[at[first]], self.emit[at[first]] = keys[first], next_[first], emit[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, next_, emit = keys[left], next_[left], emit[left]

    def run(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added tokens."""
        keys = state.astype(np.int64) << 8 | byte
        at = self.places(keys)
        if len(new := np.unique(keys[self.keys[at] != keys])):
            made = [self.transition(k >> 8, k & 255) for k in new.tolist()]
            self.put(new, np.array([n for n, _ in made], np.int32), np.array([e for _, e in made], np.int16))
            at = self.places(keys)
        return self.next[at], self.emit[at]

    def walk(self, piece: bytes) -> int:
        """Tokens of one long piece."""
        state = total = 0
        for byte in piece:
            got = self.walked.get(state << 8 | byte)
            if got is None:
                if len(self.states) > KEPT_STATES:
                    here = self.states[state]
                    self.clear()
                    state = self.numbered(here)
                got = self.walked[state << 8 | byte] = self.transition(state, byte)
            state, total = got[0], total + got[1]
        return total

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the pieces data[begin : begin + size]."""
        out = np.zeros(len(size), np.int64)
        for i in np.flatnonzero(size > LONG_PIECE).tolist():
            out[i] = self.walk(data[begin[i] : begin[i] + size[i]].tobytes())
        order = np.argsort(-size, kind="stable")
        order = order[size[order] <= LONG_PIECE]
        for lo, hi in slices(size[order].tolist(), TOGETHER_BYTES):
            if len(self.states) > KEPT_STATES:
                self.clear()
            own = order[lo:hi]
            state, at, n, total = np.zeros(hi - lo, np.int32), begin[own], size[own], np.zeros(hi - lo, np.int64)
            left = np.searchsorted(-n, -np.arange(n[0]), "left") if len(n) else []  # pieces with more bytes than k
            for k, m in enumerate(left):
                state[:m], added = self.run(state[:m], data[at[:m] + k])
                total[:m] += added
            out[own] = total
        return out


class Counter:
    """Counts the tokens of texts; one object per process, for its transducers."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        parsed = json.loads(file)
        kind, model, added = parsed["pre_tokenizer"] or {}, parsed["model"], parsed["added_tokens"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if parsed["normalizer"] or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or any(odd):
            raise ValueError("a tokenizer that cannot be compiled: not plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("a tokenizer that cannot be compiled: special tokens that depend on their neighbours")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.classes = character_classes(Tokenizer.from_str(file))
        self.step, self.emit = compiled()
        self.transducer = Transducer(parsed)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts = [[t] if not self.special or not self.special.search(t) else self.special.split(t) for t in texts]
        own = [i for i, x in enumerate(parts) for t in x if t]
        plain = [t for x in parts for t in x if t]
        out += np.fromiter((len(x) - 1 for x in parts), np.int64, len(parts))
        if not plain:
            return out
        joined = "".join(plain)
        data = np.frombuffer(joined.encode(), np.uint8)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int32)
        lengths = np.fromiter(map(len, plain), np.int64, len(plain))
        starts = np.cumsum(lengths) - lengths
        begin = piece_starts(symbols(points, starts, self.classes), self.step, self.emit)
        of_text = np.searchsorted(begin, starts)  # the first piece of each part
        if len(data) != len(points):  # from characters to bytes
            begin = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[begin]
        offsets = np.append(begin, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary
        at = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        tokens = self.transducer.counts(np.frombuffer(distinct.buffers()[2], np.uint8), at[:-1], np.diff(at))
        np.add.at(out, own, np.add.reduceat(tokens[pieces.indices.to_numpy()], of_text))
        return out


#: The counter of this Python process: tasks that follow one another share it.
SHARED: dict[str, Counter] = {}


def shared_counter(file: str) -> Counter:
    if file not in SHARED:
        SHARED.clear()
        SHARED[file] = Counter(file)
    return SHARED[file]


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # one tokenizer: its size is fixed by the file

    def run(batches):
        counter = shared_counter(shipped.value)
        for batch in batches:
            for lo, hi, texts in text_slices(batch):
                n_bytes = [len(t.encode()) for t in texts]
                columns = [batch.column(0)[lo:hi], pa.array(n_bytes, pa.int64()), pa.array(counter(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
