"""Operator 5: token ids in binary form, compressed by Re-Pair grammars.

Documents are put in order of doc_id, encoded, and cut into shards of about
``SHARD_IDS`` ids. In each shard, rounds of Re-Pair replace the frequent pairs of
neighbours by new symbols until no pair is frequent. A shard's file holds the rules,
the length that each rule expands to, the remaining sequence, and how many ids come
before every ``SAMPLE``-th symbol of it, so that any range of ids is decoded from its
own symbols alone. Files are rows of a Parquet table: Spark writes and reads them.

File format, little-endian: magic ``RPG2``, then uint32 counts (vocabulary, rules,
symbols, samples) and the bytes of a symbol (2, or 4 where 2 do not suffice), rules
(left, right: a symbol each), lengths (uint32), samples (uint32), symbols.

Defined results: a null text counts as empty; an empty text has the end id alone;
documents are ordered by doc_id (null first), equal ones by a hash of the text, then
the text; repeated rows are written as often; an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import json
import os
import re
import string
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Memory
from .common import stash, table, text_slices

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SHARD_IDS = 1 << 20
SAMPLE = 1024

#: Characters that a task encodes at once: distinct words are looked up once in each.
TOGETHER_CHARS = 1 << 24

#: Words whose ids are laid out at once, and distinct words in each of the two generations of a process's memory.
GATHERED = 1 << 18
KEPT_WORDS = 400_000

#: Times that a round looks for occurrences that still can be replaced; later rounds take the rest.
SWEEPS = 3

#: A pair is frequent if a shard replaces it this often.
LEAST = 8

ODD = np.uint64(0x9E3779B97F4A7C15)


def frequent_pairs(pair: np.ndarray) -> np.ndarray:
    """Sorted pairs that occur LEAST times or more."""
    ordered = np.sort(pair)
    if len(ordered) < LEAST:
        return ordered[:0]
    often = ordered[LEAST - 1 :][ordered[LEAST - 1 :] == ordered[: len(ordered) - LEAST + 1]]
    return often[np.concatenate([[True], often[1:] != often[:-1]])] if len(often) else often


def occurrences(pair: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the chosen (sorted) pairs, and which each is."""
    slot_of = lambda x: (x * ODD >> np.uint64(44)).astype(np.int64)
    own, every = slot_of(chosen), np.arange(len(chosen), dtype=np.int32)
    in_slot = np.full(1 << 20, -1, np.int32)
    in_slot[own] = every
    in_slot[own[in_slot[own] != every]] = -2  # pairs that share a slot are searched for
    which = in_slot[slot_of(pair)]
    at = np.flatnonzero(which != -1)
    which = which[at]
    shared = np.flatnonzero(which == -2)
    which[shared] = np.minimum(np.searchsorted(chosen, pair[at[shared]]), len(chosen) - 1)
    hit = chosen[which] == pair[at]
    return at[hit], which[hit]


def without_overlaps(at: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Which of the occurrences are replaced: where two share a symbol, that of the more frequent pair.

    So a passage is cut alike wherever it stands. In a run of one symbol it is every second one from its start.
    """
    order = np.empty(n, np.int32)
    order[np.argsort(np.bincount(which, minlength=n), kind="stable")] = np.arange(n)
    left = np.ones(len(at), bool)
    again = np.flatnonzero((at[1:] == at[:-1] + 1) & (which[1:] == which[:-1])) + 1  # later places of runs
    if len(again):
        first = np.flatnonzero(np.concatenate([[True], np.diff(again) > 1]))
        nth = np.arange(len(again)) - np.repeat(first, np.diff(np.append(first, len(again))))
        left[again[nth & 1 == 0]] = False
    left = np.flatnonzero(left)
    kept = np.zeros(len(at), bool)
    for _ in range(SWEEPS):
        a, rank = at[left], order[which[left]]
        meets = a[1:] == a[:-1] + 1
        lower = meets & (rank[1:] > rank[:-1]), meets & (rank[1:] < rank[:-1])
        best = ~(np.append(lower[0], False) | np.append(False, lower[1]))
        kept[left[best]] = True
        beside = np.append(meets & best[1:], False) | np.append(False, meets & best[:-1])
        left = left[~best & ~beside]
        if not len(left):
            break
    return kept


def compress(ids: np.ndarray, vocabulary: int) -> bytes:
    """The file of one shard. Symbols from ``vocabulary`` on are rules."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocabulary:
        raise ValueError(f"ids outside the vocabulary of {vocabulary}")
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    seq, rules = ids.astype(np.uint32), np.zeros((0, 2), np.int64)
    maybe = None  # places of all pairs that can be frequent; at first, any
    while True:
        left, right = (seq[:-1], seq[1:]) if maybe is None else (seq[maybe], seq[maybe + 1])
        pair = left.astype(np.uint64) << half | right
        chosen = frequent_pairs(pair)
        if not len(chosen):
            break
        at, which = occurrences(pair, chosen)
        at = at if maybe is None else maybe[at]
        kept = without_overlaps(at, which, len(chosen))
        used = np.bincount(which[kept], minlength=len(chosen)) >= LEAST  # overlaps may leave too few
        if not used.any():
            break
        kept &= used[which]
        rest, new = at[~kept], vocabulary + len(rules)
        at, rule = at[kept], (np.cumsum(used) - 1)[which[kept]]
        seq[at] = new + rule
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        rest = rest[stays[rest] & stays[rest + 1]]
        rest, fresh = rest - np.searchsorted(at, rest), at - np.arange(len(at))  # each replacement takes one place
        seq, chosen = seq[stays], chosen[used]
        rules = np.concatenate([rules, np.stack([chosen >> half, chosen & low], 1).astype(np.int64)])
        # other pairs were not frequent, and only lose: what is left of the chosen ones, and pairs with a new symbol
        open_ = np.zeros(len(seq) + 1, bool)
        open_[rest] = open_[fresh] = open_[fresh - 1] = True
        maybe = np.flatnonzero(open_[: max(0, len(seq) - 1)]).astype(np.int32)
    grown = [1] * vocabulary
    for left, right in rules.tolist():
        grown.append(grown[left] + grown[right])
    length = np.array(grown, np.int64)
    before = np.concatenate([[0], np.cumsum(length[seq])])[:-1][::SAMPLE]
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    counts = np.array([vocabulary, len(rules), len(seq), len(before), width], "<u4")
    parts = (counts, rules.astype(f"<u{width}"), length[vocabulary:].astype("<u4"), before.astype("<u4"), seq.astype(f"<u{width}"))
    return b"RPG2" + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reads ranges of ids from the file of a shard."""

    def __init__(self, file: bytes):
        if file[:4] != b"RPG2":
            raise ValueError("not a shard of token ids")
        self.vocabulary, n_rules, n_symbols, n_samples, width = (int(x) for x in np.frombuffer(file, "<u4", 5, 4))
        cuts = list(accumulate((24, 2 * width * n_rules, 4 * n_rules, 4 * n_samples)))
        rules = np.frombuffer(file, f"<u{width}", 2 * n_rules, cuts[0]).reshape(-1, 2).tolist()
        self.length = np.concatenate([np.ones(self.vocabulary, np.int64), np.frombuffer(file, "<u4", n_rules, cuts[1])])
        self.samples = np.frombuffer(file, "<u4", n_samples, cuts[2])
        self.symbols = np.frombuffer(file, f"<u{width}", n_symbols, cuts[3])
        grown: list[tuple] = []
        whole = lambda x: (x,) if x < self.vocabulary else grown[x - self.vocabulary]
        for left, right in rules:
            grown.append(whole(left) + whole(right))
        self.ids = np.concatenate([np.arange(self.vocabulary), np.fromiter(chain.from_iterable(grown), np.int64)])
        self.begin = np.cumsum(self.length) - self.length

    def read(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi of the shard, decoded from the symbols between two samples."""
        if hi <= lo:
            return np.zeros(0, "<u4")
        a = max(0, int(np.searchsorted(self.samples, lo, "right")) - 1)
        b = int(np.searchsorted(self.samples, hi, "left"))
        s = self.symbols[a * SAMPLE : b * SAMPLE]
        n = self.length[s]
        ends = np.cumsum(n)
        out = self.ids[np.repeat(self.begin[s] - ends + n, n) + np.arange(ends[-1])]
        return out[lo - int(self.samples[a]) : hi - int(self.samples[a])].astype("<u4")


#: Signs that a word may end with, as one piece of their own. An apostrophe may begin a contraction.
SIGNS = string.punctuation.replace("'", "")

#: Words that go to the tokenizer as one text.
TOGETHER = 50

#: What a tokenizer's file must say for its texts to be looked up word by word.
WORDWISE = (
    [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)],
    [("Split", {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "Removed", True), ("ByteLevel", None, None, None)],
)


def wordwise(file: dict) -> bool:
    """Whether the tokenizer drops white space and knows no token that has or takes any."""
    steps = lambda part, inner, *keys: [tuple(x.get(k) for k in keys) for x in ((file.get(part) or {}).get(inner) or [])]
    found = steps("normalizer", "normalizers", "type", "pattern", "content"), steps("pre_tokenizer", "pretokenizers", "type", "pattern", "behavior", "invert")
    plain = not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in file["added_tokens"])
    return found == WORDWISE and plain and file["model"].get("end_of_word_suffix") == "</w>" and not file.get("post_processor")


#: Small letters of Latin-1.
latin = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+").fullmatch


def encoder(file: str):
    """texts -> ids of them all, and how many each has. Where the tokenizer drops white space, words are looked up one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's own core is enough
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    vocabulary = tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
    closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def single(chunks):
        for lo in range(0, len(chunks), 5000):
            for e in tokenizer.encode_batch_fast(chunks[lo : lo + 5000], add_special_tokens=False):
                yield array("i", e.ids).tobytes()

    # for small Latin letters, which normalising leaves as they are and which are one piece
    bare = json.loads(file) | {"normalizer": None, "added_tokens": []}
    if by_words := wordwise(bare | {k: json.loads(file)[k] for k in ("normalizer", "added_tokens")}):
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bare["pre_tokenizer"]["pretokenizers"][1]]}
    simple = Tokenizer.from_str(json.dumps(bare))

    def in_groups(model, words, n):
        """Packed ids of words, ``n`` of them in one text, cut where ids end a word."""
        groups = [words[k : k + n] for k in range(0, len(words), n)]
        for own, e in zip(groups, model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            cuts = [0, *((np.flatnonzero(closes[ids]) + 1) * 4).tolist()]
            whole = ids.tobytes()
            if len(cuts) == len(own) + 1:
                yield from (whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            else:  # some word is several to the tokenizer
                yield from single(own)

    parted: dict[str, bool] = {}

    def parts_from_signs(letter: str) -> bool:
        """Whether the tokenizer, after its own normalising, ends a piece between this letter and a sign."""
        if letter not in parted:
            found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(letter + "."))
            parted[letter] = len(found) == 2 and found[1][0] == "."
        return parted[letter]

    def cut(word: str) -> tuple[str | None, str]:
        """Letters, and the signs that follow them as a piece of their own; None and anything else as it stands."""
        if word.isalpha():
            return word, ""
        base = word.rstrip(SIGNS)
        return (base, word[len(base) :]) if base.isalpha() and parts_from_signs(base[-1]) else (None, word)

    def packed(chunks):
        small = list(filter(latin, chunks))
        known = dict(zip(small, in_groups(simple, small, 8 * TOGETHER), strict=True))
        others = [c for c in chunks if c not in known]
        parts = list(map(cut, others))
        bases = {b for b, _ in parts if b is not None}.difference(known)
        known.update((b, got) for b in bases if (got := memory.young.get(b)))
        new = list(bases.difference(known))
        known.update(zip(new, in_groups(tokenizer, new, TOGETHER), strict=True))
        rest = list({t for _, t in parts if t})
        tails = dict(zip(rest, single(rest), strict=True))
        made = {c: (known[b] if b is not None else b"") + (tails[t] if t else b"") for c, (b, t) in zip(others, parts, strict=True)}
        return [known[c] if c not in made else made[c] for c in chunks]

    memory = Memory(packed, KEPT_WORDS)

    # a point or comma next to another sign: the two are one piece to the tokenizer
    adjoining = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))").search
    separator = re.compile("[\x1c-\x1f]").search  # white space to Python, signs to the tokenizer

    def plain(text: str) -> str:
        """The text with the same ids, but with fewer distinct words."""
        # Latin-1 has no characters that composing or context could change
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if separator(text):
            return text
        if not adjoining(text):  # so points and commas may stand by themselves
            text = text.replace(".", " . ").replace(",", " , ")
        return text.lower() if "<|" not in text else text

    def by_word(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(list(map(plain, texts)), pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary)
        pieces = memory.each(pc.binary_join(distinct, "\n")[0].as_py().split("\n") if len(coded.dictionary) else [])  # no word has a line's end
        flat, size = np.frombuffer(b"".join(pieces), np.int32), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        begin, k = (np.cumsum(size) - size).astype(np.int32), coded.indices.to_numpy()
        size = size.astype(np.int32)
        ends = np.cumsum(size[k], dtype=np.int32)
        ids = np.empty(ends[-1] if len(ends) else 0, np.int32)
        at = 0
        for lo in range(0, len(k), GATHERED):
            own = k[lo : lo + GATHERED]
            n, stop = size[own], ends[lo : lo + GATHERED]
            ids[at : stop[-1]] = flat[np.repeat(begin[own] - stop + n, n) + np.arange(at, stop[-1], dtype=np.int32)]
            at = stop[-1]
        return ids, np.diff(np.concatenate([[0], ends])[words.offsets.to_numpy()])

    def by_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(single(texts))
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    return by_word if by_words else by_text


#: The encoder of this Python process, with the words that it knows: tasks that follow one another share it.
SHARED: dict[str, object] = {}


def shared_encoder(file: str):
    if file not in SHARED:
        SHARED.clear()
        SHARED[file] = encoder(file)
    return SHARED[file]


def together(batches, budget: int):
    """doc_ids and texts of rows of several batches, of about ``budget`` bytes."""
    own, texts, total = [], [], 0
    for batch in batches:
        for lo, hi, some in text_slices(batch, 1, budget):
            own += batch.column(0)[lo:hi].to_pylist()
            texts += some
            total += sum(map(len, some))
            if total >= budget:
                yield own, texts
                own, texts, total = [], [], 0
    if own:
        yield own, texts


def write(docs: DataFrame, path: str | None = None, parts: int | None = None) -> DataFrame:
    """The table of shards: part, shard, first (ids before it in its part), n_ids, doc_ids, lengths, file.

    Without ``parts``, Spark sizes the ranges of doc_id by their bytes. A doc_id of many rows may span several.
    """
    spark = docs.sparkSession
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        file = f.read()
    size = max(json.loads(file)["model"]["vocab"].values(), default=0)
    vocabulary = max(size, END_ID, *(t["id"] for t in json.loads(file)["added_tokens"]), 0) + 1
    shipped = spark.sparkContext.broadcast(file)  # one tokenizer: its size is fixed by the file
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(*([parts] if parts else []), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")

    def run(batches):
        from pyspark import TaskContext

        encode, part = shared_encoder(shipped.value), TaskContext.get().partitionId()
        end = np.array([END_ID], np.int32)
        shard = first = size = 0
        doc_ids: list = []
        kept: list[np.ndarray] = []
        lengths: list[int] = []

        def done():
            ids = np.concatenate(kept)
            row = {"part": [part], "shard": [shard], "first": [first], "n_ids": [len(ids)], "doc_ids": [doc_ids], "lengths": [lengths], "file": [compress(ids, vocabulary)]}
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for own, texts in together(batches, TOGETHER_CHARS):
            ids, counts = encode(texts)
            at = 0
            for doc_id, n in zip(own, counts.tolist(), strict=True):
                doc_ids.append(doc_id)
                lengths.append(n + 1)
                kept += [ids[at : at + n], end]
                at += n
                size += n + 1
                if size >= SHARD_IDS:
                    yield done()
                    shard, first, size, doc_ids, kept, lengths = shard + 1, first + size, 0, [], [], []
        if kept:
            yield done()

    arrow = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("file", pa.binary())])
    return stash(rows.mapInArrow(run, "part int, shard int, first long, n_ids long, doc_ids array<long>, lengths array<int>, file binary"))


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (32-bit, little-endian, packed) of every document, from the files."""
    totals = dict(shards.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each part
    before = dict(zip(sorted(totals), accumulate((totals[p] for p in sorted(totals)), initial=0), strict=False))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, doc_ids, lengths, file = (batch.column(k)[i].as_py() for k in range(5))
                shard, cuts = Shard(file), list(accumulate(lengths, initial=0))
                # about a thousand documents at a time, each run from its own samples
                for lo in range(0, len(doc_ids), 1000):
                    hi = min(lo + 1000, len(doc_ids))
                    ids, b = shard.read(cuts[lo], cuts[hi]), cuts[lo]
                    starts = [before[part] + first + c for c in cuts[lo:hi]]
                    packed = [ids[cuts[k] - b : cuts[k + 1] - b].tobytes() for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths[lo:hi], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    columns = shards.select("part", "first", "doc_ids", "lengths", "file")
    return columns.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
