"""Operators 5, 6 and 9 against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskloom.llm import bpe, counts, grammar

from .conftest import EDGES, by_id

TRICKY = [
    "", "it's  we'll\n\n x\t\ty 　 zz \x1c\x1d a'S d'RE ''s  '", "日本語 🎉👩‍👩‍👧 é é   \x85 q", "<|endoftext|> abc   ", " " * 50 + "x", "x" * 3000, "٣٤٥ ½ Ⅳ", "'", "'l", " 'll",
    "'lla'ss'dx\n\n\n  a\n b", "x\ny\n", "İΣΑΣ ΑΣ. ÀÉ Å ſ", " ", "a   b", "  c d",
]


@pytest.fixture(scope="module")
def tricky(spark):
    return spark.createDataFrame([*enumerate(TRICKY)], "doc_id long, text string")


@pytest.fixture(scope="module")
def reference():
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    return Tokenizer.from_file(P.path(name))


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_byte_bpe_equals_tiktoken(spark, sf, texts, tricky, reference):
    for df, given in ((tricky, dict(enumerate(TRICKY))), (None, texts)):
        got = by_id(bpe.query(spark, sf) if df is None else bpe.digests(bpe.decode(bpe.encode(df))))
        for i, t in given.items():
            ids = reference.encode_ordinary(t)
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode()))


def test_byte_bpe_offsets_and_split_characters(tricky, reference):
    tokens = bpe.read_ranks(P.path(bpe.RANKS))
    for r in bpe.encode(tricky, offsets=True).collect():
        text, at = TRICKY[r.doc_id], 0
        assert len(r.starts) == len(r.ids)
        for i, start in zip(r.ids, r.starts, strict=True):
            assert len(text[:start].encode()) <= at < len(text[: start + 1].encode())
            at += len(tokens[i])
        out, pending = "", b""
        for i in r.ids:  # one id at a time, characters come whole
            more, pending = bpe.decode_text(tokens, [i], pending)
            out += more
        assert out == text and not pending


def test_byte_bpe_edges(edges, empty):
    got = bpe.digests(bpe.decode(bpe.encode(edges))).collect()
    assert len(got) == len(EDGES) and sum(r.n_tokens == 0 for r in got) == 3
    assert bpe.digests(bpe.decode(bpe.encode(empty))).count() == 0


def test_byte_bpe_gives_the_library_chunks_joined(reference):
    coder = bpe.Coder(bpe.tokenizer_json(bpe.read_ranks(P.path(bpe.RANKS)), P.PATTERN))
    words = [f"{w}{i}" for i in range(700) for w in ("Zürich", "it's", "日本", "🎉", "a\nb", "x\u00a0y", "--'re", "e\u0301")]
    texts = [" ".join(words[k::3]) + end for k in range(3) for end in ("", " ", "\n", "\u00a0", " 's", " \u2028")]
    given = []

    class Counting:
        def encode_batch_fast(self, some, f=coder.tokenizer.encode_batch_fast, **how):
            given.extend(some)
            return f(some, **how)

        def encode_batch(self, some, f=coder.tokenizer.encode_batch, **how):
            given.extend(some)
            return f(some, **how)

    coder.tokenizer = Counting()
    ids, lengths = (lambda *found: (found[0], found[-1]))(*coder.encode(texts))
    wanted = [reference.encode_ordinary(t) for t in texts]
    assert ids.tolist() == sum(wanted, []) and lengths.tolist() == list(map(len, wanted))
    assert len(given) < 100  # 5600 distinct words
    chunks = ["", " ", " a", " a b", "b", " \n", " c\n", " d\u00a0", " e", "f g"]
    assert coder.packed(chunks) == list(coder.whole(chunks))


def test_byte_bpe_chunks_that_an_id_would_join():
    coder = bpe.Coder(bpe.tokenizer_json([*(bytes([b]) for b in range(256)), b"a "], r"[\s\S]+"))
    chunks = [" a", " b", " aa", " a"]
    assert np.frombuffer(next(coder.whole([" a b"])), np.int32).tolist() == [32, 256, 98]
    assert coder.packed(chunks) == list(coder.whole(chunks))


def test_counts_equal_the_library(spark, sf, texts, tricky):
    whole = library(counts.TOKENIZER)
    for df, given in ((tricky, dict(enumerate(TRICKY))), (None, texts)):
        got = by_id(counts.query(spark, sf) if df is None else counts.count(df))
        for i, t in given.items():
            assert (got[i].n_tokens, got[i].n_bytes) == (len(whole.encode(t, add_special_tokens=False).ids), len(t.encode()))


def test_state_maps_compose_as_one_pass_does():
    step, emit = counts.compiled()
    rng = np.random.default_rng(5)
    for n in (1, 511, 512, 513, 5000):
        sym = rng.integers(0, 8, n).astype(np.uint8)
        sym[rng.random(n) < 0.01] += counts.FIRST
        sym[0] |= counts.FIRST
        state, expected = counts.NEW, []
        for k, s in enumerate(sym):
            state, begins = counts.transition(state, int(s))
            expected += [k] * begins
        assert counts.piece_starts(sym, step, emit).tolist() == expected


def counter(name=counts.TOKENIZER):
    with open(P.path(name), encoding="utf-8") as f:
        return counts.Counter(f.read())


def same_counts(own, texts):
    whole = library(counts.TOKENIZER).encode_batch_fast(texts, add_special_tokens=False)
    return [t for t, n, e in zip(texts, own(texts).tolist(), whole, strict=True) if n != len(e.ids)] == []


@pytest.mark.parametrize("form", ["{c}'s", "a{c}1{c} {c}!{c}", " \n{c}"])
def test_counts_of_every_character(form):
    own = counter()
    every = [form.format(c=chr(c)) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert all(same_counts(own, every[lo : lo + 20_000]) for lo in range(0, len(every), 20_000))


def test_counts_of_hostile_texts(monkeypatch):
    twins = "e"
    for _ in range(11):
        twins += twins.translate(str.maketrans("eq", "qe"))
    texts = ["\n\n\x00a", "\x00", " \x00", "a\x00's", "<|endoftext|>", "<|endoftext|><|endoftext|> a  <|endoftext|>b <|endoftext|", "  <|endoftext|>  "]
    texts += [twins, twins.translate(str.maketrans("eq", "qe")), "x" * 5000, "ab" * 4000, " " * 3000, "é" * 3000, "日本" * 2000, "=-" * 2000]
    rng = np.random.default_rng(8)
    texts += [bytes(rng.integers(0, 256, rng.integers(0, 60)).astype(np.uint8)).decode("utf-8", "replace") for _ in range(5000)]
    texts += ["".join(rng.choice([*"aeinorst"], rng.integers(1, 1500))) for _ in range(500)]
    own = counter()
    assert same_counts(own, texts)
    monkeypatch.setattr(counts, "KEPT_STATES", 200)  # states are made anew, also within a piece
    monkeypatch.setattr(counts, "TOGETHER_BYTES", 4000)
    assert same_counts(own, texts) and len(own.transducer.states) < 20_000


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        counter(grammar.TOKENIZER)


def test_counts_edges(edges, empty):
    whole, got = library(counts.TOKENIZER), counts.count(edges).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in EDGES)
    assert counts.count(empty).count() == 0


def test_ids_from_files(spark, sf, texts):
    whole, got, start = library(grammar.TOKENIZER), by_id(grammar.query(spark, sf)), 0
    for i in sorted(texts):
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, grammar.END_ID], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ids_of_tricky_texts_and_small_shards(tricky, monkeypatch):
    monkeypatch.setattr(grammar, "SHARD_IDS", 40)
    whole, got = library(grammar.TOKENIZER), by_id(grammar.read(grammar.write(tricky, parts=3)))
    for i, t in enumerate(TRICKY):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, grammar.END_ID]


@pytest.mark.parametrize("form", ["{c}.", "{c}{c}!", "a{c} b", "a{c}, {c}", "x{c}'s.", "1{c}. {c}a."])
def test_ids_of_every_character(form):
    with open(P.path(grammar.TOKENIZER), encoding="utf-8") as f:
        encode, whole = grammar.encoder(f.read()), library(grammar.TOKENIZER)
    every = [form.format(c=chr(c)) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(every), 20_000):
        texts = every[lo : lo + 20_000]
        ids, n = encode(texts)
        got = np.split(ids, np.cumsum(n)[:-1])
        assert [t for t, g, e in zip(texts, got, whole.encode_batch_fast(texts, add_special_tokens=False), strict=True) if g.tolist() != e.ids] == []


def test_ids_of_mixed_characters():
    with open(P.path(grammar.TOKENIZER), encoding="utf-8") as f:
        encode, whole = grammar.encoder(f.read()), library(grammar.TOKENIZER)
    pool = [*"abcXYZ éÉİΣςß.,;!'_-<|>09½ ٣\t\n\x1c\x85\xa0", "<|endoftext|>", "'s", "'LL", "\u0301", "\u0323", "\u095c", "\u093c", "\u0958", "\u1112", "\u1161", "\u11ab", "日", "🎉", ".,", "...", " . "]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(pool, rng.integers(0, 14))) for _ in range(20_000)]
    ids, n = encode(texts)
    for t, got, e in zip(texts, np.split(ids, np.cumsum(n)[:-1]), whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == e.ids, t


def test_other_tokenizers_get_whole_texts():
    with open(P.path(counts.TOKENIZER), encoding="utf-8") as f:
        encode, whole = grammar.encoder(f.read()), library(counts.TOKENIZER)
    ids, n = encode(TRICKY)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids for t in TRICKY]


def test_grammar_goes_on_until_no_pair_is_frequent():
    passage = np.random.default_rng(1).integers(0, 49_408, 300)
    ids = np.concatenate([np.tile(passage, 40), np.zeros(5000, np.int64)])
    shard = grammar.Shard(grammar.compress(ids, 49_408))
    assert shard.read(0, len(ids)).tolist() == ids.tolist()
    assert len(shard.symbols) < 120 and shard.length.max() > 500
    used = np.bincount(shard.symbols, minlength=len(shard.length))
    pairs = np.stack([shard.symbols[:-1], shard.symbols[1:]], 1)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < grammar.LEAST and used.sum() == len(shard.symbols)


def test_grammar_beyond_sixteen_bits():
    rng = np.random.default_rng(2)
    ids = rng.integers(65_000, 200_000, 500).repeat(3)
    ids = np.tile(ids, 30)
    shard = grammar.Shard(grammar.compress(ids, 200_000))
    assert shard.read(0, len(ids)).tolist() == ids.tolist() and shard.symbols.itemsize == 4
    many = np.tile(rng.permutation(60_000), 17)  # more rules than 16 bits have room for
    shard = grammar.Shard(grammar.compress(many, 60_000))
    assert shard.read(17, 70_000).tolist() == many[17:70_000].tolist() and shard.symbols.itemsize == 4
    with pytest.raises(ValueError):
        grammar.compress(np.array([70_000]), 65_536)


@pytest.mark.parametrize("kinds, n", [(2, 0), (1, 5000), (3, 7777), (400, 50_000), (49_000, 3000)])
def test_grammar_reads_any_range(kinds, n):
    ids = np.random.default_rng(kinds).integers(0, kinds, n)
    shard = grammar.Shard(grammar.compress(ids, 49_408))
    for lo, hi in ((0, n), (n // 3, n // 2), (max(0, n - 1), n), (0, min(1, n)), (n // 2, n // 2), (min(1023, n), min(2049, n))):
        assert shard.read(lo, hi).tolist() == ids[lo:hi].tolist()
    if kinds <= 3 and n:
        assert len(shard.symbols) < n / 3


def test_ids_edges(edges, empty):
    got, whole = grammar.read(grammar.write(edges)).collect(), library(grammar.TOKENIZER)
    given = [[*whole.encode(t or "", add_special_tokens=False).ids, grammar.END_ID] for _, t in EDGES]
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in got) == sorted(given)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in in_order] == sorted((i for i, _ in EDGES), key=lambda i: -1 if i is None else i)
    assert [r.start for r in in_order] == np.cumsum([0, *(r.n_tokens for r in in_order)])[:-1].tolist()
    assert grammar.read(grammar.write(empty)).count() == 0
