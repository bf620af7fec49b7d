"""Near copies by Jaccard similarity, against brute force over all pairs."""

import random

import numpy as np
import pytest

from riskloom.llm import minhash, simhash

from .test_duplicates import slow_components, slow_simhash


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").lower().encode().split()
        k = min(5, len(w))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    return out


def brute_first(texts):
    """doc_ids that stay: the smallest of every component of links by similarity or by SimHash."""
    sets, ids = brute_sets(texts), sorted(texts)
    first = slow_components({i: slow_simhash(t or "", 5) for i, t in texts.items()})
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while True:
        moved = False
        for a, b in [*pairs, *first.items()]:
            least = min(first[a], first[b])
            moved = moved or first[a] != least or first[b] != least
            first[a] = first[b] = least
        if not moved:
            return {i for i in ids if first[i] == i}, pairs


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def made():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([40, 150, 300]))]
        texts += [edited(rng, base, n) for n in (0, 1, 2, 3, 4, 6, 9)]
        texts.append(" ".join([*base[:20], *passage, *base[20:]]))
    group = [word() for _ in range(160)]
    texts += [edited(rng, group, rng.randrange(5)) for _ in range(60)]
    texts += ["a b c", "A  b\tC", "a b d", "", "É un deux trois quatre cinq", "é un deux trois quatre cinq"]
    return dict(enumerate(texts))


def test_all_pairs_to_0_8(spark):
    texts = made()
    expected, pairs = brute_first(texts)
    prints = {i: slow_simhash(t, 5) for i, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in pairs) > 20
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == expected


@pytest.mark.parametrize("block, salts", [(3000, 2), (1 << 20, 64)])
def test_groups_and_their_blocks(spark, monkeypatch, block, salts):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    monkeypatch.setattr(minhash, "SALTS", salts)
    texts = made()
    docs = spark.createDataFrame([*texts.items(), (None, texts[0]), (0, texts[0])], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} - {None} == brute_first(texts)[0]


def test_pairs_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == brute_first(texts)[0]


def test_groups_link_like_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 50, np.uint64))
    sets = [np.unique(np.concatenate([base[rng.permutation(len(base))[: rng.integers(30, 50)]], rng.integers(0, 1 << 60, rng.integers(0, 6), np.uint64)])) for _ in range(60)]
    of = list(range(60))
    for a, b in [(a, b) for a in range(60) for b in range(a) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))]:
        of = [of[a] if x == of[b] else x for x in of]
    got = list(range(60))
    for a, b in minhash.spanning(sets, list(range(60)), minhash.Likeness(4, 5)):
        got = [got[a] if x == got[b] else x for x in got]
    assert [[x == y for y in of] for x in of] == [[x == y for y in got] for x in got] and len(set(of)) > 1
