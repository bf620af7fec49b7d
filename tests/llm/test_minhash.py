"""Operator 12 against exact Jaccard similarities of all pairs."""

import random
import re

import numpy as np
import pytest

from riskloom.llm import minhash, simhash

from .conftest import EDGES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in SPACE.split(low) if x]
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute(rows, over=85, under=100):
    """Of every row: n_shingles, component_id and kept."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = sorted((i for i in range(len(rows)) if sets[i]), key=lambda i: len(sets[i]))
    for a, i in enumerate(by):
        for j in by[a + 1 :]:
            if under * len(sets[i]) < over * len(sets[j]):
                break
            if find(i) != find(j) and under * len(sets[i] & sets[j]) >= over * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    comp = [least.get(find(i)) if sets[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s), c, c is None or d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def written(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_near_duplicates_of_the_corpus(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(minhash.query(spark, sf)) == brute(rows)


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**9)}"
    return " ".join(words)


def made():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.choice([12, 60, 200, 400]))]
        texts += [edited(rng, base, n) for n in (0, 0, 1, 2, 3, 4, 6) if n < len(base)]
        texts.append(" ".join([*base[:20], *passage, *base[20:]]))
        texts.append(" ".join(passage) + " " + word())
    group = [word() for _ in range(250)]
    texts += [edited(rng, group, rng.randrange(6)) for _ in range(70)]  # some are near each other and not near the first
    texts += ["a b c", "A  b\tC", "a b d", "", " ", "É un deux trois quatre cinq", "é un deux trois quatre cinq"]
    return [*enumerate(texts), (None, texts[0]), (0, texts[0]), (3, texts[60]), (None, "seen nowhere else"), (None, None)]


@pytest.mark.parametrize("block, salts", [(9000, 1), (1 << 30, 64)])
def test_made_texts_and_blocks(spark, tmp_path, monkeypatch, block, salts):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    monkeypatch.setattr(minhash, "SALTS", salts)
    rows = made()
    expected = brute(rows)
    assert got(minhash.query(spark, written(spark, rows, tmp_path))) == expected
    assert len({r[2] for r in expected}) < len(expected) - 60


def test_members_apart_from_their_leader_are_linked(spark, monkeypatch):
    """One bucket for all, whatever it holds: only comparisons within groups find the links."""
    monkeypatch.setattr(minhash, "band_keys", lambda low, bands: np.ones((len(low), bands), np.uint64))
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 5000)
    rows = [(i, t) for i, t in made() if i is not None]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n, r.component_id) for r in found.collect()) == sorted((d, n, c) for d, n, c, _ in brute(rows))


def test_chance_of_a_miss():
    for alike in (minhash.NEAR, minhash.Likeness(4, 5)):
        t = alike.over / alike.under
        assert (1 - t**minhash.ROWS) ** alike.bands <= minhash.MISS and alike.least_equal < t * alike.bands * minhash.ROWS
    rng = np.random.default_rng(1)
    core = rng.integers(0, 1 << 63, 850, np.uint64) * np.uint64(2)
    a, b = (np.unique(np.concatenate([core, rng.integers(0, 1 << 63, 75, np.uint64)])) for _ in range(2))
    sig = minhash.minima([a, b], 4000)
    assert abs((sig[0] == sig[1]).mean() - 0.85) < 0.03
    k = minhash.band_keys(minhash.minima([a, b, a], 264), 44)
    assert (k[0] == k[2]).all() and len(np.unique(k[0])) == 44 and (k[0] == k[1]).any()


def test_edges(spark, edges, empty, tmp_path):
    assert sorted(((r.doc_id, r.n, r.component_id) for r in minhash.near_duplicates(edges).collect()), key=repr) == sorted(((d, n, c) for d, n, c, _ in brute(EDGES)), key=repr)
    assert minhash.near_duplicates(empty).collect() == []
    assert got(minhash.query(spark, written(spark, EDGES, tmp_path))) == brute(EDGES)


@pytest.mark.parametrize("links, writes", [([(3, 1), (2, 1), (9, 7)], 1), ([], 1), ([(i + 1, i) for i in range(40)], 12), ([(5, 1), (5, 2), (6, 2), (6, 3), (9, 8), (9, 4)], 5)])
def test_components_stop_at_stars(spark, monkeypatch, links, writes):
    """Stars cost one write and one look, not rounds that change nothing."""
    made = []
    monkeypatch.setattr(simhash, "stash", lambda df, f=simhash.stash: made.append(df) or f(df))
    root = {x: x for link in links for x in link}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    got = simhash.components(spark.createDataFrame(links, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((u, v) for u, v in root.items() if u != v)
    assert len(made) <= writes


def test_stages_of_a_group(spark):
    """A group whose members are parted from their leader: parts are joined by their roots, in few stages."""
    spark.sparkContext.setJobGroup("stages of a group", "")
    try:
        rows = [(i, t) for i, t in made() if i is not None]
        assert minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == len(rows)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("stages of a group") for s in tracker.getJobInfo(j).stageIds}
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(stages) < 150


def test_signatures_of_bits():
    rng = np.random.default_rng(2)
    core = rng.integers(0, 1 << 63, 850, np.uint64) * np.uint64(2)
    a, b = (np.unique(np.concatenate([core, rng.integers(0, 1 << 63, 75, np.uint64)])) for _ in range(2))
    sig = minhash.signatures(minhash.minima([a, b, a, a[:1], b[-1:]], 4000))
    equal = lambda i, j: 4000 - int(np.bitwise_count((sig[i] ^ sig[j]).view(np.uint64)).sum())
    assert equal(0, 2) == 4000 and abs(equal(0, 1) / 4000 - 0.925) < 0.03 and abs(equal(3, 4) / 4000 - 0.5) < 0.05
    assert sig.shape == (5, 63) and minhash.NEAR.minima / 2 < minhash.NEAR.least_bits < 0.925 * minhash.NEAR.minima


def test_texts_too_many_to_look_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 10)
    rows = [(i, t) for i, t in made() if i is not None]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n, r.component_id) for r in found.collect()) == sorted((d, n, c) for d, n, c, _ in brute(rows))
