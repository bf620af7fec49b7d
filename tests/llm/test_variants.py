"""Operator 13 against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskloom.llm import variants

from .conftest import EDGES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs):
    seen = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(docs):
    n = brute_words(docs)
    near = {w: [] for w in n}
    by = {}
    for w in n:  # near words share the text without one code point, or one is the other's
        for k in range(len(w)):
            by.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        by.setdefault(w, set()).add(w)
    for group in by.values():
        for a in group:
            near[a] += [b for b in group if one_edit(a, b)]
    form = {}
    for w, others in near.items():
        best = min(set(others), key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(set(near[w])), n.get(form[w]))
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_the_corpus(spark, sf, texts):
    assert found(variants.query(spark, sf)) == brute(texts.items())


@pytest.mark.parametrize("rare", [0, 3, 10**6])
def test_variants_of_made_words(spark, monkeypatch, rare):
    monkeypatch.setattr(variants, "RARE", rare)
    rng = random.Random(rare)
    letters = "abÀÿé"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(40)] + ["aaaaaa", "aaaaaaa", "ababab", "bababa", "babababa"]
    docs = []
    for k in range(400):
        w = rng.choice(base[: 1 + k % len(base)])
        at, c = rng.randrange(len(w)), rng.choice(letters)
        w = [w, w, w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w + c][rng.randrange(6)]
        docs.append((k, "1 ".join([w.upper() if w.isascii() else w] * rng.choice([1, 5, 30]))))
    expected = brute(docs)
    assert found(variants.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))) == expected
    assert sum(x[0] is not None for x in expected.values()) > 10


@pytest.mark.parametrize("rare", [set(), {"ab", "ba"}, {"aa", "ab", "ba", "bb"}])
def test_near_words_share_a_key(rare):
    rng = random.Random(len(rare))
    cover = lambda w: {(w[:e], w[s:], n) for e, s, n in variants.places(w, rare)}
    for _ in range(3000):
        w = "".join(rng.choice("ab") for _ in range(rng.randint(6, 14)))
        at, c = rng.randrange(len(w) + 1), rng.choice("abc")
        other = rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :]])
        if one_edit(w, other) and len(other) >= 6:
            assert cover(w) & cover(other)
        assert all(e or s < len(w) for e, s, _ in variants.places(w, rare))


def test_variants_on_edges(spark, edges, empty, monkeypatch):
    assert found(variants.variants(edges)) == brute(EDGES)
    assert variants.variants(empty).collect() == []
    monkeypatch.setattr(variants, "PART_BYTES", 50)
    monkeypatch.setattr(variants, "HELD_WORDS", 7)
    assert found(variants.variants(edges)) == brute(EDGES)


def test_chains_ties_and_long_words(spark):
    long = "q" * 3000
    text = lambda w, n: (None, " ".join([w] * n))
    docs = [text("colour", 625), text("colours", 125), text("coloursx", 25), text("coloursxy", 5), text("banana", 50), text("banane", 50), text("bananà", 5), text(long, 40), text(long + "z", 5), text("zzzzzz", 4)]
    got = found(variants.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)
    assert got["coloursxy"][1] == "colour" and got["bananà"][0] == "banana" and got[long + "z"][0] == long
