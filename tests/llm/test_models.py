"""Operators 3 and 8: held-out accuracy, code lengths by hand, and edges."""

import math

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from riskloom.llm import language, quality

from .conftest import EDGES, by_id


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality.query(spark, sf).collect() if r.held_out and r.doc_id in label]
    good = [r.predicted for r in got if label[r.doc_id] == 1]
    bad = [r.predicted for r in got if label[r.doc_id] == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2


def test_quality_learns_nothing_from_the_held_out_fold(spark, sf, docs):
    import zlib

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]

    turned = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs, turned)).all()


def test_quality_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (5, None), (None, 1), (8, 0)], "doc_id long, quality int")
    got = quality.classify(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 4)}) == 1
    assert {r.score for r in quality.classify(edges, labels.where("false")).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.keep(edges, labels).columns == edges.columns and quality.keep(edges, labels.where("false")).count() == len(EDGES)


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    examples = [(np.append(rng.integers(10, 5000, 20), [y, 1 << quality.BITS]), np.append(np.full(21, 0.2), 1.0), y) for y in rng.integers(0, 2, 200)]
    w = quality.learn(examples)
    assert all((w[f] @ x > 0) == y for f, x, y in examples)


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language.query(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.99


def by_hand(training: dict[str, list[bytes]], text: bytes) -> dict[str, float]:
    """Code lengths by walking the context trees byte by byte."""
    seen = {b for ts in training.values() for t in ts for b in t}
    out = {}
    for lang, ts in training.items():
        count = {}
        for t in ts:
            s = [-1] * language.ORDER + list(t)
            for i in range(language.ORDER, len(s)):
                for k in range(language.ORDER + 1):
                    count.setdefault(tuple(s[i - k : i]), {}).setdefault(s[i], 0)
                    count[tuple(s[i - k : i])][s[i]] += 1
        s, bits = [-1] * language.ORDER + [b if b in seen else -1 for b in text], 0.0
        for i in range(language.ORDER, len(s)):
            for k in range(language.ORDER, -1, -1):
                c = tuple(s[i - k : i])
                after = count.get(c, {})
                total, kinds = sum(after.values()), len(after)
                if s[i] in after and s[i] != -1:
                    bits += math.log2((total + kinds) / after[s[i]])
                    break
                bits += math.log2((total + kinds) / kinds) if total else 0
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_by_hand(spark):
    training = {"a": [b"the cat sat on the mat", b"the hat"], "b": [b"der hund und die katze", "übel".encode()]}
    rows = [(lang, t.decode()) for lang, ts in training.items() for t in ts]
    found = language.count_grams(spark.createDataFrame(rows, "lang string, text string")).toPandas()
    model = language.Model(["a", "b"], {x: (g["gram"].to_numpy(), g["n"].to_numpy()) for x, g in found.groupby("lang")})
    texts = [b"the cat", b"die hunde", b"", b"zzz \xff", "ü the".encode()]
    for text, bits in zip(texts, model.code_lengths(texts), strict=True):
        assert np.allclose(bits, list(by_hand(training, text).values()), rtol=1e-5)


def test_language_edges(edges, empty, docs):
    got = language.identify(edges, language.train(docs)).collect()
    assert len(got) == len(EDGES)
    assert all((r.lang_pred, r.score) == ("und", 0) for r in got if r.doc_id in (1, 2, 4))
    assert {r.lang_pred for r in language.identify(edges, language.train(empty)).collect()} == {"und"}
    assert language.identify(empty, language.train(docs)).count() == 0


def test_languages_in_groups_score_as_in_one(spark, monkeypatch):
    """300 made-up languages: many groups give what one gives, and every text its own language."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(300):
        words = ["".join(rng.choice(letters, rng.integers(3, 8))) for _ in range(20)]
        rows += [(8 * k + j, f"l{k:03d}", " ".join(rng.choice(words, 30))) for j in range(8)]
    docs = spark.createDataFrame([*rows, (9999, None, "  "), (9998, None, None)], "doc_id long, lang string, text string")

    def told():
        models = language.train(docs)
        return len(models), {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, models).collect()}

    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 30)
    one, whole = told()
    monkeypatch.setattr(language, "MODEL_BYTES", 1 << 26)
    many, parts = told()
    assert one == 1 < many and set(whole) == set(parts)
    assert all(parts[i][0] == x and np.isclose(parts[i][1], p) for i, (x, p) in whole.items())
    assert all(parts[i][0] == lang for i, lang, _ in rows) and parts[9998] == parts[9999] == ("und", 0)


def test_language_bounds(spark, monkeypatch):
    assert language.groups({}) == []
    docs = spark.createDataFrame([(i, f"l{i % 5}", "some text") for i in range(40)], "doc_id long, lang string, text string")
    assert language.sample(docs, size=1).count() < 15 <= language.sample(docs).count()
    monkeypatch.setattr(language, "MOST_LANGS", 3)
    with pytest.raises(ValueError):
        language.train(docs)


def slow_features(text):
    """Features of a text, one word at a time, with Python's own numbers."""
    whole, c = (1 << 64) - 1, 0xD6E8FEB86659FD93
    h = [xxhash.xxh32_intdigest(p.encode()) for w in text.split() for p in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+", w)]
    pairs = [1 if a == b else (a * 0x9E3779B97F4A7C15 + b) & whole for a, b in zip(h, h[1:], strict=False)]
    count = {}
    for key in [*((x * c & whole) >> 64 - quality.BITS for x in h), *(((x + 7 & whole) * c & whole) >> 64 - quality.BITS for x in pairs)]:
        count[key] = count.get(key, 0) + 1
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values()))
    return {k: math.log1p(n) / norm for k, n in count.items()}


def slow_learning(examples):
    z, n, w = {}, {}, {}
    for _ in range(quality.EPOCHS):
        for x, y in examples:
            for k in x:
                small = abs(z.get(k, 0.0)) <= quality.L1
                w[k] = 0.0 if small else (math.copysign(quality.L1, z[k]) - z[k]) / ((quality.BETA + math.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g, old = (p - y) * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[k]
                n[k] = old + g * g
    return w


def test_quality_scores_by_hand(spark, docs, sf):
    some = docs.orderBy("doc_id").limit(90)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = some.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(quality.SHARDS)).alias("shard"), F.xxhash64("text").alias("order"), (quality.fold(F.col("doc_id"), 3) == 1).alias("held")).collect()
    label = {r.doc_id: int(r.q >= 0.5) for r in labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).collect()}
    bias = 1 << quality.BITS
    models = []
    for shard in range(quality.SHARDS):
        own = sorted((r.order, label[r.doc_id], r.text or "") for r in rows if r.shard == shard and not r.held and r.doc_id in label)
        models.append((len(own), slow_learning([({**slow_features(t), bias: 1.0}, y) for _, y, t in own])))
    assert all(n > 5 for n, _ in models)
    total = sum(n for n, _ in models)
    got = by_id(quality.classify(some, labels))
    for r in rows:
        x = {**slow_features(r.text or ""), bias: 1.0}
        logit = sum(v * sum(n * w.get(k, 0.0) for n, w in models) / total for k, v in x.items())
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-logit))) < 1e-4
