"""The five stages one by one, each against brute force on its own input."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from riskloom.llm import quality, secrets
from riskloom.llm.common import stash

from .test_shingles import brute_first

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        out.append((name, docs, stash(stage(spark, docs, SF))))
        docs = out[-1][2]
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == list(steps) and len(steps) == 5
    assert all(after.columns == COLUMNS for name, (_, after) in steps.items() if name != "token_ids")


def test_quality_stage(spark, steps):
    before, after = steps["quality"]
    scored = quality.classify(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(after)) == {r.doc_id for r in scored if r.predicted}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good.intersection(rows(after))) > 0.99 * len(good.intersection(rows(before)))


def test_copies_stage(steps):
    before, after = map(rows, steps["near_copies"])
    assert set(after) == brute_first(before)[0]


def test_leaks_stage(spark, steps):
    before, after = map(rows, steps["benchmark_leaks"])
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [grams(tokens(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in before.items() if not any(len(g & x) >= 0.8 * len(x) for g in [grams(tokens(t))] for x in items)}
    assert set(after) == clean and len(clean) < len(before)


def test_secrets_stage(steps):
    before, after = steps["secrets"]
    texts = rows(before)
    for r in after.collect():
        spans = sorted((m.start(), m.end()) for k in secrets.RULES for m in re.finditer(k.pattern, texts[r.doc_id]) if len(m[k.group]) >= k.least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += texts[r.doc_id][at:a] + "[secret]"
            at = max(at, b)
        assert r.text == out + texts[r.doc_id][at:] and r.n_chars == len(r.text)


def test_token_stage(steps):
    before, after = steps["token_ids"]
    texts = rows(before)
    got = after.collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_applies_all_stages(spark, steps):
    names = ["doc_id", "ids_sha256", "decoded_sha256"]
    key = lambda df: sorted(tuple(r) for r in df.select(names).collect())
    assert key(pipeline.run(spark, SF)) == key(steps["token_ids"][1])


def test_stages_on_edges(spark, edges):
    odd = edges.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    for docs in (odd, odd.where("false")):
        n = docs.count()
        for _, stage in pipeline.STAGES:
            docs = stash(stage(spark, docs, SF))
            n, before = docs.count(), n
            assert n <= before
    assert n == 0
