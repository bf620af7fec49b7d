"""Normal form C against Python's, for jamo and for marks of class 0."""

import random
import unicodedata

from pyspark.sql import functions as F

from riskloom.llm import fingerprint

LETTERS = "aeou ;\nA\u00e9\u1ea1\u0915\u0b95\u1100\u1112\u1161\u1175\u11a7\u11a8\u11c2\u11c3\uac00\uac01\ud7a3"
MARKS = "\u0301\u0323\u0308\u0488\u093c\u0bc6\u0bbe\u0bca\u20dd\u0327"


def composed(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", fingerprint.composed(F.col("t")).alias("c"))
    return [r.c for r in sorted(rows.collect())]


def test_jamo_and_class_0(spark):
    korean = "\ud55c\uad6d\uc5b4 \ubb38\uc11c, \uac12 abc\n\ub05d"
    given = [unicodedata.normalize("NFD", korean), "\u1100\u1161\u11a8\u11a8 \uac00\u11a8 \uac01\u11a8 \u1161 \u1100 \u11a8", "a\u0301\u0323\u0488", "a\u0488\u0301\u0323", "\u0b95\u0bc6\u0bbe", "\u0301\u0323a"]
    assert composed(spark, given) == [unicodedata.normalize("NFC", t) for t in given]
    rng = random.Random(5)
    given = ["".join(rng.choice(LETTERS if rng.random() < 0.6 else MARKS) for _ in range(12)) for _ in range(400)]
    assert composed(spark, given) == [unicodedata.normalize("NFC", t) for t in given]


def test_equal_texts_have_one_fingerprint(spark):
    pairs = ["\ud55c\uad6d\uc5b4 \ubb38\uc11c", "a\u0323\u0301\u0488"]
    rows = [(2 * i + k, unicodedata.normalize(form, t)) for i, t in enumerate(pairs) for k, form in enumerate(("NFC", "NFD"))] + [(9, "a\u0301\u0323\u0488")]
    found = {r.doc_id: (r.high, r.low) for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == found[1] and found[2] == found[3] == found[9] != found[0]


def test_all_marks_on_letters(spark):
    """Every mark that Python knows, also those younger than the engine of regular expressions."""
    rng = random.Random(9)
    marks = [chr(c) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))]
    given = [rng.choice("aeJTh \u0915") + m + rng.choice(marks) + rng.choice(["", "\u0301", rng.choice(marks)]) + rng.choice(["", "x", rng.choice(marks)]) for m in marks]
    given += ["\u0303\u032e\u033b\u1ac5\u0330"]
    assert composed(spark, given) == [unicodedata.normalize("NFC", t) for t in given]


def test_case_and_marks(spark):
    small = [chr(c) for c in range(0xC0, 0x2100) if len(unicodedata.normalize("NFD", chr(c))) > 1 and chr(c).islower()]
    rows = []
    for i, c in enumerate(small):
        apart = unicodedata.normalize("NFD", c)
        capital = apart[0].upper() if apart[0].upper().lower() == apart[0] else apart[0]  # long s has the capital of s
        rows += [(i, c), (i, apart), (i, capital + apart[1:]), (i, unicodedata.normalize("NFC", capital + apart[1:]))]
    found = spark.createDataFrame(rows, "i long, t string").select("i", fingerprint.canonical(F.col("t")).alias("c")).distinct().collect()
    assert len(found) == len(small) > 400
    assert {r.i: r.c for r in found} == {i: unicodedata.normalize("NFC", c.lower()).replace("\u03c2", "\u03c3") for i, c in enumerate(small)}
