"""Operator 10: exact fingerprints of canonical texts, in DataFrame operations only.

The canonical text is in Unicode normal form C and lower case (sharp s as ss, final
sigma as sigma), with every run of white space as one space and none at the ends. Its fingerprint is a wide xxhash:
two 64-bit hashes with different seeds, as 32 hexadecimal digits. Documents are
grouped by fingerprint; inside groups of equal fingerprints the canonical texts
themselves are compared, and should they differ, a digest of the text parts them.

Normal form C is computed by expressions from the Unicode data of the driver's
Python, on the texts that can need it (with combining marks or characters that the
form replaces); Hangul jamo are joined by their numbers.

Defined results: a null text counts as empty; an empty or blank text has the
fingerprint of the empty text; rows are ordered by doc_id (null first), equal
doc_ids by text; a single document is its own next one; repeated rows give one row
each; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so
other columns never clash.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

#: Differing texts of one fingerprint, and first rows of ranges, that are broadcast.
BROADCAST_ROWS = 500_000

#: Text in one range of documents, about, and keys that are sampled for each range.
RANGE_BYTES = 16 << 20
SAMPLED = 32

#: Characters of a text that tell rows of one doc_id apart where ranges are cut.
START = 64

#: Where rows without doc_id stand.
LOWEST = -(1 << 63)


def unicode_tables() -> tuple[dict[str, str], dict[str, str], dict[str, str], dict[str, int]]:
    """Replaced characters, decompositions, compositions (of a pair) and classes of marks, from Python's data."""
    replaced, apart, pairs, classes = {}, {}, {}, {}
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        if "가" <= c <= "힣":
            continue
        if k := unicodedata.combining(c):
            classes[c] = k
        d = unicodedata.decomposition(c)
        if d and not d.startswith("<"):
            if unicodedata.normalize("NFC", c) != c:
                replaced[c] = unicodedata.normalize("NFC", c)
            else:
                apart[c] = unicodedata.normalize("NFD", c)
                pairs["".join(chr(int(x, 16)) for x in d.split())] = c
    return replaced, apart, pairs, classes


def as_map(d: dict) -> Column:
    """A constant map, written as one string: thousands of literals would take long to plan."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in d.items())), F.lit("\x01"), F.lit("\x02"))


def character_class(chars) -> str:
    """The same as a class of ranges, which a regular expression tests faster than single characters."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def composed(text: Column) -> Column:
    """Normal form C of ``text``."""
    replaced, apart, pairs, classes = unicode_tables()
    single = {a: b for a, b in replaced.items() if len(b) == 1}
    several = {a: b for a, b in replaced.items() if len(b) > 1}
    apart_of, whole_of, class_of = as_map(apart), as_map(pairs), as_map(classes)
    t = F.translate(text, "".join(single), "".join(single.values()))
    t = F.aggregate(F.map_keys(as_map(several)), t, lambda acc, c: F.when(F.contains(acc, c), F.replace(acc, c, F.try_element_at(as_map(several), c))).otherwise(acc))

    def compose(segment: Column) -> Column:
        # apart, marks in order of their class between those of class 0, then together again from the left
        chars = F.split(F.array_join(F.transform(F.split(segment, ""), lambda c: F.coalesce(F.try_element_at(apart_of, c), c)), ""), "")
        headless = F.try_element_at(class_of, F.element_at(chars, 1)).isNotNull()
        marks = F.transform(
            F.when(headless, chars).otherwise(F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0)))),
            lambda c, i: F.struct(F.lit(0).alias("g"), F.coalesce(F.try_element_at(class_of, c).cast("int"), F.lit(0)).alias("k"), i.alias("i"), c.alias("c")),
        )

        def sorted_in_stretches(marks):
            stretch = lambda m: F.size(F.filter(marks, lambda x: (x["k"] == 0) & (x["i"] <= m["i"])))
            return F.array_sort(F.transform(marks, lambda m: F.struct(stretch(m).alias("g"), m["k"].alias("k"), m["i"].alias("i"), m["c"].alias("c"))))

        marks = F.when(F.exists(marks, lambda m: m["k"] == 0), sorted_in_stretches(marks)).otherwise(F.array_sort(marks))
        base = F.when(headless, F.lit("")).otherwise(F.element_at(chars, 1))
        start = F.struct(F.lit("").alias("done"), base.alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))

        def step(acc, m):
            whole = F.when((acc["rest"] == "") | (acc["last"] < m["k"]), F.try_element_at(whole_of, F.concat(acc["base"], m["c"])))
            begins = whole.isNull() & (m["k"] == 0)  # what follows joins this one
            return F.struct(
                F.when(begins, F.concat(acc["done"], acc["base"], acc["rest"])).otherwise(acc["done"]).alias("done"),
                F.when(begins, m["c"]).otherwise(F.coalesce(whole, acc["base"])).alias("base"),
                F.when(begins, F.lit("")).when(whole.isNull(), F.concat(acc["rest"], m["c"])).otherwise(acc["rest"]).alias("rest"),
                F.when(begins, F.lit(-1)).when(whole.isNull(), m["k"]).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(marks, start, step, lambda acc: F.concat(acc["done"], acc["base"], acc["rest"]))

    # the engine of regular expressions may know fewer marks than Python's data: both count
    marks = rf"\p{{M}}{character_class({*classes, *(p[1] for p in pairs)})}"
    segments = F.regexp_extract_all(t, F.lit(rf"(?s)[^{marks}]+(?=[^{marks}]|\z)|[^{marks}]?[{marks}]+"), F.lit(0))
    joined = F.array_join(F.transform(segments, lambda s: F.when(s.rlike(f"[{marks}]"), compose(s)).otherwise(s)), "")
    # no mark and no replaced character comes before U+0300, which one range tells fast
    needs = text.rlike(r"[\x{300}-\x{10FFFF}]") & text.rlike(rf"[{marks}{character_class(replaced)}]")
    return with_syllables(F.when(needs, joined).otherwise(text))


def with_syllables(text: Column) -> Column:
    """``text`` with adjoining Hangul jamo joined to syllables, by their numbers."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]|[^\x{1100}-\x{1112}\x{AC00}-\x{D7A3}]+|."), F.lit(0))

    def join(piece: Column) -> Column:
        at = lambda i, least: F.ascii(F.substring(piece, i, 1)) - least
        from_jamo = 0xAC00 + (at(1, 0x1100) * 21 + at(2, 0x1161)) * 28 + F.when(F.char_length(piece) == 3, at(3, 0x11A7)).otherwise(F.lit(0))
        code = F.when(piece.rlike(r"^[\x{1100}-\x{1112}][\x{1161}-\x{1175}]"), from_jamo)
        code = code.when(piece.rlike(r"^[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]") & (at(1, 0xAC00) % 28 == 0), at(1, 0) + at(2, 0x11A7))
        return F.coalesce(F.decode(F.unhex(F.hex(code)), "UTF-16BE"), piece)

    return F.when(text.rlike(r"[\x{1100}-\x{11FF}]"), F.array_join(F.transform(pieces, join), "")).otherwise(text)


def canonical(text: Column) -> Column:
    """Folded first, then composed: a capital and its marks may have no single character where the small letter has."""
    folded = F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return F.trim(F.regexp_replace(composed(folded), SPACES, " "))


def hashes(canon: Column) -> tuple[Column, Column]:
    return F.xxhash64(canon), F.xxhash64(F.lit(1), canon)


def shown(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two halves of the fingerprint."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    high, low = hashes(F.col("canon"))
    return docs.withColumn("canon", canonical(F.col("text"))).select("doc_id", "text", "canon", high.alias("high"), low.alias("low"))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def groups(found: DataFrame, canon_of=None) -> DataFrame:
    """high, low, slot, group_id (its smallest doc_id) and n_copies of every group of equal canonical texts.

    ``slot`` is empty but where texts of one fingerprint differ: there it is the canonical
    text's digest. ``canon_of(several)`` gives high, low and canon of the rows of some
    fingerprints, for the comparison; without it, ``found`` has them.
    """
    counted = stash(found.groupBy("high", "low").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies")))
    several = counted.where("n_copies > 1").select("high", "low")
    rows = (canon_of or (lambda some: found.join(some, ["high", "low"], "left_semi")))(small(several))
    same = rows.groupBy("high", "low").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    differ = stash(same.where("a <> b").select("high", "low"))
    if differ.isEmpty():
        return counted.withColumn("slot", F.lit(""))
    rows = (canon_of or (lambda some: found.join(some, ["high", "low"], "left_semi")))(small(differ))
    parted = rows.groupBy("high", "low", F.sha2("canon", 256).alias("slot"))
    parted = parted.agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    return counted.join(differ, ["high", "low"], "left_anti").withColumn("slot", F.lit("")).unionByName(parted)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with what orders them: at (doc_id, null first) and start (of the text); h is a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumns({"at": F.coalesce("doc_id", F.lit(LOWEST)), "start": F.left("text", F.lit(START)), "h": F.xxhash64("text")})


def cuts_of(rows: DataFrame) -> list[tuple[int, str]]:
    """Where ranges of (at, start) begin that hold about RANGE_BYTES each, from a sample of a few keys for each range."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(2, -(-(total.bytes or 0) // RANGE_BYTES))
    one_of = max(1, total.n // (SAMPLED * n))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(7), "at", "start"), F.lit(one_of)) == 0).groupBy("at", "start").agg(F.sum(F.octet_length("text")).alias("bytes"))
    sample = sorted((r.at, r.start, r.bytes) for r in sample.collect())  # about SAMPLED keys for each range
    share, seen, cuts = sum(b for *_, b in sample) / n, 0, []
    for at, start, size in sample:
        if seen >= share * (len(cuts) + 1):
            cuts.append((at, start))
        seen += size
    return cuts


def part_of(cuts: list[tuple[int, str]]) -> Column:
    """The range of a row: how many cuts do not come after it, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    own = F.struct("at", "start")
    step = max(1, int(len(cuts) ** 0.5))
    chunks = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    pairs = lambda some: F.array(*(F.struct(F.lit(a).cast("long").alias("at"), F.lit(x).alias("start")) for a, x in some))
    chunk = F.size(F.filter(pairs([c[0] for c in chunks]), lambda c: c <= own))
    within = F.element_at(F.array(*map(pairs, chunks)), F.greatest(chunk, F.lit(1)))
    return F.greatest(chunk - 1, F.lit(0)) * step + F.size(F.filter(within, lambda c: c <= own))


def with_next(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint, and the text and fingerprint of the next one, the first after the last.

    Rows are cut into ranges; each range is one window, and gets the first row of the
    next range as its last. Rows of one doc_id are ordered by their texts, and spread
    over ranges by how these start.
    """
    rows = keyed(docs)
    rows = rows.withColumn("part", part_of(cuts_of(rows)))
    firsts = sorted((r["first"].at, r["first"].start, r.part) for r in rows.groupBy("part").agg(F.min(F.struct("at", "start")).alias("first")).collect())  # a row for each range
    before = [(at, start, firsts[i - 1][2]) for i, (at, start, _) in enumerate(firsts)]
    before = small(rows.sparkSession.createDataFrame(before, "at long, start string, before int"))
    head = rows.join(before, ["at", "start"]).groupBy("at", "start", "before").agg(F.min("text").alias("text")).select("text", F.col("before").alias("part"))
    own = rows.select("part", "text", "doc_id", "at", "h", F.lit(False).alias("extra"))
    own = own.unionByName(head.select("part", "text", F.lit(None).cast("long").alias("doc_id"), F.lit(LOWEST).alias("at"), F.lit(0).cast("long").alias("h"), F.lit(True).alias("extra")))
    high, low = hashes(F.col("canon"))
    own = own.withColumn("canon", canonical(F.col("text"))).select("part", "text", "doc_id", "at", "h", "extra", high.alias("high"), low.alias("low"))
    order = Window.partitionBy("part").orderBy("extra", "at", "text")
    own = own.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "high", "low")})
    return own.where(~F.col("extra"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_canon", canonical(F.col("edited")))
    high, low = hashes(F.col("edited_canon"))
    same = lambda a, b: ((F.col("high") == a) & (F.col("low") == b)).cast("double")
    # both canonical forms are computed once: what follows reads this table
    rows = stash(rows.select(
        "doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2"), "high", "low", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        shown(high, low).alias("edited_fingerprint"), same(high, low).alias("near_edited"), same(F.col("next_high"), F.col("next_low")).alias("near_next"),
    ))

    def canon_of(some: DataFrame) -> DataFrame:
        wanted = stash(rows.join(some, ["high", "low"], "left_semi").select("h").distinct())
        return fingerprints(keyed(docs).join(small(wanted), "h", "left_semi")).join(some, ["high", "low"], "left_semi")

    kept = groups(rows, canon_of)
    parted = kept.where("slot <> ''").select("high", "low").distinct()
    slots = canon_of(small(stash(parted))).select(F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("h2"), F.sha2("canon", 256).alias("slot")).distinct() if not parted.isEmpty() else None
    rows = rows.withColumn("slot", F.lit("")) if slots is None else rows.join(slots, ["h", "h2"], "left").na.fill("", ["slot"])
    out = rows.join(kept, ["high", "low", "slot"], "left")
    return out.select("doc_id", "n_chars", "edited_sha256", shown(F.col("high"), F.col("low")).alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "group_id", "n_copies")
