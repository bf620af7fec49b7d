"""Operator 1: secret scans over a trigram inverted index, in DataFrame operations only.

Every rule is a regular expression. ``trigram_query`` derives from it what any
match must contain: alternatives, each a set of lower-case trigrams. The index
has one posting (trigram, doc_id) for each trigram that some rule asks for and
that the text contains. Postings are intersected per document and rule; texts
of candidates are then verified by the regular expression itself. A rule without
a mandatory trigram (the hexadecimal one) scans all texts.

Defined results: a null text counts as empty; every input row gives one row, so
repeated rows give repeated results; rows without doc_id share one index entry
and are verified one by one; an empty table gives an empty one. Only ``doc_id``
and ``text`` are read, so other columns never clash.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash, table

#: Strings, alternatives or characters of a class that a derivation follows.
FOLLOWED = 24

#: Candidates that are broadcast to the texts; beyond it, both sides are shuffled.
BROADCAST_ROWS = 500_000

#: Trigrams in one word of a document's index entry.
WORD = 60


def either_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


@dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


KEYWORDS = f"{either_case('password')}|{either_case('passwd')}|{either_case('secret')}|{either_case('token')}|{either_case('api')}_?{either_case('key')}"

BASE = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)

RULES = (
    *BASE,
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("source_host", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
)


# A query is a set of alternatives, each the set of trigrams that it needs.
# The alternative that needs nothing makes the query true of any text.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def either(a: Query, b: Query) -> Query:
    both = a | b
    return frozenset(x for x in both if not any(y < x for y in both))


def both(a: Query, b: Query) -> Query:
    return reduce(either, (frozenset([x | y]) for x in a for y in b)) if len(a) * len(b) <= FOLLOWED**2 else a


def of_strings(strings: set[str]) -> Query:
    return reduce(either, (frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings))


def of_item(op, value) -> tuple[set[str] | None, Query]:
    """The lower-case strings that an item can match, if these are few, and what it needs."""
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()}, ANY
    if name == "AT":
        return {""}, ANY
    if name == "IN":
        ranges = [(v, v) if str(o) == "LITERAL" else v if str(o) == "RANGE" else (0, 0x10FFFF) for o, v in value]
        if sum(b - a + 1 for a, b in ranges) <= FOLLOWED and not any(str(o) == "NEGATE" for o, _ in value):
            chars = {chr(c).lower() for a, b in ranges for c in range(a, b + 1)}
            return (chars, ANY) if len(chars) <= FOLLOWED // 3 else (None, ANY)
    if name == "SUBPATTERN":
        return of_sequence(value[-1])
    if name == "BRANCH":
        parts = [of_sequence(x) for x in value[1]]
        needs = reduce(either, (n if s is None else of_strings(s) for s, n in parts))
        strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
        return (strings, ANY) if strings is not None and len(strings) <= FOLLOWED else (None, needs)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = value
        strings, needs = of_sequence(inner)
        if strings is not None and (least, most) in ((0, 1), (1, 1)):
            return strings | ({""} if least == 0 else set()), ANY
        if least:
            return None, needs if strings is None else of_strings(strings)
    return None, ANY


def of_sequence(items) -> tuple[set[str] | None, Query]:
    strings, needs, whole = {""}, ANY, True
    for op, value in items:
        more, inner = of_item(op, value)
        if more is not None and len(strings) * len(more) <= FOLLOWED:
            strings = {a + b for a in strings for b in more}
            continue
        needs, whole = both(both(needs, of_strings(strings)), inner), False
        strings = more if more is not None and len(more) <= FOLLOWED else {""}
    return (strings, ANY) if whole else (None, both(needs, of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must contain for ``pattern`` to match anywhere in it."""
    strings, needs = of_sequence(regex_tree.parse(pattern))
    return needs if strings is None else of_strings(strings)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: a row (trigram, doc_id) for each of ``trigrams`` in a text."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))))
    return low.select(F.explode(present).alias("trigram"), "doc_id")


def candidates(index: DataFrame, trigrams: list[str], queries: dict[int, Query]) -> DataFrame:
    """doc_id and ``maybe``, the places of the rules whose postings intersect there."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = range((len(trigrams) + WORD - 1) // WORD)
    bit = F.expr(f"shiftleft(1L, cast(trigram % {WORD} as int))")
    found = index.groupBy("doc_id").agg(*(F.bit_or(F.when(F.expr(f"trigram div {WORD}") == w, bit)).alias(f"w{w}") for w in words))

    def has(needed: frozenset) -> Column:
        masks = {w: sum(1 << place[t] % WORD for t in needed if place[t] // WORD == w) for w in words}
        return reduce(Column.__and__, (F.coalesce(F.col(f"w{w}"), F.lit(0)).bitwiseAND(F.lit(m)) == F.lit(m) for w, m in masks.items() if m))

    maybe = F.array_compact(F.array(*(F.when(reduce(Column.__or__, map(has, q)), F.lit(r)) for r, q in queries.items())))
    return found.select("doc_id", maybe.alias("maybe")).where(F.size("maybe") > 0)


def spans_of(rule: Rule, order: int) -> Column:
    """Kept matches of one rule in ``text``: the text between matches gives their places."""
    p = F.lit(rule.pattern)
    whole, value = F.regexp_extract_all("text", p, F.lit(0)), F.regexp_extract_all("text", p, F.lit(rule.group))
    rows = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.split("text", rule.pattern, -1).alias("gap"))
    rows = F.filter(rows, lambda m: m["whole"].isNotNull())
    none = F.array().cast("array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>")

    def step(acc, m):
        start = acc["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["whole"])
        span = F.struct(start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.char_length(m["value"]) >= rule.least, F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(rows, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: bool = False) -> DataFrame:
    """doc_id, text and ``spans``: array of (start, kind_order, end, kind) by start, then kind.

    Places are code points; ends are exclusive. With ``carry``, column ``carried`` has the whole input row.
    """
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")] if carry else []
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *whole)
    queries = {r: q for r, rule in enumerate(rules) if (q := trigram_query(rule.pattern)) != ANY}
    trigrams = sorted(set().union(*(t for q in queries.values() for t in q)))
    if queries:
        found = stash(candidates(postings(docs, trigrams), trigrams, queries).withColumnRenamed("doc_id", "at"))
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        docs = docs.join(found, F.col("doc_id").eqNullSafe(F.col("at")), "left")
    parts = []
    for r, rule in enumerate(rules):
        # Without trigrams the longest possible run of the rule's least length is sought first: one pass over most texts.
        least = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.pattern.endswith("]+") and rule.group == 0 else rule.pattern
        open_to = F.array_contains("maybe", r) if r in queries else F.col("text").rlike(least)
        parts.append(F.when(open_to, spans_of(rule, r)))
    spans = F.sort_array(F.flatten(F.array_compact(F.array(*parts))))
    return docs.select("doc_id", "text", spans.alias("spans"), *(["carried"] if carry else []))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs``, with all their columns, and every kept match in the text replaced by ``mark``.

    Overlapping spans give one mark; a null text stays null.
    """
    replaced = (
        "aggregate(spans, struct('' as out, 0L as at), (acc, s) -> struct("
        f"if(s.start >= acc.at, concat(acc.out, substring(text, cast(acc.at + 1 as int), cast(s.start - acc.at as int)), '{mark}'), acc.out) as out, greatest(acc.at, s.end) as at), "
        "acc -> concat(acc.out, substring(text, cast(acc.at + 1 as int))))"
    )
    found = scan(docs, rules, carry=True)
    text = F.when(F.size("spans") > 0, F.expr(replaced)).otherwise(F.col("carried.text"))
    return found.select(*(text.alias("text") if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda r: F.size(F.filter("spans", lambda s: s["kind_order"] == r)).cast("long")
    return found.select(
        "doc_id",
        *(count(r).alias(f"n_{rule.kind}") for r, rule in enumerate(BASE)),
        F.sha2(joined(F.filter("spans", lambda s: s["kind_order"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result in SQL: all rules scan all texts."""
    quoted = lambda p: p.replace("'", "''")
    parts, spans = [], []
    for r, rule in enumerate(rules):
        p = quoted(rule.pattern)
        parts.append(f"regexp_extract_all(t, '{p}', 0) AS m{r}, regexp_extract_all(t, '{p}', {rule.group}) AS v{r}, string_split_regex(t, '{p}') AS g{r}")
        before = f"coalesce(list_sum(list_transform(m{r}[1:i-1], lambda x: length(x))), 0)"
        start = f"CAST(list_sum(list_transform(g{r}[1:i], lambda x: length(x))) + {before} AS BIGINT)"
        kept = f"list_filter(range(1, len(m{r}) + 1), lambda i: length(v{r}[i]) >= {rule.least})"
        spans.append(f"list_transform({kept}, lambda i: {{'s': {start}, 'k': {r}, 'e': {start} + length(m{r}[i]), 'n': '{rule.kind}'}})")
    text = lambda x: f"coalesce(list_aggregate(list_transform({x}, lambda s: s.n || ':' || s.s || ':' || s.e), 'string_agg', ','), '')"
    count = ", ".join(f"CAST(len(list_filter(spans, lambda s: s.k = {r})) AS BIGINT) AS n_{rule.kind}" for r, rule in enumerate(BASE))
    return (
        f"WITH found AS (SELECT doc_id, {', '.join(parts)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), "
        f"placed AS (SELECT doc_id, list_sort(flatten([{', '.join(spans)}])) AS spans FROM found) "
        f"SELECT doc_id, {count}, sha256({text(f'list_filter(spans, lambda s: s.k < {len(BASE)})')}) AS base_sha256, {text('spans')} AS spans FROM placed"
    )
