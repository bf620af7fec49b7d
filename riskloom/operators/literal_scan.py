"""Regular-expression rules for large catalogues: one automaton of literals tells which rules a file can match.

Every pattern is read for literals of which any match must hold at least one. An
Aho-Corasick automaton of all literals goes over a file once, and only patterns whose
literals it meets are tried, and only on the lines where it meets them. Patterns without such
literals are tried on every line. The catalogue is shipped to the tasks, so the plan is as
large for ten thousand rules as for one.

Results are those of ``regex_scan.scan``, which calls this beyond FOLDED_PATTERNS.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import MAX_FILE_BYTES, REGEX_SUFFIXES, regex_severity
from ..sources.rules import Rule
from .regex_scan import readable, scan_order

#: Literals that are shorter say too little.
LEAST_LITERAL = 2

#: Rules of one catalogue; they are configuration and lie on the driver.
MOST_RULES = 200_000

# Letters that match i, s or k when case is ignored, but are no capitals of theirs.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}

REPEAT = re.compile(r"\{(\d*)(,?)(\d*)\}")
ESCAPED_HEX = {"x": 2, "u": 4, "U": 8}


class Unreadable(Exception):
    """Inline flags, conditions, comments and other things that change what a pattern means."""


def folded(text: str) -> str:
    """In lower case, so that ASCII letters are found whatever the case."""
    return text.translate(ALIKE).lower()


class Reader:
    """Goes through a pattern that is known to be valid and says which literals a match must hold."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def alternatives(self) -> frozenset[str] | None:
        found = [self.sequence()]
        while self.at < len(self.p) and self.p[self.at] == "|":
            self.at += 1
            found.append(self.sequence())
        return None if None in found else frozenset().union(*found)

    def sequence(self) -> frozenset[str] | None:
        found, run = [], ""
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            kind, value = self.atom()
            least, repeated = self.repeats()
            if kind == "char" and value.isascii() and least:
                run += value.lower()
                if not repeated:
                    continue
            elif kind == "nothing":
                continue
            elif kind == "group" and least and value is not None:
                found.append(value)
            found.append(frozenset([run]))
            run = ""
        found.append(frozenset([run]))
        able = [f for f in found if all(len(x) >= LEAST_LITERAL for x in f)]
        return max(able, key=lambda f: (min(map(len, f)), -len(f)), default=None)

    def repeats(self) -> tuple[int, bool]:
        """How often the last atom must stand, and whether a repetition follows it."""
        rest = self.p[self.at : self.at + 1]
        if rest in ("*", "?", "+"):
            self.at, least = self.at + 1, int(rest == "+")
        elif rest == "{" and (m := REPEAT.match(self.p, self.at)) and m[0] not in ("{}",):
            self.at, least = m.end(), int(m[1] or 0)
        else:
            return 1, False
        if self.p[self.at : self.at + 1] in ("?", "+"):
            self.at += 1
        return least, True

    def atom(self) -> tuple[str, object]:
        c = self.p[self.at]
        self.at += 1
        if c == "\\":
            return self.escaped()
        if c == "[":
            return self.one_of()
        if c == "(":
            return self.group()
        if c in "^$":
            return "nothing", None
        return ("other", None) if c == "." else ("char", c)

    def escaped(self) -> tuple[str, object]:
        c = self.p[self.at]
        self.at += 1
        if not c.isalnum():
            return "char", c
        if c in "bBAZz":
            return "nothing", None
        if c in ESCAPED_HEX:
            self.at += ESCAPED_HEX[c]
        elif c == "N":
            self.at = self.p.index("}", self.at) + 1
        elif c.isdigit():
            while self.p[self.at : self.at + 1].isdigit():
                self.at += 1
        return "other", None

    def one_of(self) -> tuple[str, object]:
        if self.p[self.at] == "^":
            self.at += 1
        first = True
        while first or self.p[self.at] != "]":
            self.at += 2 if self.p[self.at] == "\\" else 1
            first = False
        self.at += 1
        return "other", None

    def group(self) -> tuple[str, object]:
        kind = "group"
        if self.p.startswith("?", self.at):
            m = re.compile(r"\?(?::|>|P<\w+>|(?P<look><?[=!])|(?P<back>P=\w+))").match(self.p, self.at)
            if m is None:
                raise Unreadable(self.p)
            self.at = m.end()
            if m["back"] is not None:
                self.at += 1
                return "other", None
            kind = "nothing" if m["look"] else "group"
        found = self.alternatives()
        self.at += 1
        return kind, found if kind == "group" else None


def literals_of(pattern: str) -> frozenset[str] | None:
    """Literals, in lower case, of which every match holds one at least, whatever the case; None if none can be told."""
    try:
        return Reader(pattern).alternatives()
    except (Unreadable, IndexError, ValueError):
        return None


@dataclass(frozen=True)
class Tried:
    """A rule with the numbers of its patterns, in order."""

    ordinal: int
    rule: Rule
    patterns: tuple[int, ...]

    def applies(self, package_name: str | None, file: str) -> bool:
        expected = package_name is not None and package_name.lower() in {n.lower() for n in self.rule.expected_for}
        return not expected and (not self.rule.file_scope or file in self.rule.file_scope)


class Catalogue:
    """What a task needs of the rules; the automaton is built where it is used."""

    def __init__(self, rules: list[Rule]):
        self.patterns: list[str] = []
        self.rules: list[Tried] = []
        for ordinal, rule in enumerate(r for r in rules if r.type == "regex" and r.target == "source"):
            own = []
            for p in (x.get("pattern") for x in rule.rules):
                try:
                    if p:
                        re.compile(p)
                        own.append(len(self.patterns))
                        self.patterns.append(p)
                except re.error:
                    continue  # an invalid expression takes only itself out
            if own:
                self.rules.append(Tried(ordinal, rule, tuple(own)))

    def finder(self):
        """A function that gives (rule, line number, line) for a file's text: at most one for each rule."""
        import ahocorasick

        automaton, always, of, by_literal = ahocorasick.Automaton(), [], {}, {}
        for place, tried in enumerate(self.rules):
            for p in tried.patterns:
                of[p] = place
                found = literals_of(self.patterns[p])
                if found is None:
                    always.append(p)
                for literal in found or ():
                    by_literal.setdefault(literal, []).append(p)
        for literal, own in by_literal.items():
            automaton.add_word(literal, own)
        automaton.make_automaton()
        compiled: dict[int, re.Pattern] = {}

        def search(p: int):
            if p not in compiled:
                compiled[p] = re.compile(self.patterns[p], re.IGNORECASE)
            return compiled[p].search

        def find(package_name: str | None, file: str, text: str):
            lines, met = text.splitlines(), {p: None for p in always}
            low = folded(text).splitlines()
            ends = list(accumulate(len(x) + 1 for x in low))
            if by_literal and low:
                for end, own in automaton.iter("\n".join(low)):
                    line = bisect_right(ends, end)
                    for p in own:
                        places = met.setdefault(p, [])
                        if places is not None and (not places or places[-1] != line):
                            places.append(line)
            for place in sorted({of[p] for p in met}):
                tried = self.rules[place]
                if not tried.applies(package_name, file):
                    continue
                for p in tried.patterns:
                    if p in met:
                        hit = next((i for i in (range(len(lines)) if met[p] is None else met[p]) if search(p)(lines[i])), None)
                        if hit is not None:
                            yield tried, hit + 1, lines[hit]
                            break

        return find


def scan(files: DataFrame, rules: list[Rule], most_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:
    """Findings of regex rules: at most one for each rule and file, the first pattern that matches anywhere, in its first line."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"a catalogue of {len(rules)} rules is no configuration")
    shipped = files.sparkSession.sparkContext.broadcast(Catalogue(rules))  # MOST_RULES at most
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
    names = ["rel_path", "ordinal", "pattern_id", "category", "weight", "description", "evidence", "line_number"]

    def run(batches):
        find = None
        for batch in batches:
            find = find or shipped.value.finder()
            own, out = [], []
            for i, (package, path, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for tried, line_no, line in find(package, path.rsplit("/", 1)[-1], text or ""):
                    own.append(i)
                    out.append((path, tried.ordinal, tried.rule.pattern_id, tried.rule.category, tried.rule.severity, tried.rule.description, line.strip(), line_no))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), *columns], names=["package_id", *names])

    source = readable(files, REGEX_SUFFIXES, most_bytes).select("package_id", F.col("package_name").cast("string"), "rel_path", "text")
    kind = source.schema["package_id"].dataType.simpleString()
    found = source.mapInArrow(run, f"package_id {kind}, rel_path string, ordinal long, pattern_id string, category string, weight int, description string, evidence string, line_number int")
    return found.select(
        "package_id", scan_order(F.col("rel_path"), F.col("ordinal")).alias("finding_seq"), "pattern_id", "category", regex_severity(F.col("weight"), F.col("rel_path")).alias("severity"), "description",
        "evidence", F.col("rel_path").alias("source_file"), "line_number", F.lit("static").alias("layer"),
    )
