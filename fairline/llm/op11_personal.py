"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs and digits, `://` and `tel:`, and cue words of identifiers.
From each anchor the parser of its kind expands to the boundaries (an at-sign to both sides, the others to the right) and
validates what it found: parts of an address, the check sum of a card or bank account, numbers of digits. A parser reads
the text from an anchor once and says how far it has read, so no stretch is read again for the same kind and a text costs
time in proportion to its length. A kind's spans are the leftmost non-overlapping ones; a candidate that fails is dropped
without a second try inside it.

Kinds: email, ip, card, phone (the base); login (user and password in a URL), tel (number of a tel: link), iban, account and
ssn (numbers behind such a word). Spans count code points, the end is exclusive. Letters and digits are ASCII ones.

Cases: a null text counts as empty and has no spans; repeated rows and null ids are searched as they are; an empty table
gives no rows; texts of any length are searched whole; other columns stay, one with the name of the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from fairline.llm.common import small_batches, source, worker_cache

FOUND = ArrayType(StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# What a parser says at an anchor: (read up to here, span or None); None: nothing read.
Parsed = tuple[int, tuple[int, int] | None] | None


@dataclass(frozen=True)
class Rule:
    """A kind: the literals (lower case) that anchor it and its parser (text, place of the anchor, end of the last match)."""

    kind: str
    anchors: tuple[str, ...]
    parse: Callable[[str, int, int], Parsed]


_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){0,2}+")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])*+")
_DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Check sum of a card number: from the right, every second digit doubled, digits of the doubles summed."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(number))) % 10 == 0


def mod97(iban: str) -> bool:
    """Check sum of a bank account number: the first four characters last, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def email(text: str, at: int, free: int) -> Parsed:
    right = _DOMAIN.match(text, at)
    if right is None:
        return None
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    return (right.end(), (start, right.end())) if start < at else None


def ip(text: str, at: int, free: int) -> Parsed:
    m = _QUAD.match(text, at)
    if m is None:
        return _DOTTED.match(text, at).end(), None  # nor is there one further on in the same digits and dots
    good = all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))
    return m.end(), (at, m.end()) if good else None


def card(text: str, at: int, free: int) -> Parsed:
    end = _SPACED.match(text, at).end()
    good = 16 <= end - at <= 40 and 16 <= len(n := digits(text[at:end])) <= 19 and luhn(n)
    return end, (at, end) if good else None


def phone(text: str, at: int, free: int) -> Parsed:
    m = _DIALLED.match(text, at)
    return None if m is None else (m.end(), m.span() if 8 <= len(digits(m[0])) <= 15 else None)


def any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else re.escape(c) if c != " " else "\\x20" for c in word)


@dataclass(frozen=True)
class Cue:
    """A kind by a pattern that begins with one of its cues; the span is the group, of valid values only.

    least, most: digits, or characters other than blanks if checked; tail: characters of the pattern behind the group.
    """

    kind: str
    cues: tuple[str, ...]
    rest: str
    least: int
    most: int
    checked: bool = False
    tail: int = 0

    def pattern(self) -> str:
        edge = "\\b" if self.cues[0].isalnum() else ""
        return f"{edge}(?:{'|'.join(map(any_case, self.cues))}){self.rest}"

    def valid(self, value: str) -> bool:
        if self.checked:
            bare = value.replace(" ", "")
            return self.least <= len(bare) <= self.most and mod97(bare)
        return self.least <= sum("0" <= c <= "9" for c in value) <= self.most

    def rule(self) -> Rule:
        compiled = re.compile(self.pattern(), re.ASCII)

        def parse(text: str, at: int, free: int) -> Parsed:
            m = compiled.match(text, at)
            return None if m is None else (m.end(), m.span(1) if self.valid(m[1]) else None)

        return Rule(self.kind, self.cues, parse)


_ACCOUNT_WORDS = ("account", "acct", "konto", "compte", "cuenta")
CUES = (
    Cue("login", ("://",), r"([A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$-]+)@", 0, 1 << 30, tail=1),
    Cue("tel", ("tel:",), r"([0-9][0-9().-]*[0-9])", 7, 15),
    Cue("iban", ("iban",), r"[\x20:#=]*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4})*(?:\x20?[A-Z0-9]{1,3})?)\b", 15, 34, checked=True),
    Cue("account", _ACCOUNT_WORDS, r"(?:\x20(?:no|nr|number))?\.?[\x20:#=]*([0-9](?:[\x20-]?[0-9])*)", 6, 18),
    Cue("ssn", ("ssn", "social security"), r"(?:\x20number)?[\x20:#=]*([0-9]{3}-[0-9]{2}-[0-9]{4})\b", 9, 9),
)
BASE_RULES = (Rule("email", ("@",), email), Rule("ip", tuple("0123456789"), ip), Rule("card", tuple("0123456789"), card), Rule("phone", ("+",), phone))
RULES = BASE_RULES + tuple(c.rule() for c in CUES)


class Finder:
    """The automaton over the anchors of all rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        import ahocorasick

        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for literal in sorted({a for r in rules for a in r.anchors}):
            self.automaton.add_word(literal, (len(literal), tuple(k for k, r in enumerate(rules) if literal in r.anchors)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(rule number, start, end), by rule, then by start."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose small form is longer: only ASCII ones are folded then
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        free = [0] * len(self.rules)
        out: list[tuple[int, int, int]] = []
        for last, (length, kinds) in self.automaton.iter(low):
            at = last + 1 - length
            for k in kinds:
                if at >= free[k] and (got := self.rules[k].parse(text, at, free[k])) is not None:
                    free[k] = got[0]
                    if got[1] is not None:
                        out.append((k, *got[1]))
        out.sort()
        return out


def find(docs: DataFrame, into: str = "found") -> DataFrame:
    """Adds the spans of every text as an array of (kind, start, end), by kind in the order of the rules, then by start."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != into]
    columns = docs.select(*kept)
    schema = StructType(list(columns.schema.fields)).add(into, FOUND)
    place = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_cache().get("personal")
        if finder is None:
            finder = worker_cache()["personal"] = Finder()
        names = [r.kind for r in finder.rules]
        for batch in batches:
            offsets, flat = [0], []
            for text in batch.column(place).to_pylist():
                flat += finder.spans(text) if text else ()
                offsets.append(len(flat))
            parts = [pa.array([names[k] for k, _, _ in flat], pa.string()), pa.array([s for _, s, _ in flat], pa.int32()), pa.array([e for _, _, e in flat], pa.int32())]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=schema.names)

    return columns.mapInArrow(run, schema)


def masked(text: Column, found: Column, by: str = "[{}]") -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one by start."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.format_string(by.replace("{}", "%s"), s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.length(text) - acc["at"], F.lit(0)))))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(kinds: list[str]) -> Column:
    return F.filter("found", lambda s: s["kind"].isin(kinds))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(source(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = [r.kind for r in BASE_RULES]
    counts = [F.size(_of_kinds([k])).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_told(_of_kinds(base)), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"))


def _sql() -> str:
    bare = "regexp_replace(g, '[^0-9]', '', 'g')"
    count = f"length({bare})"
    double = f"list_sum(list_transform(range(1, {count} + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({bare}[{count} + 1 - i] AS INT) ELSE (CAST({bare}[{count} + 1 - i] AS INT) * 2) // 10 + (CAST({bare}[{count} + 1 - i] AS INT) * 2) % 10 END))"
    kinds = [
        ("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true", 0),
        ("ip", r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", "len(list_filter(string_split(g, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST(right('000' || p, 3) AS INT) > 255)) = 0", 0),
        ("card", r"([0-9](?:[\x20-]?[0-9])+)", f"CASE WHEN {count} BETWEEN 16 AND 19 THEN {double} % 10 = 0 ELSE false END", 0),
        ("phone", r"(\+[0-9][\x20().0-9-]+[0-9])", f"{count} BETWEEN 8 AND 15", 0),
    ]
    for c in CUES:
        v = "replace(g, ' ', '')"
        digit = f"list_transform(string_split(substr({v}, 5) || substr({v}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)"
        rest = f"list_reduce(list_concat([0], {digit}), lambda a, b: (a * (CASE WHEN b >= 10 THEN 100 ELSE 10 END) + b) % 97) = 1"
        kinds.append((c.kind, c.pattern(), f"CASE WHEN length({v}) BETWEEN {c.least} AND {c.most} THEN {rest} ELSE false END" if c.checked else f"{count} BETWEEN {c.least} AND {c.most}", c.tail))

    def outside(pattern: str) -> str:  # the same pattern without its group
        return re.sub(r"\((?!\?)", "(?:", pattern)

    each = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{kind}' AS kind, {tail} AS tail, g, m, s FROM (SELECT r, gs[i] AS g, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s"
        f" FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', 1) AS gs, string_split_regex(text, '{outside(p)}') AS ps FROM t))) WHERE {good}"
        for k, (kind, p, good, tail) in enumerate(kinds)
    )
    return f"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
    e AS ({each}),
    spans AS (SELECT r, k, s + length(m) - tail - length(g) AS s, kind || ':' || CAST(s + length(m) - tail - length(g) AS BIGINT) || ':' || CAST(s + length(m) - tail AS BIGINT) AS span FROM e),
    agg AS (
      SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
             string_agg(span, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, s) AS spans FROM spans GROUP BY r)
    SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN agg USING (r)"""


ORACLE_SQL = _sql()
