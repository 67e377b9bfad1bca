"""Secret scans through a trigram index.

Every rule's regex is turned into a Boolean query over trigrams that any match must contain. Each shard of rows (a few
megabytes of text inside a task) gets an inverted index trigram -> rows for the trigrams that the rules use; postings
are intersected and united as the query says, and the candidates are verified with the regex itself. Rules without a
mandatory trigram (here: hex) scan every row of the shard. Spans count code points, the end is exclusive.

Cases: a null text counts as empty (no span, digest of the empty string); repeated rows and null ids are scanned as they
are; an empty table gives no rows; texts of any length are scanned whole; columns other than the id and the text are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fairline.llm.common import small_batches, source, worker_cache


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of the pattern whose group has min_chars characters or more; others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# Runs of 18 or 16 characters: a run that is too short holds no longer one, so the count may stand in the pattern.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
)
RULES = BASE_RULES + MORE_RULES

ALL = ("all",)
_MOST_STRINGS = 64


def _both(a: tuple, b: tuple) -> tuple:
    return b if a == ALL else a if b == ALL or a == b else ("and", a, b)


def _either(qs: list[tuple]) -> tuple:
    qs = list(dict.fromkeys(qs))
    return ALL if ALL in qs or not qs else qs[0] if len(qs) == 1 else ("or", *qs)


def _of_strings(strings: set[str]) -> tuple:
    """Text that holds one of the strings holds all trigrams of that string."""
    found = []
    for s in sorted(strings):
        data, q = s.encode(), ALL
        for t in dict.fromkeys(data[i : i + 3] for i in range(len(data) - 2)):
            q = _both(q, ("tri", t))
        found.append(q)
    return _either(found)


def _walk(tree) -> tuple[set[str] | None, tuple]:
    """(all strings that the tree matches, in lower case, if they are few; a query that every match fulfils)."""
    query, run = ALL, {""}
    exact = True
    for op, arg in tree:
        name, strings, own = str(op), None, ALL
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            chars = {chr(a).lower() for o, a in arg if str(o) == "LITERAL"}
            strings = chars if all(str(o) == "LITERAL" for o, _ in arg) and len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            strings, own = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            own = _either([p[1] if p[0] is None else _of_strings(p[0]) for p in parts])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, sub = arg
            inner, inner_q = _walk(sub)
            if (least, most) == (0, 1) and inner is not None:
                strings = inner | {""}
            elif least >= 1:
                strings = inner if most == 1 else None
                own = inner_q if inner is None else _of_strings(inner)
        elif name == "AT":
            strings = {""}
        if strings is not None and len(strings) * len(run) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        query, run = _both(query, _of_strings(run)), {""}
        query = _both(query, own if strings is None else _of_strings(strings))
    if exact:
        return run, ALL
    return None, _both(query, _of_strings(run))


def trigram_query(pattern: str) -> tuple:
    """("all",), ("tri", bytes), ("and", ...) or ("or", ...) over lower-case trigrams; ("all",) says: scan every row."""
    strings, query = _walk(re._parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(_trigrams(q) for q in query[1:])) if query[0] != "all" else set()


class Shards:
    """Index of a shard for the trigrams of the rules; postings are sorted row numbers."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.ids = np.zeros(1 << 24, np.uint8 if len(self.names) < 256 else np.uint16)
        for i, t in enumerate(self.names):
            self.ids[t[0] << 16 | t[1] << 8 | t[2]] = i + 1

    def postings(self, texts: list[str]) -> dict[bytes, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        starts = np.cumsum([0] + [len(r) + 3 for r in raw])
        data = np.frombuffer(b"\0\0\0".join([*raw, b""]), np.uint8)
        code = data[:-2].astype(np.uint32) << np.uint32(16)
        code |= data[1:-1].astype(np.uint32) << np.uint32(8)
        code |= data[2:]
        hit = self.ids[code]
        at = np.flatnonzero(hit)
        pairs = np.unique(hit[at].astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        which, rows = np.divmod(pairs, len(texts))
        return {t: rows[np.searchsorted(which, i + 1) : np.searchsorted(which, i + 2)] for i, t in enumerate(self.names)}

    def rows(self, query: tuple, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
        if query[0] == "all":
            return np.arange(n)
        if query[0] == "tri":
            return index[query[1]]
        out = self.rows(query[1], index, n)
        for q in query[2:]:
            out = (np.intersect1d if query[0] == "and" else np.union1d)(out, self.rows(q, index, n))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text (start, rule number, end), sorted."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        index = self.postings(texts) if self.names else {}
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in self.rows(query, index, len(texts)):
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.min_chars]
        return [sorted(x) for x in out]


def shard_groups(lengths: list[int], most_chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE_RULES), redact: str | None = None) -> DataFrame:
    """Adds a count n_<kind> per base rule, base_sha256 and spans to the columns of docs.

    With redact, spans of the text are replaced by that string (overlapping ones once) and only n_spans is added.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    schema = StructType(list(docs.schema.fields))
    if redact is None:
        for r in rules[:base]:
            schema = schema.add(f"n_{r.kind}", "long")
        schema = schema.add("base_sha256", "string").add("spans", "string")
    else:
        schema = schema.add("n_spans", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("secrets", *((r.kind, r.pattern, r.group, r.min_chars, r.any_case) for r in rules))
        shards = worker_cache().get(key)
        if shards is None:
            shards = worker_cache()[key] = Shards(rules)
        place = columns.index("text")
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = []
            for a, b in shard_groups([len(t) for t in texts]):
                found += shards.spans(texts[a:b])
            told = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in xs)
            kept = {n: batch.column(i) for i, n in enumerate(columns)}
            if redact is None:
                more = [pa.array([sum(k == j for _, k, _ in x) for x in found], pa.int64()) for j in range(base)]
                more.append(pa.array([hashlib.sha256(told([y for y in x if y[1] < base]).encode()).hexdigest() for x in found], pa.string()))
                more.append(pa.array([told(x) for x in found], pa.string()))
            else:
                more = [pa.array([len(x) for x in found], pa.int64())]
                new = [masked(t, x, redact) if x else t for t, x in zip(texts, found, strict=True)]
                kept["text"] = pa.array([None if o is None else t for o, t in zip(batch.column(place).to_pylist(), new, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.values(), *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    parts, at = [], 0
    for s, _, e in spans:
        if s >= at:
            parts += [text[at:s], by]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(source(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def _sql() -> str:
    kinds = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
        ("access", "(AKIA[A-Z0-9]+)", 18),
        ("hex", "([0-9a-f]+)", 16),
        *((r.kind, "(" + r.pattern + ")", 1) for r in MORE_RULES),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, r, {k} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{pat}') AS ms, regexp_extract_all(text, '{pat}', 1) AS gs, string_split_regex(text, '{pat.replace('(', '(?:', 1) if kind != 'assign' else pat.replace('([A', '(?:[A')}') AS ps FROM t"
        for k, (kind, pat, least) in enumerate(kinds)
    )
    return f"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
    e AS ({each}),
    keep AS (
      SELECT r, k, kind, m, g, least,
             list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
      FROM (SELECT *, ms[i] AS m, gs[i] AS g FROM (SELECT *, unnest(list_filter(range(1, len(ms) + 1), lambda i: length(gs[i]) >= least)) AS i FROM e))),
    spans AS (SELECT r, k, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS span FROM keep),
    agg AS (
      SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM spans GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN agg USING (r)"""


ORACLE_SQL = _sql()
