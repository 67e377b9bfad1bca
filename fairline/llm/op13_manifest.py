"""Merkle manifest of a dataset as postorder append logs.

Rows are leaves; every two consecutive nodes of a level become one (a last single one as well) until one remains, per
group and then over the groups. Aligned builders take 2^height consecutive nodes each, so that whole subtrees fall to one
builder, which writes its nodes in the order in which they are completed. A node that ends at leaf e, l levels up, is the
(2e - ones(e) + l)-th of its log: the sizes of the subtrees before it say where it is, so siblings are read by position
without any search or pointer. The tops of the builders are the leaves of the next round; a proof is what the builders
on the way from the leaf to the root hold beside it. Rounds grow with the logarithm of the rows, a builder's memory with
2^height only, and the proof of a builder's top is made once for all its leaves.

Order within a group: id ascending, null first; rows that repeat an id follow by their digest, so equal rows are
interchangeable. They are ranked by a range partitioning that also holds a row number, so neither a group with most of the
rows nor many copies of one row meet in a task.

Cases: null columns, also a null id or group, are hashed as `-`; the null group comes first; empty texts have length 0;
an empty table gives no rows; rows of any length are hashed whole by Spark's sha2; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairline.llm.common import source, table

HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_MODULUS = 7
WIDTH = 32  # bytes of a digest
LEFT, RIGHT, ALONE = b"<", b">", b"|"  # where the sibling of a step stands


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def parent(*nodes: bytes) -> bytes:
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels(n: int) -> int:
    """Steps from n nodes to one."""
    return max(n - 1, 0).bit_length()


def position(level: int, index: int, n: int) -> int:
    """Where the node stands in the log of a tree of n leaves."""
    end = min((index + 1) << level, n) - 1
    return 2 * end - end.bit_count() + level


def siblings(index: int, n: int, height: int) -> list[tuple[bytes, int]]:
    """Side and log position of the sibling at each step from a leaf upwards."""
    out = []
    for level in range(height):
        other = (index >> level) ^ 1
        alone = other << level >= n
        out.append((ALONE, -1) if alone else (LEFT if other < index >> level else RIGHT, position(level, other, n)))
    return out


def grown(leaves: list[bytes], height: int) -> list[bytes]:
    """All nodes over the leaves in completion order; the right edge climbs to the height."""
    log, waiting, last = [], [], len(leaves) - 1
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        while level < height and (i >> level & 1 or i == last):
            node = parent(waiting.pop(), node) if i >> level & 1 else parent(node)
            log.append(node)
            level += 1
        waiting.append(node)
    return log


def steps(nodes: bytes, index: int, n: int, height: int) -> bytes:
    """The way from a leaf of a builder to its top: a side per step, followed by the sibling if there is one."""
    return b"".join(side + nodes[at * WIDTH : (at + 1) * WIDTH] if at >= 0 else side for side, at in siblings(index, n, height))


def walked(way: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(way):
        side = way[at : at + 1]
        more = 0 if side == ALONE else WIDTH
        yield side, way[at + 1 : at + 1 + more]
        at += 1 + more


def folded(node: bytes, way: bytes) -> bytes:
    for side, other in walked(way):
        node = parent(node) if side == ALONE else parent(other, node) if side == LEFT else parent(node, other)
    return node


def ranked(df: DataFrame, tree: str, by: list[str], name: str) -> DataFrame:
    """Adds idx (place within the tree in the order of by) and n (rows of the tree); tree is a column without nulls.

    Sorted ranges number their rows; rows per tree and range are then few, and their running sum gives each range's start.
    """
    order = [tree, *by, "copy"]
    numbered = df.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = table(numbered.drop("copy").withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"start": F.coalesce(F.sum("held").over(before), F.lit(0)), "n": F.sum("held").over(Window.partitionBy(tree))})
    return rows.join(spans, [tree, "part"]).withColumn("idx", F.col("start") + F.col("at") - F.col("first")).drop("at", "part", "first", "held", "start")


def _segment_height(n: int, chunk: int, height: int) -> tuple[int, int]:
    """Leaves and steps of a builder: the last one holds the rest; a tree of one builder ends at its root."""
    held = min(n - (chunk << height), 1 << height)
    return held, levels(n) if n <= 1 << height else height


def build(entries: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Logs of all trees, a table per round: tree, chunk (builder), n (its tree's leaves in this round), total (in the first), nodes.

    entries: tree, idx, n, digest. nodes holds the builder's digests in completion order, its top last.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        n, chunk = int(first["n"]), int(first["chunk"])
        nodes = grown(list(pdf.sort_values("idx")["digest"]), _segment_height(n, chunk, height)[1])
        return pd.DataFrame({"tree": [first["tree"]], "chunk": [chunk], "n": [n], "total": [int(first["total"])], "nodes": [b"".join(nodes)]})

    rounds: list[DataFrame] = []
    level = entries.select("tree", "idx", "n", F.col("n").alias("total"), "digest")
    while True:
        grouped = level.withColumn("chunk", F.shiftright("idx", height)).groupBy("tree", "chunk")
        rounds.append(table(grouped.applyInPandas(run, "tree string, chunk long, n long, total long, nodes binary"), f"{name}-{len(rounds)}"))
        rest = rounds[-1].filter(F.col("n") > 1 << height)
        if rest.isEmpty():
            return rounds
        level = rest.select("tree", F.col("chunk").alias("idx"), F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"), "total", _top().alias("digest"))


def _top() -> Column:
    return F.substring("nodes", -WIDTH, WIDTH)


def roots(rounds: list[DataFrame], height: int) -> DataFrame:
    """tree, digest of its root."""
    return reduce(DataFrame.union, [r.filter(F.col("n") <= 1 << height).select("tree", _top().alias("digest")) for r in rounds])


def ways(rounds: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """tree, chunk, way: from each builder of the first round to the root, and on by above (tree, way) beyond it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tree, chunk, n, nodes, way in zip(pdf["tree"], pdf["chunk"], pdf["n"], pdf["nodes"], pdf["way"], strict=True):
                held, climb = _segment_height(n, chunk, height)
                yield pd.DataFrame({"tree": tree, "chunk": [(chunk << height) + i for i in range(held)], "way": [steps(nodes, i, held, climb) + way for i in range(held)]})

    below: DataFrame | None = None
    for r, segments in reversed(list(enumerate(rounds))):
        here = segments.filter(F.col("n") <= 1 << height).join(above, "tree").select("tree", "chunk", "way")
        here = here if below is None else here.union(below)
        if r:
            below = segments.join(here, ["tree", "chunk"]).select("tree", "chunk", "n", "nodes", "way").mapInPandas(run, "tree string, chunk long, way binary")
    return here


def append_log(rounds: list[DataFrame], height: int) -> DataFrame:
    """tree, position, digest: the whole log of every tree, a row per node."""
    runs = []
    for r, segments in enumerate(rounds):

        def run(batches: Iterator[pd.DataFrame], base: int = r * height, low: int = 1 if r else 0) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for tree, chunk, n, total, nodes in zip(pdf["tree"], pdf["chunk"], pdf["n"], pdf["total"], pdf["nodes"], strict=True):
                    held, climb = _segment_height(n, chunk, height)
                    out = []
                    for level in range(low, climb + 1):
                        for i in range(-(-held >> level)):
                            at = position(level, i, held) * WIDTH
                            out.append((tree, position(base + level, (chunk << height >> level) + i, total), nodes[at : at + WIDTH]))
                    yield pd.DataFrame(out, columns=["tree", "position", "digest"])

        runs.append(segments.mapInPandas(run, "tree string, position long, digest binary"))
    return reduce(DataFrame.union, runs)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", altered: dict[str, Column] | None = None, tampered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, proof (the siblings' digests from leaf to root), folded, all as binary.

    folded is the root that the siblings give for the leaf; where tampered holds, for the leaf of the altered values.
    """
    values = [F.col(f) for f in fields]
    other = F.when(F.coalesce(tampered, F.lit(False)), row_digest([(altered or {}).get(f, F.col(f)) for f in fields])) if tampered is not None else F.lit(None).cast("binary")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = table(docs.select(tree.alias("tree"), F.col(key).alias("key"), row_digest(values).alias("digest"), other.alias("other")), "manifest-leaves")
    placed = ranked(leaves, "tree", ["key", "digest"], "manifest-order")
    rounds = build(placed, height, "manifest-log")
    subroots = roots(rounds, height)
    groups = table(ranked(subroots.withColumn("whole", F.lit("")), "whole", ["tree"], "manifest-groups"), "manifest-groups")
    upper = build(groups.select(F.lit("").alias("tree"), "idx", "n", "digest"), height, "manifest-top")
    ends = roots(upper, height).first()
    root = bytes(ends["digest"]) if ends else b""
    start = docs.sparkSession.createDataFrame([("", bytearray())], "tree string, way binary")
    tops = ways(upper, start, height)  # from the builders over the groups; their groups follow
    held = upper[0].join(tops, ["tree", "chunk"])

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, n, nodes, way in zip(pdf["chunk"], pdf["n"], pdf["nodes"], pdf["way"], strict=True):
                m, climb = _segment_height(n, chunk, height)
                yield pd.DataFrame({"idx": [(chunk << height) + i for i in range(m)], "way": [steps(nodes, i, m, climb) + way for i in range(m)]})

    above = table(held.select("chunk", "n", "nodes", "way").mapInPandas(spread, "idx long, way binary").join(groups.select("idx", "tree", F.col("digest").alias("subroot")), "idx").drop("idx"), "manifest-above")
    segments = rounds[0].join(ways(rounds, above.select("tree", "way"), height), ["tree", "chunk"]).join(above.select("tree", "subroot"), "tree")
    key_type = docs.schema[key].dataType.simpleString()

    def prove(rows: pd.DataFrame, segment: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in ("key", "leaf", "subroot", "root", "proof", "folded")})
        s = segment.iloc[0]
        nodes, way, chunk = s["nodes"], s["way"], int(s["chunk"])
        m, climb = _segment_height(int(s["n"]), chunk, height)
        beyond = b"".join(other for _, other in walked(way))
        known: dict[bytes, bytes] = {}  # what a builder's top folds to; the same for all its leaves that were left alone
        proofs, roots_seen = [], []
        for idx, digest, changed in zip(rows["idx"], rows["digest"], rows["other"], strict=True):
            own = steps(nodes, int(idx) - (chunk << height), m, climb)
            proofs.append(b"".join(x for _, x in walked(own)) + beyond)
            top = folded(digest if changed is None else changed, own)
            if top not in known:
                known[top] = folded(top, way)
            roots_seen.append(known[top])
        return pd.DataFrame({"key": rows["key"], "leaf": rows["digest"], "subroot": s["subroot"], "root": root, "proof": proofs, "folded": roots_seen})

    left = placed.withColumn("chunk", F.shiftright("idx", height)).select("tree", "chunk", "idx", "key", "digest", "other").groupBy("tree", "chunk")
    return left.cogroup(segments.groupBy("tree", "chunk")).applyInPandas(prove, f"key {key_type}, leaf binary, subroot binary, root binary, proof binary, folded binary").withColumnRenamed("key", key)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    more = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    out = manifest(docs, altered=more, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_MODULUS == 0)
    shown = lambda c: F.lower(F.hex(c))
    return out.select(
        "doc_id", shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        F.sha2(shown("proof"), 256).alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def _field(name: str, expr: str | None = None) -> str:
    return f"coalesce(strlen(CAST({expr or name} AS VARCHAR)) || ':' || CAST({expr or name} AS VARCHAR), '-')"


ORACLE_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS c
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
hashed AS (
  SELECT doc_id, lang, sha256({' || '.join(_field(f) for f in FIELDS)}) AS leaf,
         CASE WHEN c % {TAMPERED_MODULUS} = 0 THEN sha256({' || '.join(_field(f, 'CAST(n_chars AS HUGEINT) + 1' if f == 'n_chars' else None) for f in FIELDS)}) END AS other
  FROM documents d LEFT JOIN crc USING (doc_id)),
leaves AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, leaf, coalesce(other, leaf) AS shown, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
low AS (
  SELECT tree, 0 AS lvl, i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lvl, i // 2, n),
groups AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, i, h, n FROM groups
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, i // 2, n),
way AS (
  SELECT tree, doc_id, leaf, i AS own, 0 AS lvl, i, n, shown AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.tree, w.doc_id, w.leaf, own, w.lvl + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END), proof || coalesce(s.h, '')
  FROM way w LEFT JOIN low s ON s.tree = w.tree AND s.lvl = w.lvl AND s.i = xor(w.i, 1) WHERE w.n > 1),
on_top AS (
  SELECT w.tree, w.doc_id, w.leaf, own, 0 AS lvl, g.i, g.n, w.h, proof FROM way w JOIN groups g USING (tree) WHERE w.n = 1
  UNION ALL
  SELECT w.tree, w.doc_id, w.leaf, own, w.lvl + 1, w.i // 2, (w.n + 1) // 2, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.i % 2 = 0 THEN w.h || s.h ELSE s.h || w.h END), proof || coalesce(s.h, '')
  FROM on_top w LEFT JOIN high s ON s.lvl = w.lvl AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT doc_id, leaf, g.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM on_top w JOIN groups g USING (tree) CROSS JOIN (SELECT h FROM high WHERE n = 1) r WHERE w.n = 1"""
