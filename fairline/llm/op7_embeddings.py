"""Embedding near-duplicates by a pivot-permutation index.

Reference points are a bounded sample of the vectors, thinned so that no two are close. Each vector is described by its
nearest reference points in order; inverted lists hold the vectors by reference point. Two vectors that share two or more
of their nearest points are candidates: the lists are kept per pair of points, so that "shares two" is one equality, and
each candidate pair is counted once, in the list of its two smallest shared points. Candidates are verified by their
cosine in double precision. Large lists are cut into block pairs; a task returns counts and one link to the smallest
linked vector per member, never all pairs of a group. Equal vectors are one node with a multiplicity. Vectors of each
length are compared among themselves: lengths with more than a block of vectors have reference points of their own, of
the others all vectors share one list.

Index parameters: reference points ~ sqrt(rows), 64 to 4096, from a sample of 8 times as many vectors chosen by hash;
prefix 7. Recall against brute force is measured in the tests; every row is indexed.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
different lengths; a row with a null vec_id takes no part (n_links 0, null component, not kept); repeated rows are vectors of their
own and link with each other; an empty table gives no rows; extra columns, labels included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import components, source, table
from fairline.llm.groups import block_pairs, runs


def _nodes(vectors: DataFrame) -> DataFrame:
    """vec_id, code: the unit vector in double precision as bytes; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = np.array(v.as_py() or (), dtype=object)
                if not len(x) or any(c is None for c in x):
                    out.append(None)
                    continue
                x = x.astype(np.float64)
                top = np.abs(x).max()
                if not np.isfinite(x).all() or top == 0:
                    out.append(None)
                    continue
                x = x / top  # no overflow in the norm
                out.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "code"])

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return some.mapInArrow(run, "vec_id long, code binary")


def reference_points(classes: DataFrame, n: int, most: int = 4096, apart: float = 0.6) -> np.ndarray:
    """Up to ~sqrt(n) unit vectors, no two of which have a cosine over `apart`, from a sample of 8 times as many."""
    wanted = min(most, max(64, ceil(sqrt(n))))
    sample = classes.select("code").orderBy(F.xxhash64("code"), "code").limit(8 * wanted).collect()
    points = np.stack([np.frombuffer(r["code"], np.float64) for r in sample])
    nearest, chosen = np.full(len(points), -1.0), []
    for i in range(len(points)):
        if len(chosen) < wanted and nearest[i] <= apart:
            chosen.append(i)
            nearest = np.maximum(nearest, points @ points[i])
    return points[chosen]


def near_duplicates(vectors: DataFrame, least: float = 0.9, prefix: int = 7, block_rows: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links are pairs found with a cosine of `least` or more."""
    spark = vectors.sparkSession
    rows = table(_nodes(vectors), "vec-codes")
    use = rows.filter("vec_id is not null and code is not null")
    if use.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    classes = table(use.groupBy("code").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first")), "vec-classes")
    # bytes of a vector -> reference points; only lengths with more than a block of distinct vectors, in practice one or a few
    large = classes.groupBy(F.length("code").alias("n")).count().filter(F.col("count") > block_rows).orderBy("n").collect()
    points = spark.sparkContext.broadcast({r["n"]: reference_points(classes.filter(F.length("code") == r["n"]), r["count"]) for r in large})  # bounded by the samples

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(c.as_py()) for c in batch.column(0)])
            for n in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == n))
                p = points.value.get(n)
                if p is None:  # few vectors of this length: one list
                    near = np.full((part.num_rows, 2), -1, np.int32)
                else:
                    x = np.frombuffer(b"".join(part.column(0).to_pylist()), np.float64).reshape(part.num_rows, -1)
                    keep = min(prefix, len(p))
                    near = np.sort(np.argpartition(-(x @ p.T), keep - 1, axis=1)[:, :keep].astype(np.int32), axis=1)
                    if keep < 2:
                        near = np.repeat(near, 2, axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["code", "copies", "node", "near"])

    indexed = classes.select("code", "copies", F.xxhash64("code").alias("node")).mapInArrow(describe, "code binary, copies long, node long, near array<int>")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("near") - 1), lambda j: F.transform(F.slice("near", 1, j), lambda a: F.struct(a.alias("p"), F.get("near", j).alias("q")))))
    # the lists: a row per vector and pair of its nearest points
    lists = table(indexed.withColumn("key", F.explode(pairs)).select(F.length("code").alias("n"), "key.p", "key.q", "node", "copies", "near", "code"), "vec-lists")
    keys = ["n", "p", "q", "bi", "bj"]
    dealt = block_pairs(lists, ["n", "p", "q"], F.col("node"), block_rows)
    dealt = dealt.select(*keys, "own", "node", "copies", "near", "code").repartition(*keys).sortWithinPartitions(*keys)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, keys):
            get = lambda c: g.column(g.schema.get_field_index(c))  # noqa: E731, B023
            x = np.frombuffer(b"".join(get("code").to_pylist()), np.float64).reshape(g.num_rows, -1)
            node, copies, own = (get(c).to_numpy() for c in ("node", "copies", "own"))
            near = np.array(get("near").to_pylist(), np.int64)
            p, q, same = get("p")[0].as_py(), get("q")[0].as_py(), get("bi")[0].as_py() == get("bj")[0].as_py()
            linked = np.zeros((len(x), len(x)), bool)
            for i in range(0, len(x), 512):
                linked[i : i + 512] = x[i : i + 512] @ x.T >= least
            np.fill_diagonal(linked, False)
            i, j = np.nonzero(linked if same else linked & (own[:, None] != own[None, :]))
            if not len(i):
                continue
            # counted in the list of the two smallest shared points only
            counts = np.zeros(len(x), np.int64)
            for s in range(0, len(i), 1 << 16):
                a, b = near[i[s : s + (1 << 16)]], near[j[s : s + (1 << 16)]]
                common = (a[:, :, None] == b[:, None, :]).any(2)
                rank = np.cumsum(common, axis=1)
                first = a[np.arange(len(a)), np.argmax(common & (rank == 1), axis=1)]
                second = a[np.arange(len(a)), np.argmax(common & (rank == 2), axis=1)] if p != q else first
                mine = (first == p) & (second == q)
                np.add.at(counts, i[s : s + (1 << 16)][mine], copies[j[s : s + (1 << 16)][mine]])
            label = np.arange(len(x))
            while True:  # smallest member reachable inside the task
                low = label.copy()
                np.minimum.at(low, i, label[j])
                low = low[low]
                if (low == label).all():
                    break
                label = low
            told = np.flatnonzero((counts > 0) | (label != np.arange(len(x))))
            if len(told):
                yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(counts[told]), pa.array(node[label[told]])], names=["node", "links", "other"])

    found = table(dealt.mapInArrow(verify, "node long, links long, other long"), "vec-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    labelled = classes.select("code", "copies", "first", F.xxhash64("code").alias("node")).join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = labelled.join(smallest, "component").select("code", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(labelled, (rows["code"] == labelled["code"]) & rows["vec_id"].isNotNull(), "left").drop("code")
    out = out.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(source(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS low FROM embeddings UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.node WHERE c.low < p.b),
l AS (SELECT node, min(low) AS low FROM c GROUP BY node),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT vec_id, coalesce(n.k, 0) AS n_links, l.low AS component_id, vec_id = l.low AS kept
FROM embeddings LEFT JOIN l ON l.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
