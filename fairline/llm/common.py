"""Shared helpers: tables in the shared folder, hashed words, learning splits, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import fields
from weakref import WeakKeyDictionary

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SCRATCH: dict[str, str] = {}
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()  # of the frames that table() returned


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir; a temporary one only in local runs without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="fairline-llm-")
    return _SCRATCH[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: Arrow batches of 1000 rows, unless the caller has set another number than Spark's default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


# Spark's own switch for removing the shuffle files of a query as soon as it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, lineage cut, columns pruned on reading.

    Once it is written nobody reads the shuffle files behind it any more: with tidy they go at once, not with the driver's garbage.
    """
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLE_CLEANUP, "false")
    conf.set(_SHUFFLE_CLEANUP, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_SHUFFLE_CLEANUP, before)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[written] = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables that table() wrote, once all that reads them has been written itself. Other frames are left alone."""
    for df in written:
        folder = _FOLDERS.pop(df, None)
        if folder is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast behind a counted bound; beyond it the join is Spark's own choice."""
    return F.broadcast(df) if df.count() <= most_rows else df


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo: decides which rows may be learned from. A null key gives 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0)) % modulus


def plain(model) -> dict | None:
    """The fields of a dataclass as plain values, which every worker can read."""
    return None if model is None else {f.name: getattr(model, f.name) for f in fields(model)}


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker: functions of this package may reach it anew for every task."""
    return sys.__dict__.setdefault("fairline_worker_cache", {})


def let_go(name: str) -> None:
    """Empty what another operator keeps in this worker under the name: a task that has no use for it needs the executor's memory itself."""
    worker_cache().get(name, {}).clear()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that hashes sort like random numbers."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def pieces(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """Cut bytes into pieces that end at white space, so that very long texts need bounded memory."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[start:end]
        start = end


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() and bytes.split() know ASCII only
    parts = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) for words in (p.split() for p in pieces(data))]
    return np.concatenate(parts) if len(parts) != 1 else parts[0]


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words the whole sequence is one; without words none."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(k, len(w))
    acc = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            acc = mix(acc * GOLDEN + w[i : len(w) - n + 1 + i])
    return np.unique(acc)


def components(edges: DataFrame, cap_rounds: int = 60, tidy: bool = False) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component = smallest node reachable.

    Alternating large-star and small-star rounds; every round is one map-side combined minimum and one join, written
    to the shared folder, and hot nodes are split by the skew join. Ends when a round changes nothing.
    """
    def key_sums(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        return r["n"], r["s"]

    e = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", tidy)
    state = key_sums(e)
    for _ in range(cap_rounds):
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the node itself go to the smallest of them
        large = large.filter("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, table(small, "cc", tidy)
        discard(before)
        now = key_sums(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def persist(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)
