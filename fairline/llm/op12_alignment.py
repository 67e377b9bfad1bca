"""Alignment of two tokenizers over the same bytes by merge-path partitioning.

The ends of the A and of the B tokens of a run of documents are two sorted lists over one byte axis. Their merge is cut
by diagonals: a binary search on each finds how many ends of either list come before it, so the pieces hold equally many
ends and none needs another to begin. A piece emits its overlaps, one for each distinct end (the stretch up to it lies in
one A and one B token), and the ends that both lists share. An equal end on both sides of a diagonal is emitted once: the
piece looks at the last A end before it. Groups are the tokens between two shared ends; those that reach over a diagonal
are stitched from the pieces' shared ends.

The corpus part works on blocks: runs of documents with a bounded number of links, one row each, with the block's
distinct id pairs and in how many of its documents they are linked. Counts are sums over blocks, a block asks only for its
own distinct pairs, and its documents refer to them by their place in the block: what moves is a fraction of the links.

Cases: texts that are null or empty, or that either tokenizer does not give back byte by byte, have no tokens and zeros;
strings of special tokens are plain text; repeated rows count as documents of their own; null ids stay; an empty table
gives no rows; texts of any length are aligned whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import small_batches, source, table, worker_cache

_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PIECE = 1 << 16  # ends in a piece of the merge
SHARD_CHARS = 2_000_000  # of texts that are aligned together
BLOCK_PAIRS = 4_000_000  # linked pairs of a block's documents, from which on the block is closed
MARK = "▁"
# Letters whose class no Unicode version changes, in words and gaps of ordinary length: there both libraries split alike.
_UNUSUAL = re.compile(r"[^\x00-\u024f]|\s{200}|[^\s]{2000}")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 ones are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_vocabulary(tokenizer) -> list[bytes]:
    letters = byte_letters()
    out = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        out[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
    return out


def piece_vocabulary(sp) -> list[bytes]:
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]


def diagonal(a: np.ndarray, b: np.ndarray, d: int) -> int:
    """How many of the first d ends of the merge are of a; a goes first at equal ends."""
    low, high = max(0, d - len(b)), min(d, len(a))
    while low < high:
        mid = (low + high) // 2
        if a[mid] <= b[d - mid - 1]:
            low = mid + 1
        else:
            high = mid
    return low


def cuts(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    total = len(a) + len(b)
    return [(i, d - i) for d in [*range(0, total, size), total] for i in [diagonal(a, b, d)]]


def overlaps(a: np.ndarray, b: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: numbers of the overlapping tokens of a and b, and of the token pairs that end together."""
    (i0, j0), (i1, j1) = start, end
    own_a, own_b = a[i0:i1], b[j0:j1]
    at_a = np.arange(i0, i1)
    b_of_a = j0 + np.searchsorted(own_b, own_a)
    shared = (b_of_a < len(b)) & (b[np.minimum(b_of_a, len(b) - 1)] == own_a)
    before = i0 + np.searchsorted(own_a, own_b, "right")  # ends of a up to this end of b
    alone = (before == 0) | (a[np.maximum(before - 1, 0)] != own_b)
    return np.concatenate([at_a, before[alone]]), np.concatenate([b_of_a, np.arange(j0, j1)[alone]]), at_a[shared], b_of_a[shared]


class Aligner:
    """Two tokenizers, read from the bytes of their files, and the tables that the group texts need."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.a_bytes, self.b_bytes = byte_vocabulary(self.a), piece_vocabulary(self.b)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        # id and what follows it: within a list a comma, at its end a bar or a semicolon
        self.told = np.array([f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|"] + [f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",;"], object)
        self.fast = self._ranked()

    def _ranked(self):
        """The same vocabulary in a faster library, if the ids of the file follow its merges; None otherwise."""
        import json

        import public_tokenizers
        import tiktoken

        spec = json.loads(self.a.to_str())
        letters, model, special = byte_letters(), spec["model"], {t["content"] for t in spec["added_tokens"]}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
        own = {k: v for k, v in model["vocab"].items() if k not in special}
        if not spec["pre_tokenizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["normalizer"] or len(own) != 256 + len(merges) or any(own.get(m) != 256 + i for i, m in enumerate(merges)):
            return None
        return tiktoken.Encoding("aligned", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(letters[c] for c in k): v for k, v in own.items()}, special_tokens={})

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None and not _UNUSUAL.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none where a text is not given back."""
        of_a, of_b = [], self.b.encode([t or "" for t in texts], num_threads=1)
        for k, text in enumerate(texts):
            ids = self.encode_a(" " + text) if text else []
            whole = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            good = text and b"".join([self.a_bytes[i] for i in ids]) == whole and b"".join([self.b_bytes[i] for i in of_b[k]]) == whole
            of_a.append(ids if good else [])
            of_b[k] = of_b[k] if good else []
        return of_a, of_b

    def align(self, texts: list[str | None], piece: int = PIECE) -> Aligned:
        of_a, of_b = self.tokens(texts)
        sizes_a, sizes_b = ([0, *(len(x) for x in of)] for of in (of_a, of_b))
        ids_a, ids_b = (np.fromiter((i for x in of for i in x), np.int64, sum(n)) for of, n in ((of_a, sizes_a), (of_b, sizes_b)))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        at = cuts(ends_a, ends_b, piece)
        parts = [overlaps(ends_a, ends_b, x, y) for x, y in zip(at, at[1:], strict=False)] or [(np.empty(0, np.int64),) * 4]
        return Aligned(ids_a, ids_b, np.cumsum(sizes_a), np.cumsum(sizes_b), *(np.concatenate(x) for x in zip(*parts, strict=True)))


@dataclass
class Aligned:
    """Texts side by side: ids, places of the texts in them, links (token numbers), last tokens of every group."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    def numbers(self) -> tuple[np.ndarray, ...]:
        """Per text: tokens of a, tokens of b, groups, links."""
        text = np.searchsorted(self.a_at, self.link_a, "right") - 1
        groups = np.searchsorted(self.last_a, self.a_at)
        return np.diff(self.a_at), np.diff(self.b_at), np.diff(groups), np.bincount(text, minlength=len(self.a_at) - 1)

    def group_texts(self, told: np.ndarray, a_entries: int) -> list[str]:
        """Per text its groups `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        is_last_a, is_last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        is_last_a[self.last_a], is_last_b[self.last_b] = 1, 1
        group_a, group_b = np.cumsum(is_last_a) - is_last_a, np.cumsum(is_last_b) - is_last_b
        b_before = np.concatenate([[0], self.last_b + 1])
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + b_before[group_a]] = self.a * 2 + is_last_a
        code[np.arange(len(self.b)) + (self.last_a + 1)[group_b]] = 2 * a_entries + self.b * 2 + is_last_b
        at = (self.a_at + self.b_at).tolist()
        return ["".join(told[code[x:y]].tolist())[:-1] for x, y in zip(at, at[1:], strict=False)]

    def linked_pairs(self, b_entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct id pairs of every text, by text: how many each text has, pairs as a * b_entries + b, links of each."""
        text = np.searchsorted(self.a_at, self.link_a, "right") - 1
        width = np.int64(1) << np.int64(34)
        keys, links = np.unique(text * width + self.a[self.link_a] * b_entries + self.b[self.link_b], return_counts=True)
        return np.bincount(keys // width, minlength=len(self.a_at) - 1), keys % width, links


def shards(lengths: list[int], most: int = SHARD_CHARS) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


@dataclass(frozen=True)
class Files:
    """The two tokenizer files as bytes: bounded by their vocabularies, sent to the tasks once."""

    a: bytes
    b: bytes

    @classmethod
    def read(cls, a_path: str, b_path: str) -> Files:
        with open(a_path, "rb") as a, open(b_path, "rb") as b:
            return cls(a.read(), b.read())


def _aligner(shared) -> Aligner:
    cache = worker_cache()
    if "aligner" not in cache or cache["aligner"][0] != (files := shared.value):
        files = shared.value
        cache["aligner"] = (files, Aligner(files["a"], files["b"]))
    return cache["aligner"][1]


def _shared(spark: SparkSession, files: Files):
    return spark.sparkContext.broadcast({"a": files.a, "b": files.b})


def groups(docs: DataFrame, files: Files, key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links and groups, the text of all groups (null without tokens)."""
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, files)
    some = docs.select(key, "text")
    names = [key, *_COUNTS, "groups"]
    schema = f"`{key}` {some.schema[0].dataType.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in shards([len(t or "") for t in texts]):
                got = aligner.align(texts[x:y])
                told = [t or None for t in got.group_texts(aligner.told, len(aligner.a_bytes))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[x:y], *(pa.array(n, pa.int64()) for n in got.numbers()), pa.array(told, pa.string())], names=names)

    return some.mapInArrow(run, schema)


def blocks(docs: DataFrame, files: Files, key: str = "doc_id", most_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """A row per block of documents, written to the shared folder.

    keys, counts and digests of the group texts of its documents; sizes (distinct pairs a document), places (of these
    pairs in pairs) and links (of each), both compressed; pairs, the block's distinct pairs, and held, documents of each.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, files)
    some = docs.select(key, "text")
    kind = some.schema[0].dataType.simpleString()
    fields = {"block": "long", "keys": f"array<{kind}>"} | dict.fromkeys(_COUNTS, "array<long>")
    fields |= {"digests": "array<string>", "sizes": "array<long>", "places": "binary", "links": "binary", "pairs": "array<long>", "held": "array<long>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        aligner, pack = _aligner(shared), zstandard.ZstdCompressor(level=3)
        number, open_ = TaskContext.get().partitionId() << 32, []

        def closed() -> pa.RecordBatch:
            keys, counts, digests, sizes, pairs, links = zip(*open_, strict=True)
            pairs = np.concatenate(pairs)
            distinct, places, held = np.unique(pairs, return_inverse=True, return_counts=True)
            steps = np.diff(places.astype(np.int32), prepend=np.int32(0))
            lists = [pa.concat_arrays(keys), *(np.concatenate(c) for c in zip(*counts, strict=True)), [d for x in digests for d in x], np.concatenate(sizes)]
            blobs = [pa.array([pack.compress(x.tobytes())], pa.binary()) for x in (steps, np.concatenate(links).astype(np.int32))]
            wrap = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, t))
            arrays = [pa.array([number], pa.int64()), wrap(lists[0], None), *(wrap(c, pa.int64()) for c in lists[1:5]), wrap(lists[5], pa.string()), wrap(lists[6], pa.int64()), *blobs, wrap(distinct, pa.int64()), wrap(held, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=list(fields))

        waiting = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x, y in shards([len(t or "") for t in texts]):
                got = aligner.align(texts[x:y])
                sizes, pairs, links = got.linked_pairs(len(aligner.b_bytes))
                digests = [sha256(t.encode()).hexdigest() if t else "" for t in got.group_texts(aligner.told, len(aligner.a_bytes))]
                open_.append((batch.column(0)[x:y], got.numbers(), digests, sizes, pairs, links))
                waiting += len(pairs)
                if waiting >= most_pairs:
                    yield closed()
                    number, open_, waiting = number + 1, [], 0
        if open_:
            yield closed()

    return table(some.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items())), "aligned-blocks")


def pair_counts(held: DataFrame, b_entries: int) -> DataFrame:
    """a, b, pair, docs (documents that hold the id pair linked) and best (no pair of its a has more), in the shared folder."""
    one = held.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("docs"))
    one = table(one.withColumns({"a": F.expr(f"pair div {b_entries}"), "b": F.col("pair") % b_entries}), "aligned-counts")
    return one.join(one.groupBy("a").agg(F.max("docs").alias("most")), "a").select("a", "b", "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(held: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document its numbers, n_best (links whose pair is a best one) and count_sum (docs summed over its links)."""
    answers = held.select(F.col("block").alias("of"), F.explode("pairs").alias("pair")).join(counts.select("pair", "docs", "best"), "pair").select("of", "pair", "docs", "best")

    def run(block: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        one, unpack = block.iloc[0], zstandard.ZstdDecompressor()
        places = np.cumsum(np.frombuffer(unpack.decompress(one["places"]), np.int32))
        links = np.frombuffer(unpack.decompress(one["links"]), np.int32).astype(np.int64)
        known = known.sort_values("pair")
        at = np.concatenate([[0], np.cumsum(one["sizes"])]).astype(np.int64)
        out = {"key": one["keys"]} | {c: one[c] for c in _COUNTS}
        for name, column in (("n_best", "best"), ("count_sum", "docs")):
            total = np.concatenate([[0], np.cumsum(known[column].to_numpy(np.int64)[places] * links)]) if len(places) else np.zeros(1, np.int64)
            out[name] = total[at[1:]] - total[at[:-1]]
        return pd.DataFrame(out | {"digest": one["digests"]})

    kind = held.schema["keys"].dataType.elementType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, digest string"
    return held.drop("pairs", "held").groupBy("block").cogroup(answers.groupBy("of")).applyInPandas(run, schema).withColumnRenamed("key", key)


def default_files() -> Files:
    import public_tokenizers

    return Files.read(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = default_files()
    held = blocks(source(spark, sf_dir, "documents"), files)
    counts = table(pair_counts(held, entries(files)), "aligned-pairs")
    return scored(held, counts).withColumnRenamed("digest", "groups_sha256")


def entries(files: Files) -> int:
    """Size of the B vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()
