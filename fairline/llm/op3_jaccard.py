"""Word n-gram Jaccard join by vertical partitioning.

The global order of n-grams is cut into fragments; every document's set falls into one segment per fragment, overlaps
of two documents are counted per fragment in separate tasks, and the partial counts are summed per pair.

1. A count sketch of fixed width over all n-grams gives the order: rare ones by hash first, then the frequent ones by
   the logarithm of their count. (Any fixed order is right; this one keeps shared passages out of the prefixes.)
2. Each document keeps its prefix (the first n - ceil(t n) + 1 n-grams of the order: two linked documents share one) and
   the parities of the sizes of 4n to 8n fine cells: cells of different parity bound the difference of two sets from
   below, so most pairs under the threshold go before any overlap is counted.
3. First round: per prefix n-gram each document is paired with the n-gram's hub only, the member with the largest part
   of its prefix shared (hot n-grams are salted and their sub-groups' hubs paired), and of a document's pairs the one
   with most shared n-grams is verified. The links' connected components follow.
4. Second round: n-grams whose members lie in two or more components give the pairs across components that pass the
   length and parity bounds, each about once; large groups are cut into block pairs. Of two components the closest pair is verified
   first, and the other pairs only if it is no link. Pairs inside one component or between linked ones need no check,
   so a group of copies never becomes all its pairs, and no link between components is lost.

Cases: words are runs of other than \\x20 and \\x09-\\x0D with A-Z lower-cased; a text of fewer than k words is one
n-gram; a null text or one without words has an empty set, links with nothing and is its own component; a row with a
null doc_id gets its n_shingles and a null component; repeated rows come back each; equal sets are one node; an empty
table gives no rows; extra columns are not read. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from fairline.llm import common
from fairline.llm.common import discard, fits, let_go, mix, shingle_hashes, small_batches, source
from fairline.llm.groups import block_pairs, runs

table = partial(common.table, tidy=True)
components = partial(common.components, tidy=True)
SKETCH_BITS, BLOCK = 22, 4096
COLD_FRAGMENTS, HOT_FRAGMENTS = 6, 2
SALTS, HOT = 64, 1 << 62
BEFORE = 2  # smaller tokens carried by a row of the second round
FOLD_BITS = 9  # 512 cells, 64 bytes
BITS = np.uint64(16)  # n-grams travel as the upper 48 bits of their hashes


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all n-grams in 2**SKETCH_BITS counters: 16 MB whatever the input, summed by block in tasks."""
    width = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("pieces")  # the chunks of op6
        total, held, size = np.zeros(width, np.uint32), [], 0
        for batch in batches:
            for text in batch.column(0):
                h = shingle_hashes(text.as_py(), k) >> np.uint64(64 - SKETCH_BITS)
                held.append(h.astype(np.int64))
                size += len(h)
                if size > 500_000:
                    total += np.bincount(np.concatenate(held), minlength=width).astype(np.uint32)
                    held, size = [], 0
        if held:
            np.add.at(total, np.concatenate(held), np.uint32(1))
        yield from packed(dict(enumerate(total.reshape(-1, BLOCK))))

    def packed(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        some = [(b, zlib.compress(v.tobytes(), 1)) for b, v in blocks.items() if v.any()]
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int32()), pa.array([v for _, v in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(v), np.uint32)
                total[b] = total[b] + own if b in total else own
        yield from packed(total)

    kind = "block int, counts binary"
    merged = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind)
    counts = np.zeros((width // BLOCK, BLOCK), np.uint32)
    merged = table(merged, "jaccard-sketch")
    for r in merged.collect():  # fixed size: at most width counters
        counts[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    discard(merged)
    return counts.ravel()


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for rare counters; from four times the mean on, one more for every doubling."""
    limit = max(16.0, 4.0 * counts.mean())
    classes = np.zeros(len(counts), np.uint8)
    hot = np.flatnonzero(counts > limit)
    classes[hot] = 1 + np.floor(np.log2(counts[hot] / limit))
    return classes


def ordered(h: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes in the global order, and how many of them are rare."""
    c = classes[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return h[np.argsort(c, kind="stable")], int((c == 0).sum())  # h is sorted already


def fragments(h: np.ndarray, cold: int) -> np.ndarray:
    """Number of the fragment of the global order that each of the ordered hashes lies in."""
    top = h >> np.uint64(32)
    hot = np.arange(len(h)) >= cold
    return np.where(hot, np.uint64(COLD_FRAGMENTS) + (top * np.uint64(HOT_FRAGMENTS) >> np.uint64(32)), top * np.uint64(COLD_FRAGMENTS) >> np.uint64(32)).astype(np.int64)


def pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h >> BITS).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def parities(h: np.ndarray) -> bytes:
    """One bit for each of 2**b cells, 4n to 8n in all: is the number of n-grams in the cell odd?"""
    b = max(6, int(4 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h >> np.uint64(64 - b)).astype(np.int64), minlength=1 << b).astype(np.uint8) & 1).tobytes()


def folded(h: np.ndarray) -> bytes:
    """Parities of FOLD cells whatever the size of the set: coarser, but side by side in one array for many sets."""
    return np.packbits(np.bincount((h >> np.uint64(64 - FOLD_BITS)).astype(np.int64), minlength=1 << FOLD_BITS).astype(np.uint8) & 1).tobytes()


def differ(x: bytes, y: bytes) -> int:
    """A lower bound of the number of n-grams in one set only. The finer parities are added up to the coarser cells."""
    if len(x) < len(y):
        x, y = y, x
    a = np.frombuffer(x, np.uint8)
    while len(a) > len(y):
        a = np.packbits(np.bitwise_xor.reduce(np.unpackbits(a).reshape(-1, 2), axis=1))
    return (int.from_bytes(a.tobytes()) ^ int.from_bytes(y)).bit_count()


def allowed(na, nb, pct: int):
    """Largest difference of two linked sets of these sizes."""
    return (100 - pct) * (na + nb) // (100 + pct)


def set_number(h: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix(mix(h + np.uint64(len(h))).sum(dtype=np.uint64)[None]).view(np.int64)[0])


def _sets(docs: DataFrame, classes, k: int, pct: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, n, set_id; and once per set and task, on a row with a doc_id: parities, folded parities, the packed prefix and the number of rare n-grams in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("pieces")
        own, seen = classes.value, set()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                h = shingle_hashes(text.as_py(), k)
                n = len(h)
                if not n:
                    rows.append((0, None, None, None, None, None))
                    continue
                number = set_number(h)
                if number in seen or not key.is_valid:  # a row without an id is no node: the set's first row with one is
                    rows.append((n, number, None, None, None, None))
                    continue
                if len(seen) < 500_000:
                    seen.add(number)
                p = n + (-pct * n // 100) + 1
                bits, fold = parities(h), folded(h)
                h, cold = ordered(h, own)
                rows.append((n, number, bits, fold, pack(h[:p]), min(cold, p)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    some = docs.select("doc_id", "text", *carry)
    schema = some.drop("text").schema.add("n", "long").add("set_id", "long").add("bits", "binary").add("fold", "binary").add("prefix", "binary").add("n_cold", "integer")
    names = schema.names
    return table(some.mapInArrow(run, schema), "jaccard-sets")


def _tokens(sets: DataFrame) -> DataFrame:
    """(token, set_id) per prefix n-gram; a frequent n-gram carries a mark and a salt in its upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.array([len(x.as_py()) // 6 for x in batch.column(1)])
            token = unpack(b"".join(batch.column(1).to_pylist())).view(np.int64)
            ids = np.repeat(batch.column(0).to_numpy(), sizes)
            at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hot = at >= np.repeat(batch.column(2).to_numpy(), sizes)
            token = np.where(hot, token | HOT | (ids % SALTS << 48), token)
            for i in range(0, len(token), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(token[i : i + (1 << 16)]), pa.array(ids[i : i + (1 << 16)])], names=["token", "set_id"])

    return sets.select("set_id", "prefix", "n_cold").mapInArrow(run, "token long, set_id long")


def _possible(pairs: DataFrame, nodes: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) that the lengths and the parities allow, with the sizes na and nb and the least difference d."""
    a = nodes.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    b = nodes.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    sized = pairs.join(a.drop("xa"), "a").join(b.drop("xb"), "b").filter(f"100 * least(na, nb) >= {pct} * greatest(na, nb)")
    both = sized.join(a.select("a", "xa"), "a").join(b.select("b", "xb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
                most = allowed(get("na").to_numpy(), get("nb").to_numpy(), pct)
                d = np.array([differ(x, y) for x, y in zip(get("xa").to_pylist(), get("xb").to_pylist(), strict=True)], np.int64)
                yield batch.select(kept).append_column("d", pa.array(d)).filter(pa.array(d <= most))

    kept = sized.columns
    return both.select(*kept, "xa", "xb").mapInArrow(run, both.select(*kept, F.lit(0).cast("long").alias("d")).schema)


def _linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, classes, k: int, pct: int, most_broadcast: int, per_salt: int = 20_000) -> DataFrame:
    """Of the pairs (a, b, na, nb) those whose n-gram sets meet the threshold: overlaps per fragment, summed per pair."""
    pairs = pairs.select("a", "b", "na", "nb")
    degree = pairs.select("a").union(pairs.select("b")).groupBy("a").agg(F.count("*").alias("d"))
    turned = (
        pairs.join(degree.withColumnRenamed("d", "da"), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
        .withColumn("swap", (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))))
        .select(F.when(F.col("swap"), F.col("b")).otherwise(F.col("a")).alias("member"), F.when(F.col("swap"), F.col("a")).otherwise(F.col("b")).alias("pivot"),
                F.ceil(F.greatest("da", "db") / per_salt).cast("int").alias("salts"), (F.col("na") + F.col("nb")).alias("both"))
        .withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts").cast("long")).cast("int"))
    )
    turned = table(turned, "jaccard-pairs")
    members = turned.groupBy(F.col("member").alias("set_id")).agg(F.collect_list(F.struct("pivot", "salt")).alias("to"))
    pivots = turned.groupBy(F.col("pivot").alias("set_id")).agg(F.max("salts").alias("salts"))
    asked = table(members.join(pivots, "set_id", "full").join(nodes.select("set_id", "doc"), "set_id").withColumnRenamed("doc", "doc_id"), "jaccard-asked")
    # a checked size decides: the ids asked for go to the texts, or both sides are shuffled
    few = asked.count() <= most_broadcast and turned.count() <= 4 * most_broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(asked) if few else asked, "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = classes.value, set()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for r in batch.to_pylist():
                h = shingle_hashes(r["text"], k)
                number = set_number(h) if len(h) else None
                if number != r["set_id"] or number in seen:
                    continue
                seen.add(number)
                h, cold = ordered(h, own)
                fragment = fragments(h, cold)
                for f in np.unique(fragment):
                    seg = pack(np.sort(h[fragment == f]))
                    out += [(number, s, int(f), 0, number, seg) for s in range(r["salts"] or 0)]
                    out += [(t["pivot"], t["salt"], int(f), 1, number, seg) for t in r["to"] or ()]
                    size += len(seg) * ((r["salts"] or 0) + len(r["to"] or ()))
                if size > 8 << 20:
                    yield rows_of(out)
                    out, size = [], 0
            if out:
                yield rows_of(out)

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["pivot", "salt", "fragment", "role", "member", "seg"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, segment, before = None, np.empty(0, np.uint64), None
        for batch in batches:
            out = []
            for pivot, salt, fragment, role, member, seg in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if role == 0:
                    key, segment, before = (pivot, salt, fragment), unpack(seg), None
                elif key == (pivot, salt, fragment) and member != before:
                    before = member
                    own = unpack(seg)
                    at = np.searchsorted(segment, own)
                    at[at == len(segment)] = 0
                    out.append((pivot, member, int((segment[at] == own).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["pivot", "member", "part"])

    segments = texts.select("set_id", "text", "to", "salts").mapInArrow(cut, "pivot long, salt int, fragment int, role int, member long, seg binary")
    # repeated rows of one text give equal rows; one is enough, and the pivot's comes first
    parts = segments.repartition("pivot", "salt", "fragment").sortWithinPartitions("pivot", "salt", "fragment", "role", "member").mapInArrow(count, "pivot long, member long, part long")
    overlap = parts.groupBy("pivot", "member").agg(F.sum("part").alias("overlap"))
    return overlap.join(turned.select("pivot", "member", "both").distinct(), ["pivot", "member"]).filter(f"{100 + pct} * overlap >= {pct} * both").select(F.col("pivot").alias("a"), F.col("member").alias("b"))


def _pairs(rows: DataFrame, nodes: DataFrame, pct: int, block_rows: int) -> DataFrame:
    """Pairs (a, b), some repeated, of the sets in rows (token, set_id, comp) that share a token, lie in different components and fit by size and folded parities.

    A row carries its set's BEFORE smaller tokens next to its own. A pair with one of them in common was formed at that
    token already, and at its smallest common token it has none: so a pair leaves about once, not once per common token.
    """
    w = Window.partitionBy("set_id").orderBy("token")
    before = [f"t{i}" for i in range(BEFORE)]
    rows = rows.withColumns({c: F.lag("token", i + 1, -1).over(w) for i, c in enumerate(before)})
    dealt = block_pairs(rows.join(nodes.select("set_id", "n", "fold"), "set_id"), ["token"], F.col("set_id"), block_rows)
    dealt = dealt.select("token", "bi", "bj", "own", "set_id", "n", "comp", "fold", *before).repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")

    def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows i < j of one group, in different components, of fitting sizes; all groups of the batch at once."""
        token, bi, bj, own, ids, n, comp = (c.to_numpy() for c in batch.columns[:7])
        fold = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(len(token), -1)
        smaller = [c.to_numpy() for c in batch.columns[8:]]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        starts = np.flatnonzero(new)
        end = np.repeat(np.append(starts[1:], len(token)), np.diff(np.append(starts, len(token))))
        later = end - np.arange(len(token)) - 1  # rows after each row in its group
        cut = np.searchsorted(np.cumsum(later), np.arange(0, later.sum() + 1, 200_000))
        for a, b in zip(cut, [*cut[1:], len(token)], strict=True):  # so many pairs at a time
            i = np.repeat(np.arange(a, b), later[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
            fit = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= pct * np.maximum(n[i], n[j])) & ((bi[i] == bj[i]) | (own[i] != own[j]))
            i, j = i[fit], j[fit]
            for x in smaller:
                known = np.zeros(len(i), bool)
                for y in smaller:
                    known |= (x[i] == y[j]) & (x[i] >= 0)
                i, j = i[~known], j[~known]
            apart = np.bitwise_count(fold[i] ^ fold[j]).sum(axis=1)
            fit = apart <= allowed(n[i], n[j], pct)
            x, y = ids[i[fit]], ids[j[fit]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for x, y in pairs_of(batch):
                once = np.unique(np.stack([x, y], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        size = 0
        for g in runs(batches, ["token", "bi", "bj"]):
            held.append(g)
            size += g.num_rows
            if size >= 20_000:
                yield from emit(pa.concat_batches(held))
                held, size = [], 0
        if held:
            yield from emit(pa.concat_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def _across(shared: DataFrame, nodes: DataFrame, group_of: DataFrame, pct: int, block_rows: int) -> DataFrame:
    """Pairs (a, b) in different components that share a prefix n-gram and that lengths and parities allow. Discards shared.

    Where a group's pairs are formed, sizes and folded parities already drop most of them; the fine parities follow.
    """
    rows = shared.select(F.when(F.col("token") >= HOT, F.col("token").bitwiseAND((1 << 48) - 1)).otherwise(F.col("token")).alias("token"), "set_id").distinct().join(group_of, "set_id")
    mixed = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    rows = table(rows.join(mixed, "token"), "jaccard-mixed")
    discard(shared)
    possible = _possible(_pairs(rows, nodes, pct, block_rows).distinct(), nodes, pct)
    a, b = (group_of.select(F.col("set_id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    return possible.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "d", F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi"))


def jaccard_groups(docs: DataFrame, k: int = 5, pct: int = 80, most_broadcast: int = 500_000, block_rows: int = 2048, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs; links have a Jaccard similarity of pct/100 or more.

    With carry (columns whose names are not used here) these follow, and `stays`: of each group, the row smallest by
    (doc_id, carried values) stays, with its equals; so do rows without words or doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    classes = spark.sparkContext.broadcast(frequency_classes(_sketch(docs, k)))  # one byte per counter: 4 MB
    sets = _sets(docs, classes, k, pct, carry)
    once = sets.filter("doc_id is not null and prefix is not null")

    w = Window.partitionBy("token")
    shared = _tokens(once).withColumns({"lo": F.min("set_id").over(w), "hi": F.max("set_id").over(w)})
    shared = table(shared.filter((F.col("token") >= HOT) | (F.col("lo") < F.col("hi"))).select("token", "set_id"), "jaccard-shared")
    nodes = table(once.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fold").alias("fold")), "jaccard-nodes")
    wide, sets = sets, table(sets.select("doc_id", *carry, "n", "set_id"), "jaccard-rows")
    discard(wide)

    # the original of a group of copies shares all its prefix n-grams, a copy all but its edits: the hub is who shares most
    weight = table(shared.groupBy("set_id").agg(F.count("*").alias("c")).join(nodes.select("set_id", "n"), "set_id").select("set_id", F.floor(F.col("c") * 1000 / (F.col("n") * (100 - pct) / 100 + 1)).alias("w")), "jaccard-weights")
    hubs = shared.join(fits(weight, most_broadcast), "set_id").withColumn("hub", F.max(F.struct("w", "set_id")).over(w)).select("token", "set_id", F.col("hub.set_id").alias("hub"), F.col("hub.w").alias("w"))
    hubs = table(hubs, "jaccard-hubs")
    star = hubs.filter("set_id <> hub").select(F.col("set_id").alias("a"), F.col("hub").alias("b"))
    heads = hubs.filter(F.col("token") >= HOT).select(F.col("token").bitwiseAND((1 << 48) - 1).alias("token"), "hub", "w").distinct()
    heads = heads.join(heads.groupBy("token").agg(F.max(F.struct("w", "hub")).alias("m")), "token").filter("m.hub <> hub").select(F.col("hub").alias("a"), F.col("m.hub").alias("b"))
    possible = _possible(star.union(heads).groupBy("a", "b").agg(F.count("*").alias("c")), nodes, pct)
    best = possible.groupBy("a").agg(F.max(F.struct("c", "b", "na", "nb")).alias("m")).select("a", "m.b", "m.na", "m.nb")
    first = table(_linked(docs, best, nodes, classes, k, pct, most_broadcast), "jaccard-links")
    discard(weight, hubs)

    comp = components(first).withColumnsRenamed({"node": "set_id", "component": "comp"})
    group_of = table(nodes.select("set_id").join(comp, "set_id", "left").select("set_id", F.coalesce("comp", "set_id").alias("comp")), "jaccard-groups")
    across = table(_across(shared, nodes, group_of, pct, block_rows), "jaccard-across")
    discard(group_of)
    closest = table(across.groupBy("lo", "hi").agg(F.min(F.struct("d", "a", "b", "na", "nb")).alias("m")).select("lo", "hi", "m.*"), "jaccard-closest")
    second = table(_linked(docs, closest, nodes, classes, k, pct, most_broadcast), "jaccard-closest-links")
    ends = second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    done = table(closest.select("lo", "hi", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(ends, ["a", "b"]).select("lo", "hi"), "jaccard-merged")
    others = across.join(fits(done, most_broadcast), ["lo", "hi"], "left_anti").join(closest.select("a", "b"), ["a", "b"], "left_anti")
    second = second.union(_linked(docs, others, nodes, classes, k, pct, most_broadcast))
    # first-round components stay; links across them join them
    links = comp.select(F.col("set_id").alias("a"), F.col("comp").alias("b")).union(second)
    final = table(components(links).withColumnsRenamed({"node": "set_id", "component": "comp"}), "jaccard-components")

    # the smallest row of a set first: then a component has a row per different set only
    key = F.struct("doc_id", *carry)
    own = sets.filter("doc_id is not null and set_id is not null").groupBy("set_id").agg(F.min(key).alias("own")).join(final, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    of_sets = own.join(own.groupBy("comp").agg(F.min("own").alias("least")), "comp").select("set_id", "least")
    out = sets.select("doc_id", *carry, "n", "set_id").join(of_sets, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id")
    stays = F.coalesce(key == F.col("least"), F.lit(True)) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), component, *([*carry, stays.alias("stays")] if carry else ()))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(source(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s WHERE doc_id IS NOT NULL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS node, doc_id AS low FROM s WHERE doc_id IS NOT NULL UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.node WHERE c.low < p.b),
l AS (SELECT node, min(low) AS low FROM c GROUP BY node)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, l.low AS component_id FROM s LEFT JOIN l ON l.node = s.doc_id
"""
