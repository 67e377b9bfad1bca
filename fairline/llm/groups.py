"""Streaming over sorted groups inside a task, and block pairs of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The consecutive rows with equal keys, as one batch each; a run may span input batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(new), batch.num_rows)
        first = tuple(c[0] for c in cols)
        for i in range(len(starts) - 1):
            part = batch.slice(starts[i], starts[i + 1] - starts[i])
            if i == 0 and held and held_key == first:
                held.append(part)
                continue
            if held:
                yield _joined(held)
            held, held_key = [part], tuple(c[starts[i]] for c in cols)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def block_pairs(rows: DataFrame, key: list[str], member: Column, block_rows: int) -> DataFrame:
    """Cut groups of a key into blocks and copy each row to every pair of blocks that its own takes part in.

    Adds bi <= bj (the pair of blocks) and own (the row's block). A group of up to block_rows members stays one pair
    (0, 0); one of b blocks becomes b(b+1)/2 tasks of at most two blocks each, so no task holds a hot group.
    """
    blocks = rows.groupBy(*key).agg(F.count("*").alias("__n")).filter("__n > 1").select(*key, F.ceil(F.col("__n") / block_rows).cast("int").alias("__b"))
    own = F.pmod(F.xxhash64(member), F.col("__b").cast("long")).cast("int")
    dealt = rows.join(blocks, key).withColumn("own", own)
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
    return dealt.withColumns({"bi": F.least("own", "__o"), "bj": F.greatest("own", "__o")}).drop("__o", "__b")
