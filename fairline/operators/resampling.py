"""Seeded resampling of mean profits.

A bootstrap sample of n values is a multinomial draw over the distinct values, and a sign-flip draw is
one binomial draw per distinct value. So the rows are first reduced to a histogram (partial aggregation,
no row leaves its task), and a draw costs the number of distinct profits instead of n. Profits are whole
millionths in [-1, price - 1], which bounds a histogram whatever the number of rows. Draw blocks are
separate groups, so one pattern's draws spread over tasks. Seeds come from the label, so results do not
depend on partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 500
_CELLS = 4_000_000


def histogram(df: DataFrame, keys: Sequence[str], profit_micro: Column) -> DataFrame:
    return df.groupBy(*keys, profit_micro.alias("v")).agg(F.count("*").alias("c"))


def _rng(label: str, purpose: str, block: int) -> np.random.Generator:
    digest = hashlib.sha256(f"{label}|{purpose}|{block}".encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest[:16], "big")))


def _block(pdf: pd.DataFrame, n_draws: int, kind: str) -> np.ndarray:
    """The resampled means (`bootstrap`) or signed means (`signflip`) of one block of draws."""
    pdf = pdf.sort_values("v", kind="stable")
    block = int(pdf["block"].iloc[0])
    size = min(BLOCK, n_draws - block * BLOCK)
    v = pdf["v"].to_numpy(np.float64) / 1e6
    c = pdf["c"].to_numpy(np.int64)
    n = int(c.sum())
    rng = _rng(str(pdf["label"].iloc[0]), kind, block)
    out = []
    step = max(1, _CELLS // max(1, len(v)))
    for at in range(0, size, step):
        m = min(step, size - at)
        if kind == "bootstrap":
            out.append(rng.multinomial(n, c / n, size=m) @ v / n)
        else:
            out.append((2 * rng.binomial(c, 0.5, size=(m, len(c))) - c) @ v / n)
    return np.concatenate(out)


def _blocks(hist: DataFrame, keys: Sequence[str], label: Column, n_draws: int) -> tuple[DataFrame, str]:
    """The histograms once per block of draws, and the schema of the keys.

    The histograms are small and the draws are the work: a fixed number of partitions, or adaptive execution would join them to one task.
    """
    blocks = (n_draws + BLOCK - 1) // BLOCK
    tasks = max(32, 2 * hist.sparkSession.sparkContext.defaultParallelism)
    work = hist.withColumn("label", label).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    work = work.repartition(tasks, *keys, "block")
    return work, work.select(*keys).schema.simpleString()[7:-1]


def draws(hist: DataFrame, keys: Sequence[str], label: Column, n_draws: int, kind: str) -> DataFrame:
    """keys, draw, stat: resampled mean (`bootstrap`) or signed mean (`signflip`)."""
    work, schema = _blocks(hist, keys, label, n_draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, first = _block(pdf, n_draws, kind), int(pdf["block"].iloc[0]) * BLOCK
        res = {k: [pdf[k].iloc[0]] * len(stat) for k in keys}
        return pd.DataFrame(res | {"draw": np.arange(first, first + len(stat)), "stat": stat})

    return work.groupBy(*keys, "block").applyInPandas(run, f"{schema}, draw long, stat double")


def bootstrap_interval(
    hist: DataFrame, keys: Sequence[str], label: Column, n_draws: int, quantile: str = "linear",
    indexes: tuple[int, int] | None = None,
) -> DataFrame:
    """keys, ci_low, ci_high.

    quantile 'linear' interpolates at q*(n-1); 'index' takes element int(q*(n-1)); `indexes` fixes both positions. A
    block of draws travels as one row with its means; a key gathers n_draws numbers, whatever its rows.
    """
    work, schema = _blocks(hist, keys, label, n_draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"stats": [np.sort(_block(pdf, n_draws, "bootstrap"))]})

    d = work.groupBy(*keys, "block").applyInPandas(run, f"{schema}, stats array<double>").groupBy(*keys)
    s = d.agg(F.sort_array(F.flatten(F.collect_list("stats"))).alias("s"))
    if quantile == "linear":
        def at(q: float) -> Column:
            low = int(q * (n_draws - 1))
            a, b, part = F.element_at("s", low + 1), F.element_at("s", min(low + 2, n_draws)), q * (n_draws - 1) - low
            return a * F.lit(1 - part) + b * F.lit(part)

        return s.select(*keys, at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))
    lo, hi = indexes or (int(0.025 * (n_draws - 1)), int(0.975 * (n_draws - 1)))
    return s.select(*keys, F.element_at("s", lo + 1).alias("ci_low"), F.element_at("s", hi + 1).alias("ci_high"))


def sign_flip_p(
    hist: DataFrame, keys: Sequence[str], label: Column, n_draws: int, two_sided: bool = True
) -> DataFrame:
    """keys (not null), p. Two-sided on |mean|; one-sided on the sum, which gives 1 for a total of zero or less.

    A block knows its histogram and so the observed mean: it returns how many of its draws reach that, one row a block.
    """
    work, schema = _blocks(hist, keys, label, n_draws)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        stat = _block(pdf, n_draws, "signflip")
        observed = int((pdf["v"] * pdf["c"]).sum()) / int(pdf["c"].sum()) / 1e6
        reached = np.abs(stat) >= abs(observed) - 1e-12 if two_sided else stat >= observed - 1e-12
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"hits": [int(reached.sum())], "observed": [observed]})

    d = work.groupBy(*keys, "block").applyInPandas(run, f"{schema}, hits long, observed double")
    p = (F.sum("hits") + 1) / F.lit(float(n_draws + 1))
    out = d.groupBy(*keys).agg(p.alias("p"), F.first("observed").alias("observed"))
    if not two_sided:
        out = out.withColumn("p", F.when(F.col("observed") <= 0, F.lit(1.0)).otherwise(F.col("p")))
    return out.drop("observed")
