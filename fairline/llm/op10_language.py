"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte n-grams; a linear softmax on that mean gives the languages.
After training the two linear steps fold into one table of scores per bucket, so prediction is one gather per n-gram.
The softmax is calibrated by one temperature on held-back learning rows; the rejection threshold is a low quantile of
the calibrated score of the correctly predicted ones.

Cases: a null text, an empty one and one without any letter get `und` with score 0; repeated rows are scored each;
rows with null lang are predicted but never learned from; an empty table gives no rows; with nothing to learn from,
every row is `und`. Extra columns do not take part. Whole texts count, in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fairline.llm.common import let_go, plain, remainder, small_batches, source, table

UND = "und"
_LETTER = regex.compile(r"\p{L}")
_GAP = np.zeros(4, np.uint8)


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # bucket x language
    temperature: float = 1.0
    reject_below: float = 0.0
    bits: int = 16
    sizes: tuple[int, ...] = (2, 3, 4)
    log: dict = field(default_factory=dict)


def _grams(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n bytes that begin at every place of data (zero-padded at the end)."""
    h = np.full(len(data), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([data, np.zeros(n, np.uint8)])
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ padded[i : len(data) + i]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def _blocks(texts: list[str], size: int = 1 << 20, enough: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, row of each byte) in blocks: short texts together until they are enough, long ones in several blocks of the size."""
    buf, rows, held = [], [], 0
    for i, t in enumerate(texts):
        data = np.frombuffer((" " + t.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(data), size):
            part = np.concatenate([data[at : at + size], _GAP])  # n-grams never reach into the next text
            buf.append(part)
            rows.append(np.full(len(part), i, np.int32))
            held += len(part)
            if held >= enough:
                yield np.concatenate(buf), np.concatenate(rows)
                buf, rows, held = [], [], 0
    if buf:
        yield np.concatenate(buf), np.concatenate(rows)


def logits(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Mean bucket score per text: the linear softmax's input."""
    total, count = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    for data, rows in _blocks(texts):
        starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at, inside = rows[starts], data != 0
        for n in model.sizes:
            g = model.scores[_grams(data, n, model.bits)]
            g[~inside] = 0
            total[at] += np.add.reduceat(g, starts, axis=0, dtype=np.float64)
        count[at] += np.add.reduceat(inside, starts, dtype=np.int64) * len(model.sizes)
    return total / np.maximum(count, 1)[:, None]


def probabilities(model: LanguageModel, texts: list[str]) -> np.ndarray:
    z = logits(model, texts) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], dim: int = 16, bits: int = 16, epochs: int = 6, rate: float = 12.0, seed: int = 11, keep: float = 0.001) -> LanguageModel:
    """SGD on the cross-entropy of softmax(W mean(E[grams])); every fifth row of a lang is held back for the calibration."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    sizes = (2, 3, 4)
    emb, out = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32), rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    grams = []
    for t in texts:
        data = np.frombuffer((" " + t.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
        ids, counts = np.unique(np.concatenate([_grams(data, n, bits) for n in sizes]), return_counts=True)
        grams.append((ids.astype(np.uint16 if bits <= 16 else np.uint32), (counts / counts.sum()).astype(np.float32)))
    order = np.arange(len(texts))
    by_lang = np.argsort(y, kind="stable")
    at = np.empty(len(y), np.int64)
    at[by_lang] = order - np.searchsorted(y[by_lang], y[by_lang])  # place of the row among those of its lang
    held = at % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    fit = order[~held]
    weight = len(fit) / (len(names) * np.maximum(np.bincount(y[fit], minlength=len(names)), 1))
    for epoch in range(epochs):
        rng.shuffle(fit)
        step = rate * (1 - epoch / epochs)
        for i in fit:
            ids, share = grams[i]
            hidden = share @ emb[ids]
            z = hidden @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(min(weight[y[i]], 5.0))
            back = out @ p
            out -= np.float32(step * 0.1) * np.outer(hidden, p)
            emb[ids] -= np.float32(step) * share[:, None] * back[None, :]
    model = LanguageModel(names, (emb @ out).astype(np.float32), bits=bits, sizes=sizes)
    check = order[held] if held.any() else order
    z, t = logits(model, [texts[i] for i in check]), y[check]

    def loss(temp: float) -> float:
        q = z / temp
        q = q - q.max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(t)), t]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
    p = probabilities(model, [texts[i] for i in check])
    right = p.argmax(1) == t
    sure = np.sort(p.max(1)[right])
    # rejected: what scores below the `keep` quantile of right answers, and never what beats an even split of the classes twice over
    model.reject_below = float(min(sure[int(keep * len(sure))], 2.0 / max(len(names), 2), 0.5)) if len(sure) else 0.0
    model.log = {"accuracy": float(right.mean()), "held": int(len(check))}
    return model


def fit(docs: DataFrame, modulus: int = 3, held_remainder: int = 1, sample: int = 3000, max_chars: int = 40_000_000) -> LanguageModel | None:
    """Train on at most `sample` distinct learning rows, chosen by a hash of the text; max_chars bounds what the driver receives.

    Copies of a text with its lang count once. Of every lang the first row by hash always comes (of a text longer than
    its share of max_chars, the beginning), then up to 100 of each within half the sample, then rows of any lang by
    ascending hash; whole, and each only if it still fits into max_chars.
    """
    rows = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", modulus) != held_remainder))
        .filter(F.col("text").rlike(r"\p{L}"))
        .select("text", "lang", F.xxhash64("text", "lang").alias("h"), F.length("text").alias("n"))
    )
    once = table(rows.select("h", "lang", "n").distinct(), "language-rows")
    langs = once.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return None
    least = max(1, min(100, sample // (2 * langs)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # limited per task before the shuffle
    first = once.withColumn("r", place).filter(F.col("r") <= least).orderBy("r", "h").collect()
    more = once.orderBy("h").limit(sample).collect()
    chosen: dict[int, int] = {}
    total, share = 0, max(1, max_chars // langs)
    for i, r in enumerate([*first, *more]):
        if r["h"] in chosen or (i >= langs and len(chosen) >= sample):  # the first row of each lang comes first
            continue
        n = min(r["n"], share) if i < langs else r["n"]
        if i < langs or total + n <= max_chars:
            chosen[r["h"]] = n
            total += n
    wanted = docs.sparkSession.createDataFrame(list(chosen.items()), "h long, cap int")  # at most `sample` rows, or one per lang
    got = rows.join(F.broadcast(wanted), "h").select("h", F.expr("substring(text, 1, cap)").alias("text"), "lang").dropDuplicates(["h"]).orderBy("h").collect()
    return train([r["text"] for r in got], [r["lang"] for r in got])


def predict(docs: DataFrame, model: LanguageModel | None, keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds lang_pred, score (calibrated probability) and rejected to the kept columns."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(plain(model))  # bounded: 2**bits rows of one float per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go("pieces")  # the chunks of op6
        m = LanguageModel(**shared.value) if shared.value is not None else None
        for batch in batches:
            texts = batch.column(place).to_pylist()
            use = [i for i, t in enumerate(texts) if t and m is not None and _LETTER.search(t)]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if use:
                p = probabilities(m, [texts[i] for i in use])
                best = p.argmax(1)
                for i, b, q in zip(use, best, p.max(1), strict=True):
                    lang[i], score[i] = m.langs[b], min(1.0, float(q))
            rejected = np.array([x == UND for x in lang]) | (score < (m.reject_below if m is not None else 0))
            kept = [batch.column(i) for i in range(len(keep_columns))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=schema.names)

    small_batches(docs.sparkSession)
    columns = [*keep_columns, *(() if "text" in keep_columns else ("text",))]
    place = columns.index("text")
    schema = StructType([docs.schema[c] for c in keep_columns]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*columns).mapInArrow(run, schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def brute_predict(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The definition, one n-gram at a time (for tests)."""
    if not text or not any(c.isalpha() for c in text):
        return UND, 0.0
    data = (" " + text.lower() + " ").encode("utf-8", "surrogatepass")
    rows = []
    for n in model.sizes:
        for i in range(len(data)):
            rows.append(model.scores[_grams(np.frombuffer(data[i : i + n].ljust(n, b"\0"), np.uint8), n, model.bits)[0]])
    z = pd.DataFrame(rows).mean().to_numpy(dtype="float64") / model.temperature
    p = np.exp(z - z.max())
    p /= p.sum()
    return model.langs[int(p.argmax())], float(p.max())
