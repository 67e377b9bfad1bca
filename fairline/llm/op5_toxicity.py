"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text and one on windows of toxic text: those around
words and phrases of up to three words that are significantly more frequent in toxic text (Dunning's log-likelihood ratio
over documents, near copies of the learning rows left out), at most 40 of a text, the most significant first. Each window of
the text is compressed with the ordinary dictionary alone and with the toxic one before it; the bytes that the toxic
dictionary saves are the window's distance. A document is described by how many of its windows save at least 2, 3, ...
bytes; a logistic regression on these counts, fitted on learning rows, is the calibrated score, and 0.3 the threshold.

The models are fitted on a bounded sample of labelled rows (`sample` rows, whole texts, at most `max_chars`); scoring
covers every window of every text.

Cases: a null or empty text has no window and gets the score of a text without any saving; labels with a null toxic or
id and unlabelled rows are not learned from; several labels of one id count as toxic if one is; repeated rows are scored
each; an empty table gives no rows; with one class only, or none, in the learning rows the score is 0 for every row;
extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import GOLDEN, mix, pieces, plain, remainder, shingle_hashes, source

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SAVED = (2, 3, 4, 5, 6, 7, 8, 10)


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    window: int = 32
    step: int = 16

    def __post_init__(self):
        self._pair = None

    def compressors(self):
        """(with ordinary text before the window, with toxic and ordinary text before it)."""
        if self._pair is None:
            import zstandard as z

            params = z.ZstdCompressionParameters(window_log=14, hash_log=13, chain_log=13, search_log=3, min_match=5, strategy=z.STRATEGY_GREEDY)

            def make(content: bytes):
                d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=params)
                return z.ZstdCompressor(compression_params=params, dict_data=d)

            self._pair = make(self.ordinary), make(self.toxic + self.ordinary)
        return self._pair

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes saved by the toxic dictionary, per window of the lower-cased text."""
        plain, toxic = (c.compress for c in self.compressors())
        out = []
        for data in pieces((text or "").lower().encode("utf-8", "surrogatepass")):
            for i in range(0, max(1, len(data) - self.window + self.step), self.step):
                w = data[i : i + self.window]
                out.append(len(plain(w)) - len(toxic(w)))
        return np.array(out, np.int32)

    def features(self, text: str | None) -> np.ndarray:
        return described(self.distances(text))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -35, 35)))


def described(saved: np.ndarray) -> np.ndarray:
    """1, log counts of windows that save so many bytes, the largest saving (the same counts, next to their number)."""
    n = len(saved)
    counts = np.array([(saved >= s).sum() for s in SAVED], float)
    top = np.sort(saved)[-3:] if n else np.zeros(1)
    return np.concatenate([[1.0], np.log1p(counts), [max(float(top.max()), 0) / 4, max(float(top.mean()), 0) / 4, np.log1p(n)], np.log1p(counts[1:5] / max(n, 1) * 100)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard as z

    try:
        return z.train_dictionary(size, samples).as_bytes()
    except z.ZstdError:  # too few samples to train on: they are the content themselves
        return b"".join(dict.fromkeys(samples))[-size:]


def _phrases(data: bytes, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of every run of 1 to `most` words."""
    from xxhash import xxh3_64_intdigest

    at = [(*m.span(), xxh3_64_intdigest(m.group())) for m in _WORD.finditer(data)]
    begin, end, h = (np.array([x[k] for x in at], t) for k, t in enumerate((np.int64, np.int64, np.uint64)))
    runs = []
    with np.errstate(over="ignore"):
        for k in range(1, min(most, len(at)) + 1):
            acc = np.full(len(at) - k + 1, k, np.uint64)
            for i in range(k):
                acc = mix(acc * GOLDEN + h[i : len(at) - k + 1 + i])
            runs.append((begin[: len(acc)], end[k - 1 :], acc))
    return tuple(np.concatenate(c) for c in zip(*runs, strict=True)) if runs else (begin, end, h)


def _telling_windows(data: bytes, known: np.ndarray, ratio: np.ndarray, around: int = 2, most: int = 40) -> list[bytes]:
    """Windows of the text around its telling phrases (overlapping ones together), the most significant ones."""
    begin, end, h = _phrases(data)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[place] == h)
    spans: list[list] = []
    for i in hit[np.lexsort((end[hit], begin[hit]))]:
        if spans and begin[i] <= spans[-1][1]:
            spans[-1][1] = max(int(end[i]), spans[-1][1])
            spans[-1][2] += ratio[place[i]]
        else:
            spans.append([int(begin[i]), int(end[i]), ratio[place[i]]])
    spans.sort(key=lambda s: -s[2])
    return [data[max(0, b - around) : e + around] for b, e, _ in spans[:most]]


def train(texts: list[str], toxic: list[int], least_ratio: float = 12.0, seed: int = 5) -> ToxicityModel | None:
    """None if one of the two classes has no row."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None
    rng = np.random.default_rng(seed)
    seen, single = set(), []
    for i, t in enumerate(texts):  # of near copies (an equal minimum of one of three hash orders) the first
        h = shingle_hashes(t)
        keys = [(j, int((h * np.uint64(m)).min())) for j, m in enumerate((1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9))] if len(h) else []
        if keys and not any(k in seen for k in keys):
            single.append(i)
        seen.update(keys)
    lowered = {i: texts[i].lower().encode("utf-8", "surrogatepass") for i in single}
    n1, n0 = sum(bool(y[i]) for i in single), sum(not y[i] for i in single)
    known, a = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(_phrases(lowered[i])[2]) for i in single if y[i])]), return_counts=True)
    b = np.zeros(len(known), np.int64)
    for i in single if len(known) else ():
        if not y[i]:
            h = np.unique(_phrases(lowered[i])[2])
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            b[at[known[at] == h]] += 1
    e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
    ratio = np.where(a > e1, 2 * (a * np.log(a / e1) + np.where(b > 0, b * np.log(np.maximum(b, 1) / np.maximum(e0, 1e-9)), 0.0)), 0.0)
    use = np.flatnonzero((ratio >= least_ratio) & (a > 1))
    if not len(use):  # little to learn from: the most telling ones
        use = np.sort(np.argsort(-ratio, kind="stable")[:20])
    known, ratio = known[use], ratio[use]
    own = [w for i in single if y[i] and len(known) for w in _telling_windows(lowered[i], known, ratio)]
    windows = []
    for i in single:
        if not y[i]:
            at = rng.integers(0, max(1, len(lowered[i]) - 48), 4)
            windows += [lowered[i][a : a + 48] for a in at]
    rng.shuffle(own)
    model = ToxicityModel(_dictionary(own, 2500), _dictionary(windows, 8192), np.zeros(1))
    x = np.stack([model.features(t) for t in texts])
    model.weights = logistic(x, y.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_remainder: int = 2, sample: int = 8000, max_chars: int = 24_000_000) -> ToxicityModel | None:
    """Learn from labelled rows outside the held-out remainder, in the order of a hash of the id, whole texts."""
    told = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.filter(remainder("doc_id", modulus) != held_remainder).withColumn("h", F.xxhash64("doc_id"))
    ids = told.orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")  # at most `sample` rows
    chosen = rows.select("h", F.length("text").alias("n")).orderBy("h").collect()
    total, last = 0, None
    for r in chosen:
        total += r["n"]
        if total > max_chars and last is not None:
            break
        last = r["h"]
    if last is None:
        return None
    got = rows.filter(F.col("h") <= F.lit(last)).select("h", "text", "toxic").orderBy("h", "text").collect()
    return train([r["text"] for r in got], [int(r["toxic"]) for r in got])


def score(docs: DataFrame, model: ToxicityModel | None, threshold: float = 0.3) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(plain(model))  # two dictionaries of a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(**shared.value) if shared.value is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            s = m.score(np.stack([m.features(t.as_py()) for t in batch.column(1)])) if m is not None else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    some = docs.select("doc_id", "text")
    return some.mapInArrow(run, some.drop("text").schema.add("score", "double").add("predicted", "integer"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    out = score(docs, fit(docs, source(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
