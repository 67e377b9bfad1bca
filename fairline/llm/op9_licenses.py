"""Licence scans with a trained paragraph classifier.

A paragraph is a run of non-blank lines. Where its words tell of a licence, each stretch of telling words no more than
GAP words apart is read on its own, whatever the line breaks. Stretches are described by the word 1- to 3-grams that occur in licence templates and hold at least one word
that is rare in ordinary paragraphs; all others have no weight, so a paragraph without such a word is ordinary text by
definition and costs one set test per line. A multinomial logistic regression over these sparse features, trained in numpy on
noisy copies of the templates set into ordinary words, gives the family; classes "none" (ordinary text, also with a
stray licence word) and "unknown" (licence wording without a known family) are calibrated with the others by one
temperature. Spans of a stretch that hold most of a template (longest run of matching words in order) are judged one by
one, the longest match first, and each gives one row. A stretch without such a span that is still licence wording gives
one unknown row.

Cases: null and empty texts have no paragraph and give no row; `paragraph` is the line (from 0) on which a row's span
begins, so two spans that begin on one line share it; repeated rows give repeated ones; a null doc_id stays null; an empty table gives no rows; very long texts are read line by line and
only the words of one stretch are held; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import plain, source

NONE, UNKNOWN = "none", "unknown"
# Licence notices as their licensors word them.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "distributed under the apache license 2.0"),
    "bsd-3-clause": ("redistribution and use in source and binary forms with or without modification are permitted", "released under the bsd 3 clause license", "licensed under the bsd license"),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0"),
    "cc-by-nc-4.0": ("this work is licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0"),
    "cc-by-sa-4.0": ("this work is licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0"),
    "cc0-1.0": ("dedicated to the public domain under cc0 1.0 universal", "released under cc0 1.0"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "under the terms of the gnu general public license as published by the free software foundation", "licensed under the gnu gpl version 3"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "under the terms of the gnu lesser general public license"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license version 2.0", "licensed under the mpl 2.0"),
}
UNKNOWN_TEMPLATES = ("licensed under the {} license", "released under the {} license version {}", "this work is licensed under the {} public license", "distributed under the terms of the {} licence", "this software is licensed under {} terms version {}")
GAP = 12  # ordinary words that end a stretch of telling ones
LICENCE_WORDS = {"license", "licence", "licensed"}
_OWN_TEMPLATES = [(c, t.split()) for c in sorted(TEMPLATES) for t in TEMPLATES[c]] + [(UNKNOWN, t.replace("{}", "").split()) for t in UNKNOWN_TEMPLATES]
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(line: str) -> list[str]:
    return _WORD.findall(line.lower())


@dataclass
class LicenseModel:
    classes: list[str]
    telling: frozenset[str]
    features: dict[str, int]
    weights: np.ndarray  # feature (and, last, a constant) x class
    temperature: float = 1.0
    least_match: float = 0.8

    def __post_init__(self):
        self._judged: dict[tuple, list] = {}

    def present(self, w: list[str]) -> list[int]:
        """Features of a word list: n-grams around its telling words."""
        found = set()
        for i in [i for i, x in enumerate(w) if x in self.telling]:
            for n in (1, 2, 3):
                for a in range(max(0, i - n + 1), min(i, len(w) - n) + 1):
                    f = self.features.get(" ".join(w[a : a + n]))
                    if f is not None:
                        found.add(f)
        return sorted(found)

    def probabilities(self, present: list[int]) -> np.ndarray:
        z = (self.weights[present].sum(0) + self.weights[-1]) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def match(self, w: list[str], family: str) -> float:
        """Largest part of a template of the family that the words hold, in order and close together."""
        return max(_held(w, t.split()) for t in TEMPLATES[family])

    def judge(self, w: list[str]) -> tuple[str, float, float] | None:
        """(family, probability, match) of licence words; None for ordinary text."""
        present = self.present(w)
        if not present:
            return None
        p = self.probabilities(present)
        if p[self.classes.index(NONE)] >= 0.5:
            return None
        best = max((c for c in self.classes if c not in (NONE, UNKNOWN)), key=lambda c: p[self.classes.index(c)])
        told, match = float(p[self.classes.index(best)]), self.match(w, best)
        if told >= 0.5 and match >= self.least_match:
            return best, told, match
        return UNKNOWN, float(1 - p[self.classes.index(NONE)]), match

    def found(self, w: list[str]) -> list[tuple[int, str, float, float]]:
        """(place of its first word, family, probability, match) of each licence span of a stretch."""
        key = tuple(w)
        if key not in self._judged:
            if len(self._judged) >= 10_000:
                self._judged.clear()
            self._judged[key] = self._found(w)
        return self._judged[key]

    def _found(self, w: list[str]) -> list[tuple[int, str, float, float]]:
        spans = [(n, b, e, own) for own, t in _OWN_TEMPLATES for n, b, e in _spans(w, t, self.least_match)]
        taken: list[tuple[int, int]] = []
        out = []
        for _, b, e, _own in sorted(spans, key=lambda x: (-x[0], x[2] - x[1], x[1], x[3])):
            if any(b < y and x < e for x, y in taken):
                continue
            if (told := self.judge(w[b:e])) is not None:
                taken.append((b, e))
                out.append((b, *told))
        if not out and (told := self.judge(w)) is not None:
            first = next(i for i, x in enumerate(w) if x in self.telling)
            out.append((first, *told))
        return sorted(out)


def _spans(w: list[str], template: list[str], least: float) -> Iterator[tuple[int, int, int]]:
    """(matching words, begin, end) of the stretches, one after the other, that hold `least` of the template in order."""
    want, size = set(template), len(template) + len(template) // 2
    need = next(n for n in range(len(template) + 1) if n / len(template) >= least)
    heads, done = set(template[: len(template) - need + 1]), 0
    if len(want.intersection(w)) < need - (len(template) - len(want)):
        return
    for s, x in enumerate(w):
        if s < done or x not in heads or sum(y in want for y in w[s : s + size]) < need:
            continue
        n, b, e = _aligned(w, template, s, min(s + size, len(w)))
        if n >= need:
            while (again := _aligned(w, template, b, min(b + size, len(w))))[0] > n:  # words before the span may have cut its end
                n, b, e = again
            yield n, b, e
            done = e


def _aligned(w: list[str], template: list[str], begin: int, end: int) -> tuple[int, int, int]:
    """(length, begin, end) of the longest common subsequence of w[begin:end] and the template, the latest begin and first end."""
    row = [(0, begin)] * (len(template) + 1)
    best = (0, begin, begin)
    for i in range(begin, end):
        before = row[0]
        for j, t in enumerate(template):
            here = (before[0] + 1, before[1] if before[0] else i) if w[i] == t else (0, begin)
            before, row[j + 1] = row[j + 1], max(row[j + 1], row[j], here)
        if row[-1][0] > best[0]:
            best = (*row[-1], i + 1)
    return best


def stretches(lines: Iterator[str], telling: frozenset[str]) -> Iterator[tuple[list[str], list[int]]]:
    """(words, line of each) around telling words no more than GAP words apart, of every paragraph."""
    held: list[str] = []
    at: list[int] = []
    since = None  # words after the last telling one; None: none in the stretch so far
    for k, line in enumerate(lines):
        w = words(line)
        if not w and not line.strip():
            if since is not None:
                yield held, at
            held, at, since = [], [], None
            continue
        if since is None and telling.isdisjoint(w):
            held, at = [*held, *w[-GAP:]][-GAP:], [*at, *[k] * min(len(w), GAP)][-GAP:]
            continue
        for x in w:
            if x in telling:
                since = 0
            elif since is not None:
                since += 1
            held.append(x)
            at.append(k)
            if since is None:
                del held[:-GAP], at[:-GAP]
            elif since > GAP:
                yield held, at
                held, at, since = held[-GAP:], at[-GAP:], None
    if since is not None:
        yield held, at


def _held(w: list[str], template: list[str]) -> float:
    """Longest common subsequence of the template and any stretch of 1.5 times its length, as a part of it."""
    want, size, best = set(template), len(template) + len(template) // 2, 0
    starts = [i for i, x in enumerate(w) if x in want]
    done = -1
    for s in starts:
        if s <= done:
            continue
        stretch = [x for x in w[s : s + size] if x in want]
        if len(stretch) <= best:
            continue
        row = [0] * (len(template) + 1)
        for x in stretch:
            before = 0
            for j, t in enumerate(template):
                before, row[j + 1] = row[j + 1], before + 1 if x == t else max(row[j + 1], row[j])
        best = max(best, row[-1])
        if best == len(template):
            break
    return best / len(template)


def notice(w: list[str], least: float = 0.6) -> bool:
    """Licence wording: names a licence, or holds most of a template."""
    here = set(w)
    return bool(here & LICENCE_WORDS) or any(len(here.intersection(t)) >= least * len(set(t)) and _held(w, t) >= least for _, t in _OWN_TEMPLATES)


def train(ordinary: list[str], copies: int = 150, epochs: int = 8, seed: int = 3) -> LicenseModel:
    rng = np.random.default_rng(seed)
    plain = [x for x in (words(t) for t in ordinary) if x] or [["text"]]
    # the sample may contain notices itself: they say nothing about ordinary words
    plain = [w for w in plain if not notice(w)] or [["text"]]
    seen = Counter(x for w in plain for x in set(w))
    vocabulary = sorted({x for ts in TEMPLATES.values() for t in ts for x in t.split()} | {x for t in UNKNOWN_TEMPLATES for x in t.replace("{}", "").split()})
    often = {x for x in vocabulary if seen[x] > max(2, 0.02 * len(plain))} - LICENCE_WORDS
    telling = frozenset(vocabulary) - often
    plain = [w for w in plain if not telling.intersection(w)] or [["text"]]
    pick = lambda: plain[rng.integers(len(plain))]
    made = "alder birch cedar delta ember fjord grove haven iris juniper kestrel lumen".split()
    classes = [NONE, UNKNOWN, *sorted(TEMPLATES)]

    def around(core: list[str]) -> list[str]:
        core = [x for x in core if rng.random() > 0.06]
        a, b = pick(), pick()
        return a[: rng.integers(0, 20)] + core + b[: rng.integers(0, 20)]

    rows: list[tuple[list[str], int]] = []
    for c in sorted(TEMPLATES):
        for t in TEMPLATES[c]:
            rows += [(around(t.split()), classes.index(c)) for _ in range(copies)]
    for t in UNKNOWN_TEMPLATES:
        rows += [(around(t.format(*(made[rng.integers(len(made))], str(rng.integers(1, 5)))).split()), 1) for _ in range(2 * copies)]
    words_list = sorted(telling)
    for _ in range(copies * 20):
        w = list(pick())
        for _ in range(rng.integers(1, 3)):
            w.insert(rng.integers(0, len(w) + 1), words_list[rng.integers(len(words_list))])
        rows.append((w, 0))
    grams = sorted({" ".join(x[a : a + n]) for ts in (*TEMPLATES.values(), [t.replace("{}", "").strip() for t in UNKNOWN_TEMPLATES]) for t in ts for x in [t.split()] for n in (1, 2, 3) for a in range(len(x) - n + 1) if telling.intersection(x[a : a + n])})
    model = LicenseModel(classes, telling, {g: i for i, g in enumerate(grams)}, np.zeros((len(grams) + 1, len(classes))))
    model.weights[-1, 0] = 2.0
    order = rng.permutation(len(rows))
    cases = [(np.array([*model.present(rows[i][0]), len(grams)]), rows[i][1]) for i in order]
    fit, held = cases[: len(cases) * 4 // 5], cases[len(cases) * 4 // 5 :]
    for epoch in range(epochs):
        rate = 0.3 * (1 - epoch / epochs) + 0.02
        for i in rng.permutation(len(fit)):
            f, y = fit[i]
            z = model.weights[f].sum(0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            model.weights[f] -= rate * p
    z = np.stack([model.weights[f].sum(0) for f, _ in held])
    y = np.array([c for _, c in held])

    def loss(t: float) -> float:
        q = z / t - (z / t).max(1, keepdims=True)
        return float((np.log(np.exp(q).sum(1)) - q[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    return model


def fit(docs: DataFrame, sample: int = 4000, max_chars: int = 4000) -> LicenseModel:
    """Ordinary words for the training rows come from at most `sample` distinct lines, chosen by a hash, of up to max_chars."""
    lines = docs.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line").between(20, max_chars))
    lines = lines.withColumn("h", F.xxhash64("line"))
    chosen = lines.select("h").distinct().orderBy("h").limit(sample).collect()
    if not chosen:
        return train([])
    got = lines.filter(F.col("h") <= F.lit(chosen[-1]["h"])).dropDuplicates(["h"]).orderBy("h").select("line").collect()  # `sample` rows
    return train([r["line"] for r in got])


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """doc_id, paragraph (from 0), family, probability, template_match, confirmed per licence span."""
    shared = docs.sparkSession.sparkContext.broadcast(plain(model))  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LicenseModel(**shared.value) if shared.value is not None else None
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                for w, at in stretches((text.as_py() or "").split("\n"), m.telling):
                    out += [(i, at[b], *told) for b, *told in m.found(w)]
            keys = batch.column(0).take(pa.array([o[0] for o in out], pa.int32()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([keys, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.float64()), pa.array([f != UNKNOWN for f in cols[2]], pa.bool_())], names=names)

    some = docs.select("doc_id", "text")
    schema = some.drop("text").schema.add("paragraph", "long").add("family", "string").add("probability", "double").add("template_match", "double").add("confirmed", "boolean")
    names = schema.names
    return some.mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
