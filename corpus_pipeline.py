"""A corpus pipeline: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written and read again before
the next. All but the last return the columns of `documents`. Other columns pass through under names of their own.

Cases: an empty table passes through; documents with a null text have no letter and go in the first stage; a null doc_id
links with nothing and stays, unless its text leaks; rows that repeat a doc_id with the same text are copies of one document,
one of which stays; rows that repeat it with another text are documents of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import op1_decontaminate, op3_jaccard, op4_secrets, op6_pieces, op10_language
from fairline.llm.common import fits, source, table

MOST_BROADCAST = 1_000_000
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def own_names(stage: Stage) -> Stage:
    """Columns that are not those of `documents` go through the stage under generated names, so none clashes with its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden = {c: f"kept_{uuid.uuid4().hex}" for c in docs.columns if c not in DOCUMENT}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        return out.withColumnsRenamed({h: c for c, h in hidden.items()})

    return run


@own_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (no letter, or a score under the calibrated bound) go; a null lang is filled in."""
    judged = op10_language.predict(docs, op10_language.fit(docs), tuple(docs.columns)).filter("not rejected")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@own_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similar 5-word shingles the row with the smallest doc_id stays (of equal ids by hash of the text)."""
    names = ("near_t1", "near_t2")
    keyed = docs.withColumns(dict(zip(names, op1_decontaminate.text_key().values(), strict=True)))
    groups = table(op3_jaccard.jaccard_groups(keyed, carry=names), "groups")
    by = ["doc_id", *names]
    gone = table(groups.filter("not stays").select(*by).distinct(), "gone")
    kept = keyed.join(fits(gone, MOST_BROADCAST), by, "left_anti")
    copies = groups.filter("doc_id is not null and stays").groupBy(*by).count().filter("count > 1").select(*by)
    again = fits(table(copies, "repeated"), MOST_BROADCAST)
    once = kept.join(again, by, "left_semi").dropDuplicates(by)
    return kept.join(again, by, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


@own_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds 80 % or more of a benchmark item's shingles go, whatever their doc_id."""
    leaks, _, _ = op1_decontaminate.leaking(docs, source(spark, sf_dir, "benchmark"))
    gone = table(leaks.select(F.col("t1").alias("leak_t1"), F.col("t2").alias("leak_t2")).distinct(), "leaking")
    t1, t2 = op1_decontaminate.text_key().values()
    keyed = docs.withColumns({"leak_t1": t1, "leak_t2": t2})
    return keyed.join(fits(gone, MOST_BROADCAST), ["leak_t1", "leak_t2"], "left_anti").select(*docs.columns)


@own_names
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder; n_chars follows the text."""
    clean = op4_secrets.scan(docs, redact="[SECRET]")
    return clean.withColumn("n_chars", F.when(F.col("n_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@own_names
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return op6_pieces.encode(docs, op6_pieces.default_model())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", secrets),
    ("tokens", tokens),
]
# The language model is trained by gradient descent, which SQL does not express: see tests/llm for the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
