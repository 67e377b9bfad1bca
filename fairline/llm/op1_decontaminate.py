"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

An item with n distinct shingles lies in a document if at least pct % of them do, so the document holds one or more of
any n - ceil(pct n / 100) + 1 of them. The item's MinHash sketch is that many of its smallest shingle hashes: every
document that contains it shares a sketch value (no miss by chance). Documents are partitioned by size: a partition of
documents of up to 2**c shingles can hold only items that need no more than that, and its documents' signatures are the
hashes up to the largest sketch value of these items. Signatures meet sketches by equality; the candidates' shingles
are then compared as text, and only exact containment counts. All of it is DataFrame functions.

Sketches are broadcast if their counted rows are within `most_broadcast`; beyond it Spark joins by its own size check.
Equal texts are searched once (keyed by two 64-bit hashes of the text), so groups of copies cost one search per task.

Cases: words are runs of other than \\x20 and \\x09-\\x0D, in lower case; a text of fewer than k words is one shingle; null
and empty items are in no document, null and empty documents hold no item; repeated rows give a row each; a null doc_id
or item_id stays null in the result; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm.common import fits, source, table

_SPACE = " \t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """Words of a text column; null for texts without any."""
    t = F.btrim(F.lower(F.col(text)), F.lit(_SPACE))
    return F.when(F.length(t) > 0, F.split(t, "[\\x20\\x09-\\x0D]+"))


def _starts(w: Column, k: int) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1)))


def hashes(w: Column, k: int) -> Column:
    """Hashes of the shingles; places after the last word count as null, which a hash passes over."""
    return F.transform(_starts(w, k), lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(k))))


def shingles(w: Column, k: int) -> Column:
    """Shingles as text, repeated ones too (sets of strings in an array would take quadratic time)."""
    return F.transform(_starts(w, k), lambda i: F.array_join(F.slice(w, i, k), " "))


def _need(n: Column, pct: int) -> Column:
    return F.ceil(n * pct / F.lit(100.0)).cast("int")


def text_key() -> dict[str, Column]:
    """Two 64-bit hashes of the text."""
    return {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), "text")}


def leaking(docs: DataFrame, items: DataFrame, k: int = 5, pct: int = 80, most_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (t1, t2) that hold pct % or more of an item's shingles, with the item; the distinct items; the items' ids."""
    i = items.select("item_id", words("text").alias("w")).filter("w is not null")
    i = table(i.select("item_id", "w", F.xxhash64(F.array_join("w", " ")).alias("item")), "leak-items")
    wanted = table(i.dropDuplicates(["item"]).select("item", "w").select("item", F.explode(shingles(F.col("w"), k)).alias("g")).distinct(), "leak-shingles")
    unique = i.dropDuplicates(["item"]).join(wanted.groupBy("item").agg(F.count("*").cast("int").alias("n")), "item").withColumn("need", _need(F.col("n"), pct))
    unique = table(unique.select("item", "n", "need", F.slice(F.array_sort(F.array_distinct(hashes(F.col("w"), k))), 1, F.col("n") - F.col("need") + 1).alias("sketch")), "leak-sketches")
    sketches = unique.select("item", "need", F.explode("sketch").alias("h"))

    # the largest sketch value that documents of up to 2**c shingles can meet; at most 32 rows
    edges = unique.groupBy(F.ceil(F.log2("need")).cast("int").alias("c")).agg(F.max(F.element_at("sketch", -1)).alias("top")).orderBy("c").collect()
    limit, top = F.lit(None).cast("long"), None
    for r in edges:
        top = r["top"] if top is None else max(top, r["top"])
        limit = F.when(F.col("size") > (1 << max(r["c"] - 1, 0)) - (r["c"] == 0), F.lit(top)).otherwise(limit)

    keyed = docs.select("doc_id", "text").withColumns(text_key())
    d = keyed.select("t1", "t2", words("text").alias("w")).filter("w is not null").withColumn("size", F.greatest(F.size("w") - (k - 1), F.lit(1)))
    d = d.select("t1", "t2", "size", limit.alias("top"), hashes(F.col("w"), k).alias("h"))
    signature = d.select("t1", "t2", "size", F.explode(F.filter("h", lambda x: x <= F.col("top"))).alias("h"))
    hits = signature.join(fits(sketches, most_broadcast), "h").filter("need <= size").select("t1", "t2", "item")
    candidates = table(hits.distinct(), "leak-candidates")

    texts = candidates.select("t1", "t2").distinct()
    found = keyed.filter("text is not null").join(fits(texts, most_broadcast), ["t1", "t2"]).select("t1", "t2", words("text").alias("w"))
    found = found.select("t1", "t2", F.explode(shingles(F.col("w"), k)).alias("g"))
    shared = found.join(fits(wanted, most_broadcast), "g").join(candidates, ["t1", "t2", "item"], "left_semi")
    counts = shared.groupBy("t1", "t2", "item").agg(F.countDistinct("g").alias("n_shared"))
    leaks = table(counts.join(unique.select("item", "n", "need"), "item").filter("n_shared >= need").select("t1", "t2", "item", "n_shared"), "leaks")
    return leaks, unique, i


def contained(docs: DataFrame, items: DataFrame, k: int = 5, pct: int = 80, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared) for every document that holds pct % or more of an item's shingles."""
    leaks, unique, i = leaking(docs, items, k, pct, most_broadcast)
    keyed = docs.select("doc_id", "text").withColumns(text_key())
    of_items = leaks.join(unique.select("item", F.col("n").cast("long").alias("n_shingles")), "item").join(i.select("item", "item_id"), "item")
    return keyed.select("doc_id", "t1", "t2").join(fits(of_items, most_broadcast), ["t1", "t2"]).select("doc_id", "item_id", "n_shingles", F.col("n_shared").cast("long").alias("n_shared"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(source(spark, sf_dir, "documents"), source(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT r, doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM dw WHERE len(w) > 0),
i AS (SELECT q, item_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS gs FROM iw WHERE len(w) > 0),
ig AS (SELECT q, item_id, CAST(len(gs) AS BIGINT) AS n_shingles, unnest(gs) AS g FROM i)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN ig USING (g)
GROUP BY r, doc_id, q, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""
