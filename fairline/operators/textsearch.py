"""Search of many phrases in many texts without a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import names


def search_text(*parts: Column) -> Column:
    """Parts joined by blanks, accents folded, other non-ASCII letters dropped, small letters, dashes and low lines as blanks, single blanks."""
    text = F.regexp_replace(names.fold_accents(F.concat_ws(" ", *parts)), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.lower(text), r"[-_\s]+", " "))


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of that length; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, phrases: DataFrame, text_id: str, text: str, phrase_id: str, phrase: str, size: int = 3, per_task: int = 100_000) -> DataFrame:
    """(text_id, phrase_id) of every text that contains the phrase; both ids are unique.

    Every phrase is filed under its rarest q-gram (a phrase shorter than `size` under itself), texts are probed by those
    q-grams only, and candidates are verified. A q-gram that more than per_task texts hold is split: its postings are
    dealt over parts, and the phrases filed there are copied to each. Null and empty phrases and null texts match nothing.
    Texts, probes and postings are never broadcast: compressed, they may look small enough to pass through the driver.
    """
    wanted = phrases.filter(F.length(phrase) > 0).select(phrase_id, F.col(phrase).alias("_p"))
    sizes = [r[0] for r in wanted.select(F.least(F.length("_p"), F.lit(size)).alias("n")).distinct().collect()]  # at most `size` numbers
    if not sizes:
        return texts.select(text_id).join(wanted.select(phrase_id), F.lit(False))
    of_phrase = F.lit(None)
    for n in sorted(sizes):
        of_phrase = F.when(F.least(F.length("_p"), F.lit(size)) == n, grams(F.col("_p"), n)).otherwise(of_phrase)
    filed = wanted.select(phrase_id, F.explode(of_phrase).alias("gram"))
    probes = texts.select(text_id, F.explode(F.concat(*[grams(F.col(text), n) for n in sizes])).alias("gram")).join(filed.select("gram").distinct(), "gram", "left_semi")
    held = probes.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = filed.join(held, "gram").groupBy(phrase_id).agg(F.min(F.struct("n", "gram")).alias("m"))  # a q-gram that no text holds ends the phrase here
    every = filed.groupBy(phrase_id).agg(F.count("*").alias("all")).join(filed.join(held, "gram").groupBy(phrase_id).agg(F.count("*").alias("some")), phrase_id).filter("all = some")
    rarest = rarest.join(every.select(phrase_id), phrase_id).select(phrase_id, "m.gram", F.ceil(F.col("m.n") / per_task).cast("int").alias("parts"))
    used = rarest.select("gram", "parts").distinct()
    postings = probes.hint("merge").join(used, "gram").withColumn("part", F.pmod(F.xxhash64(text_id), F.col("parts").cast("long")).cast("int")).select("gram", "part", text_id)
    copies = rarest.join(wanted, phrase_id).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("gram", "part", phrase_id, "_p")
    candidates = postings.hint("merge").join(copies, ["gram", "part"]).select(text_id, phrase_id, "_p")
    return candidates.join(texts.select(text_id, text).hint("merge"), text_id).filter(F.contains(F.col(text), F.col("_p"))).select(text_id, phrase_id)
