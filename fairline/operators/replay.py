"""Replay of saved responses: results are kept by request and content, only what is missing or has grown is rebuilt."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.operators import publishing

CONTENT = ("rows", "sum1", "sum2")


def contents(responses: DataFrame, request: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """request and the content of its saved response: an order-independent digest of its rows."""
    return publishing.digests(responses, columns, request)


def plan(candidates: DataFrame, saved: DataFrame, stored: DataFrame, request: Sequence[str]) -> DataFrame:
    """request, state and the content to keep, for every candidate.

    saved: contents of the responses at hand; stored: request and content of the results of an earlier run.
    REUSED the content is unchanged, GROWN it differs, MISSING there is no result yet, KEPT the response is not at hand
    any more but its result is, UNPROCESSED neither is. Results of requests that are no candidates are not looked at.
    """
    c = F.struct(*CONTENT)
    j = candidates.select(*request).distinct().join(saved.select(*request, c.alias("_now")), list(request), "left")
    j = j.join(stored.select(*request, c.alias("_then")).distinct(), list(request), "left")
    now, then = F.col("_now"), F.col("_then")
    state = (
        F.when(now.isNull() & then.isNull(), "UNPROCESSED").when(now.isNull(), "KEPT").when(then.isNull(), "MISSING").when(now == then, "REUSED").otherwise("GROWN")
    )
    return j.select(*request, state.alias("state"), F.coalesce(now, then).alias("content"))


def replay(planned: DataFrame, responses: DataFrame, stored: DataFrame, request: Sequence[str], rebuild: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The results of all candidates: stored ones as they are, those of missing and grown responses by `rebuild`.

    Only the rows of the responses to be rebuilt reach it. stored: request, content columns and those of the results;
    the output has the same columns, with the content that each result now stands for.
    """
    again = planned.filter(F.col("state").isin("MISSING", "GROWN")).select(*request, "content.*")
    kept = stored.join(planned.filter(F.col("state").isin("REUSED", "KEPT")).select(*request), list(request), "left_semi")
    built = rebuild(responses.join(again.select(*request), list(request), "left_semi")).join(again, list(request))
    return kept.unionByName(built.select(*kept.columns))
