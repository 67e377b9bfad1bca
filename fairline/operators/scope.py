"""Which competitions are in scope: exclusions, the allow-list with its conflicts, resolution of target lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import names
from fairline.functions.reasons import blank, first_reason

EXCLUDED = "EXCLUDED_COMPETITION"


def _fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def exclusions(rows: DataFrame, bindings: DataFrame, row_id: str) -> DataFrame:
    """row_id, excluded: whether a row's competition is bound to an exclusion, by (provider, id) or by (country, name).

    rows: provider, tournament_id, country, league; a league text `Country - Name` gives the country if there is none.
    bindings: provider, provider_id, provider_country, provider_name, canonical_name. Names and countries without case.
    """
    split = F.coalesce(F.col("country"), F.lit("")) == ""
    both = F.split("league", " - ", 2)
    labelled = split & (F.size(both) == 2)
    r = rows.select(row_id, F.concat_ws("|", "provider", F.col("tournament_id").cast("string")).alias("by_id"), F.col("tournament_id").isNotNull().alias("has_id"),
                    F.concat_ws("|", _fold(F.when(labelled, F.get(both, F.lit(0))).otherwise(F.col("country"))), _fold(F.when(labelled, F.get(both, F.lit(1))).otherwise(F.col("league")))).alias("by_name"))
    ids = bindings.select(F.concat_ws("|", "provider", F.col("provider_id").cast("string")).alias("by_id"), F.lit(True).alias("id_hit")).distinct()
    named = bindings.select(F.explode(F.array("provider_name", "canonical_name")).alias("n"), "provider_country").select(F.concat_ws("|", _fold(F.col("provider_country")), _fold(F.col("n"))).alias("by_name"), F.lit(True).alias("name_hit")).distinct()
    j = r.join(ids, "by_id", "left").join(named, "by_name", "left")
    return j.select(row_id, (F.coalesce(F.col("id_hit") & F.col("has_id"), F.lit(False)) | F.coalesce("name_hit", F.lit(False))).alias("excluded"))


def allow_list(rows: DataFrame, mappings: DataFrame, approved: DataFrame, countries: DataFrame, row_id: str) -> DataFrame:
    """row_id, canonical_id, reason: the approved competition that a row's provider id is verified for.

    mappings: provider, provider_id, canonical_id, verified; a provider id with two approved targets maps to none. approved:
    canonical_id. countries: canonical_id, country (every accepted spelling). rows: provider, tournament_id, canonical (an
    id that the row already carries) and country, which may be null.
    """
    ok = mappings.filter("verified").join(approved.select("canonical_id").distinct(), "canonical_id", "left_semi")
    one = ok.groupBy("provider", F.col("provider_id").alias("tournament_id")).agg(F.min("canonical_id").alias("canonical_id"), F.max("canonical_id").alias("_other"))
    accepted = countries.groupBy("canonical_id").agg(F.collect_set(_fold(F.col("country"))).alias("accepted"))
    j = rows.join(one.filter("canonical_id = _other").drop("_other"), ["provider", "tournament_id"], "left").join(accepted, "canonical_id", "left")
    reason = first_reason([
        (F.col("tournament_id").isNull(), "COMPETITION_ID_MISSING"), (F.col("canonical_id").isNull(), "COMPETITION_UNMAPPED"), (F.col("canonical").isNotNull() & (F.col("canonical") != F.col("canonical_id")), "CANONICAL_ID_CONFLICT"),
        (~blank(F.col("country")) & ~F.coalesce(F.array_contains("accepted", _fold(F.col("country"))), F.lit(False)), "COUNTRY_CONFLICT"),
    ])
    return j.select(row_id, F.when(reason.isNull(), F.col("canonical_id")).alias("canonical_id"), reason.alias("reason"))


def resolve_targets(targets: DataFrame, rows: DataFrame) -> DataFrame:
    """universe, country, hits, tournament_id, reason: exactly one catalog row per target, or none.

    targets: universe, country, accepted (countries as the provider writes them), aliases. rows: tournament_id, category,
    name, slug. The category must be accepted as it stands and the name or the slug be an alias, by their folded letters.
    """
    key = names.alnum_key
    t = targets.select("universe", "country", F.explode(F.array_distinct(F.concat("accepted", F.array("country")))).alias("category"), "aliases")
    wanted = t.select("universe", "country", "category", F.explode(F.array_distinct(F.transform("aliases", key))).alias("key")).filter("key <> ''")
    offered = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "tournament_id", "category", F.explode(F.array_distinct(F.array(key(F.col("name")), key(F.col("slug"))))).alias("key")).filter("key <> ''")
    hit = wanted.join(offered, ["category", "key"]).select("universe", "country", "row", "tournament_id").distinct()
    g = hit.groupBy("universe", "country").agg(F.count("*").alias("hits"), F.min("tournament_id").alias("one"))
    j = targets.select("universe", "country").distinct().join(g, ["universe", "country"], "left")
    n = F.coalesce("hits", F.lit(0))
    reason = F.when(n == 0, "UNRESOLVED").when(n > 1, "AMBIGUOUS").when(F.col("one").isNull(), "TOURNAMENT_ID_MISSING")
    return j.select("universe", "country", n.cast("long").alias("hits"), F.when(reason.isNull(), F.col("one")).alias("tournament_id"), reason.alias("reason"))
