"""Why something is as it is: changes of proofs, causes per fixture, cohorts and their rounds, persistence, market markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.reasons import first_reason, truly
from fairline.sources.feeds import MARKET_MAP, parsed


# ---- two evidence worlds in one pass ----------------------------------------------------------
def proof_delta(evidence: DataFrame, scope: str, entity: str, alias: str, worlds: str, least: int = 2) -> DataFrame:
    """scope, entity and its state in world 2 against world 1: KEPT, GAINED, LOST, NEWLY_AMBIGUOUS or UNPROVEN.

    worlds: bit mask per evidence row, bit 1 for the world without and bit 2 for the world with the extra evidence. An
    entity is proven in a world if its evidence there, at least `least` rows, names one alias that nobody else in the
    scope has. Rows are reduced to (scope, entity, alias) cells with a count per world, so neither world is run twice.
    """
    n = lambda w: F.count_if(F.col(worlds).bitwiseAND(w) != 0)
    cells = evidence.filter(F.col(entity).isNotNull() & F.col(alias).isNotNull()).groupBy(scope, entity, alias).agg(n(1).alias("n1"), n(2).alias("n2"))
    owners = cells.groupBy(scope, alias).agg(*[F.count_if(F.col(f"n{w}") > 0).alias(f"o{w}") for w in (1, 2)])
    per = cells.join(owners, [scope, alias]).groupBy(scope, entity).agg(*[x for w in (1, 2) for x in (
        F.sum(f"n{w}").alias(f"n{w}"), F.count_if(F.col(f"n{w}") > 0).alias(f"a{w}"), F.max(F.when(F.col(f"n{w}") > 0, F.col(f"o{w}"))).alias(f"o{w}"))])
    proven = lambda w: F.coalesce((F.col(f"a{w}") == 1) & (F.col(f"o{w}") == 1) & (F.col(f"n{w}") >= least), F.lit(False))
    doubt = lambda w: F.coalesce((F.col(f"a{w}") > 1) | (F.col(f"o{w}") > 1), F.lit(False))
    state = (
        F.when(proven(1) & proven(2), "KEPT").when(proven(2), "GAINED").when(proven(1), "LOST").when(doubt(2) & ~doubt(1), "NEWLY_AMBIGUOUS").otherwise("UNPROVEN")
    )
    return per.select(scope, entity, state.alias("state"), proven(1).alias("proven_before"), proven(2).alias("proven_after"))


# ---- causes -----------------------------------------------------------------------------------
# Causes by rank; of all that apply to a fixture the highest is the cause.
CAUSES = (
    "INSUFFICIENT_EVIDENCE", "MARKET_UNAVAILABLE", "COLLECTOR_FAILURE", "PROVIDER_FAILURE", "AUDITED", "QUOTA_SKIPPED", "VALID_ODDS", "ALREADY_KICKOFF",
)
# Words of an audit's reason that point to the mapping.
MAPPING_WORDS = "MAPPING|UNMAPPED|ID_CONFLICT"


def rank(cause: str) -> Column:
    return F.lit(CAUSES.index(cause))


def causes(schedule: DataFrame, responses: DataFrame, audits: DataFrame, valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, cause, provider_reason of every scheduled fixture: the deepest stage that any evidence shows.

    schedule: keys, started (kickoff has passed), requested, errors (the run had some), answered (the run got a response);
    responses, valid: keys; audits: keys, at, reason (the latest counts). Each table gives rows (keys, stage, detail) and
    one maximum per fixture over their union decides; evidence of fixtures that were not scheduled is left out.
    """
    told = F.struct("at", "reason")
    none = F.lit(None).cast(audits.select(told.alias("t")).schema["t"].dataType)
    of_run = F.when(truly(F.col("errors")), rank("PROVIDER_FAILURE")).when(truly(F.col("answered")), rank("MARKET_UNAVAILABLE")).otherwise(rank("INSUFFICIENT_EVIDENCE"))
    stage = F.when(truly(F.col("started")), rank("ALREADY_KICKOFF")).when(~truly(F.col("requested")), rank("QUOTA_SKIPPED")).otherwise(of_run)
    rows = [
        schedule.select(*keys, stage.alias("stage"), F.lit(True).alias("planned"), none.alias("told")),
        responses.select(*keys, rank("COLLECTOR_FAILURE").alias("stage"), F.lit(False).alias("planned"), none.alias("told")),
        audits.select(*keys, rank("AUDITED").alias("stage"), F.lit(False).alias("planned"), told.alias("told")),
        valid.select(*keys, rank("VALID_ODDS").alias("stage"), F.lit(False).alias("planned"), none.alias("told")),
    ]
    g = reduce(DataFrame.unionByName, rows).groupBy(*keys).agg(F.max("stage").alias("stage"), F.max("planned").alias("planned"), F.max("told").alias("told")).filter("planned")
    reason = F.col("told.reason")
    audited = F.when(F.coalesce(reason, F.lit("")).rlike(MAPPING_WORDS), "MAPPING_FAILURE").when(reason == "OK", "VALIDATION_REJECTED").otherwise("MARKET_UNAVAILABLE")
    named = F.get(F.array(*[F.lit(x) for x in CAUSES]), F.col("stage"))
    return g.select(*keys, F.when(F.col("stage") == rank("AUDITED"), audited).otherwise(named).alias("cause"), reason.alias("provider_reason"))


# ---- intervals and instants -------------------------------------------------------------------
def interval_join(windows: DataFrame, events: DataFrame, keys: Sequence[str], start: str, end: str, at: str, bin_us: int, per_part: int = 100_000) -> DataFrame:
    """Windows with the events of equal keys in [start, end).

    A window is filed in each time bin that it covers, an event in one, so the join is an equality with the exact test
    behind it. A bin with more than per_part events is dealt over parts, to each of which its windows are copied. Choose
    bins about as long as the windows. Null keys or instants and empty windows join nothing.
    """
    bin_of = lambda x: F.floor(x / F.lit(bin_us)).cast("long")
    inside = events.filter(F.col(at).isNotNull()).withColumn("_bin", bin_of(F.col(at)))
    by = [*keys, "_bin"]
    parts = inside.groupBy(*by).agg(F.ceil(F.count("*") / per_part).cast("int").alias("_parts"))
    spread = inside.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(*events.columns), F.col("_parts").cast("long")).cast("int")).drop("_parts")
    filed = windows.filter(F.col(start) < F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end) - 1))))
    filed = filed.join(parts, by).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return filed.join(spread, [*by, "_part"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin", "_part")


def cohort_reason(past: Column, requested: Column, skipped: Column, seen: Column, errors: Column, quoted: Column, core: Column, told: Column) -> Column:
    """What became of a fixture of a cohort at a round."""
    said = F.coalesce(F.when(told != "", told), F.lit("NO_VERIFIED_PREMATCH_ODDS"))
    fixed = first_reason([
        (past & ~seen, "KICKOFF_PASSED"), (~requested & skipped, "SKIPPED_QUOTA"), (~requested, "UNQUERIED"), (~seen & errors, "API_FAILURE"),
        (~seen, "NO_FIXTURE_IN_PROVIDER_RESPONSE"), (core, "OBSERVED_CORE_ODDS"), (quoted, "OBSERVED_OUTSIDE_CORE_PRICE"),
    ])
    return F.coalesce(fixed, said)


# ---- persistence of candidates ----------------------------------------------------------------
def persistence(rows: DataFrame, first: str, latest: str, member: str, switched: Column, histograms: dict[str, Column]) -> DataFrame:
    """Per candidate: members touched, hits first and latest, persisted, appeared, disappeared, rate, switches, histograms.

    rows carry the candidate ids seen first and latest as arrays of strings. One explode of their union makes sparse cells (candidate,
    kind, bucket): one kind for the members, so that distinct ones are cells and no wide distinct is needed, and one per
    histogram. The first aggregate counts cells, the second packs them; a map holds as many entries as the candidate has
    buckets. Null buckets count as UNKNOWN; a null set is empty.
    """
    none = F.array().cast("array<string>")
    a, b = F.coalesce(F.col(first), none), F.coalesce(F.col(latest), none)
    cell = lambda kind, bucket: F.struct(F.lit(kind).alias("kind"), F.coalesce(bucket.cast("string"), F.lit("UNKNOWN")).alias("bucket"))
    kinds = F.array(cell("all", F.lit("")), cell("member", F.col(member)), *[cell(k, v) for k, v in histograms.items()])
    hit = rows.select(a.alias("a"), b.alias("b"), F.coalesce(switched, F.lit(False)).alias("s"), F.col(member).isNotNull().alias("m"), kinds.alias("kinds"))
    hit = hit.withColumn("candidate", F.explode(F.array_union("a", "b"))).filter("candidate is not null")
    was, now = F.array_contains("a", F.col("candidate")), F.array_contains("b", F.col("candidate"))
    flags = {"first_hits": was, "latest_hits": now, "persisted": was & now, "appeared": now & ~was, "disappeared": was & ~now, "switched": F.col("s"), "present": F.col("m")}
    flat = hit.select("candidate", *[v.alias(k) for k, v in flags.items()], F.inline("kinds"))
    cells = flat.groupBy("candidate", "kind", "bucket").agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in flags])
    total = lambda k: F.sum(F.when(F.col("kind") == "all", F.col(k))).alias(k)
    packed = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("bucket", "n"))))).alias(k)
    g = cells.groupBy("candidate").agg(
        F.count_if((F.col("kind") == "member") & (F.col("present") > 0)).alias("members"), *[total(k) for k in flags if k != "present"], *[packed(k) for k in histograms]
    )
    base = F.col("persisted") + F.col("disappeared")
    return g.withColumn("persistence_rate", F.when(base > 0, F.round(F.col("persisted") / base, 4)))


# ---- line markers -----------------------------------------------------------------------------
KNOWN, HANDICAP, HOME, AWAY, HOME_TRUE, HOME_FALSE, AWAY_TRUE, AWAY_FALSE = (1 << i for i in range(8))


def _player(outcome: Column) -> Column:
    players = outcome["players"]
    return F.coalesce(players.getItem("0"), F.get(F.map_values(players), F.lit(0)))


def marker_bits(docs: DataFrame, doc: str, key: str, bookmaker: str, catalog: DataFrame) -> DataFrame:
    """A row per market of the bookmaker in a document: market_id, active, bits; documents without the book have one with null market_id.

    catalog: market_id, handicap_market (bool), home_id, away_id, handicap; one row a market. Bits: known to the catalog,
    a handicap, home and away selection there and active, and for each of them the line marker set or unset.
    """
    d = parsed(docs, doc, MARKET_MAP, key).withColumn("book", F.col("e.bookmakerOdds").getItem(bookmaker))
    d = d.select(key, F.col("book").isNotNull().alias("has_book"), F.col("book.bookmakerIsActive").alias("book_active"), F.col("book.suspended").alias("suspended"), F.explode_outer("book.markets").alias("market_id", "m"))
    j = d.join(catalog.withColumn("known", F.lit(True)), "market_id", "left")
    side = lambda i: _player(F.col("m.outcomes").getItem(F.col(i)))
    j = j.select(key, "has_book", "book_active", "suspended", "market_id", F.col("m.marketActive").alias("active"), "handicap", truly(F.col("known")).alias("known"), truly(F.col("handicap_market")).alias("ah"), side("home_id").alias("h"), side("away_id").alias("a"))
    on = lambda cond, bit: F.when(truly(cond), F.lit(bit)).otherwise(F.lit(0))
    marks = lambda p, there, yes, no: on(F.col(f"{p}.active"), there) + on(F.col(f"{p}.mainLine"), yes) + on(~F.col(f"{p}.mainLine"), no)
    bits = on(F.col("known"), KNOWN) + on(F.col("ah"), HANDICAP) + marks("h", HOME, HOME_TRUE, HOME_FALSE) + marks("a", AWAY, AWAY_TRUE, AWAY_FALSE)
    return j.select(key, "has_book", "book_active", "suspended", "market_id", "active", "handicap", bits.alias("bits"))


def _has(bits: int) -> Column:
    return F.col("bits").bitwiseAND(bits) == bits


def signature() -> Column:
    word = lambda yes, no: F.when(_has(yes), "TRUE").when(_has(no), "FALSE").otherwise("MISSING")
    return F.concat(F.lit("H_"), word(HOME_TRUE, HOME_FALSE), F.lit("__A_"), word(AWAY_TRUE, AWAY_FALSE))


def _signatures(cond: Column) -> Column:
    """Counts per signature, as a map; at most nine entries."""
    names = F.collect_list(F.when(cond, signature()))
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(names)), lambda s: F.struct(s, F.size(F.filter(names, lambda x: x == s)))))


def marker_diagnostic(markets: DataFrame, key: str) -> DataFrame:
    """Per document: active markets, those the catalog knows, unknown ids, active handicaps with both sides, signatures, state."""
    active = truly(F.col("active"))
    line = active & _has(KNOWN | HANDICAP | HOME | AWAY)
    g = markets.groupBy(key).agg(
        F.max("has_book").alias("has_book"), F.count_if(active).alias("active_markets"), F.count_if(active & _has(KNOWN)).alias("known_markets"),
        F.array_sort(F.collect_set(F.when(active & ~_has(KNOWN), F.col("market_id")))).alias("unknown_ids"), F.count_if(line).alias("handicaps"),
        F.count_if(line & _has(HOME_TRUE | AWAY_TRUE)).alias("_main"), _signatures(line).alias("signatures"),
    )
    state = (
        F.when(~F.col("has_book"), "NO_BOOKMAKER").when((F.col("handicaps") > 0) & (F.col("_main") > 0), "HAS_EXPLICIT_MAIN_AH").when(F.col("handicaps") > 0, "AH_PRESENT_NO_EXPLICIT_MAIN")
        .when(F.size("unknown_ids") > 0, "NO_RECOGNIZED_ACTIVE_AH_WITH_UNKNOWN_MARKETS").otherwise("NO_RECOGNIZED_ACTIVE_AH_MARKET")
    )
    return g.withColumn("state", state).drop("_main", "has_book")


def marker_shape(markets: DataFrame, key: str) -> DataFrame:
    """Per document: active handicap markets on the quarter grid, signatures whether or not the sides are active, lines marked on both."""
    grid = F.col("handicap").isNotNull() & (F.col("handicap") * 4 == F.round(F.col("handicap") * 4))
    line = truly(F.col("active")) & _has(KNOWN | HANDICAP) & grid
    both = line & _has(HOME_TRUE | AWAY_TRUE)
    return markets.groupBy(key).agg(F.count_if(line).alias("handicaps"), _signatures(line).alias("signatures"), F.array_sort(F.collect_list(F.when(both, F.col("handicap")))).alias("marked_lines"))


def odds_shape(markets: DataFrame, key: str, sample: int = 16) -> DataFrame:
    """Per document: state of the book, counts of its markets and the first `sample` market ids with what is known of them."""
    there = F.col("market_id").isNotNull()
    told = F.concat_ws(":", "market_id", F.when(_has(KNOWN), "known").otherwise("unknown"), (F.when(_has(HOME_TRUE), 1).otherwise(0) + F.when(_has(AWAY_TRUE), 1).otherwise(0)).cast("string"))
    return markets.groupBy(key).agg(
        F.max("has_book").alias("has_book"), F.max("book_active").alias("book_active"), F.max("suspended").alias("suspended"), F.count("market_id").alias("markets"),
        F.count_if(there & ~F.coalesce(~F.col("active"), F.lit(False))).alias("active_markets"), F.count_if(_has(KNOWN)).alias("catalog_matches"),
        F.slice(F.array_sort(F.collect_list(F.when(there, told))), 1, sample).alias("sample"),
    )


def marker_summary(shapes: DataFrame, key: str, sample: int = 20) -> DataFrame:
    """One row a signature over all documents: documents, markets and the first `sample` documents by key."""
    flat = shapes.select(key, F.explode("signatures").alias("signature", "n"))
    ranked = flat.groupBy("signature").agg(F.count("*").alias("documents"), F.sum("n").alias("markets"))
    firsts = reduce(DataFrame.unionByName, [flat.filter(F.col("signature") == s).orderBy(key).limit(sample) for s in SIGNATURES])
    return ranked.join(firsts.groupBy("signature").agg(F.array_sort(F.collect_list(key)).alias("sample")), "signature")


SIGNATURES = tuple(f"H_{h}__A_{a}" for h in ("TRUE", "FALSE", "MISSING") for a in ("TRUE", "FALSE", "MISSING"))
