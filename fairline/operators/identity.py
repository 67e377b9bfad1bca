"""Exact identity joins with uniqueness gates. A tie never picks a winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairline.functions import names
from fairline.functions.reasons import blank, first_reason


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id (only when exactly one match), matches, reason.

    The right side is first reduced to one row per key with a match count, so a duplicated key never multiplies
    the left rows.
    """
    r = right.groupBy(*keys).agg(F.count_distinct(right_id).alias("matches"), F.min(right_id).alias("_one"))
    j = left.select(left_id, *keys).join(r, list(keys), "left")
    n = F.coalesce("matches", F.lit(0))
    return j.select(
        left_id, F.when(n == 1, F.col("_one")).alias(right_id), n.cast("long").alias("matches"),
        F.when(n == 0, "UNMATCHED").when(n > 1, "AMBIGUOUS").alias("reason"),
    )


def cascade(left: DataFrame, right: DataFrame, levels: Sequence[tuple[str, Column, Column]], scope: Sequence[str], left_id: str, right_id: str) -> DataFrame:
    """First level with any match decides; more than one candidate on it is ambiguous.

    levels: (name, key on the left, key on the right). All levels join in one pass on (scope, level, key).
    """
    def keyed(df: DataFrame, side: int, idc: str) -> DataFrame:
        arr = F.array(*[F.struct(F.lit(i).alias("level"), lv[side].alias("key")) for i, lv in enumerate(levels)])
        return df.select(idc, *scope, F.explode(arr).alias("_l")).select(idc, *scope, "_l.level", "_l.key").filter(
            F.col("key").isNotNull() & (F.col("key") != "")
        )

    r = keyed(right, 2, right_id).groupBy(*scope, "level", "key").agg(
        F.count_distinct(right_id).alias("matches"), F.min(right_id).alias("_one")
    )
    hit = keyed(left, 1, left_id).join(r, [*scope, "level", "key"]).groupBy(left_id).agg(
        F.min(F.struct("level", "matches", "_one")).alias("b")
    )
    name = F.coalesce(*[F.when(F.col("b.level") == i, F.lit(lv[0])) for i, lv in enumerate(levels)])
    n = F.coalesce(F.col("b.matches"), F.lit(0))
    return left.select(left_id).join(hit, left_id, "left").select(
        left_id, F.when(n == 1, F.col("b._one")).alias(right_id), name.alias("level"),
        n.cast("long").alias("matches"), F.when(n == 0, "UNMATCHED").when(n > 1, "AMBIGUOUS").alias("reason"),
    )


def alias_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Match on shared aliases of every (left array, right array) pair within equal keys.

    One alias pair becomes part of the join key (exploded), so an instant shared by many fixtures does not pair
    them all; the remaining pairs are residual predicates. Multiple hits are counted once per right id.
    """
    (la, ra), rest = pairs[0], pairs[1:]
    lx = left.select(left_id, *keys, *[p[0] for p in rest], F.explode(la).alias("_alias"))
    rx = right.select(right_id, *keys, *[p[1] for p in rest], F.explode(ra).alias("_alias"))
    cond = F.lit(True)
    for a, b in rest:
        cond = cond & F.arrays_overlap(F.col(a), F.col(b))
    hits = lx.join(rx, [*keys, "_alias"]).filter(cond).groupBy(left_id).agg(
        F.count_distinct(right_id).alias("matches"), F.min(right_id).alias("_one")
    )
    n = F.coalesce("matches", F.lit(0))
    return left.select(left_id).join(hits, left_id, "left").select(
        left_id, F.when(n == 1, F.col("_one")).alias(right_id), n.cast("long").alias("matches"),
        F.when(n == 0, "UNMATCHED").when(n > 1, "AMBIGUOUS").alias("reason"),
    )


def identity_bridge(snaps: DataFrame, providers: tuple[str, str], id_col: str = "source_id",
                    identity: Sequence[str] = ("home", "away", "kickoff_us", "league")) -> DataFrame:
    """source_id, canonical_id, reason for ids whose exact identity is shared by one id of each provider.

    Aggregates only: per id (one identity or INCONSISTENT_IDENTITY), then per identity (exactly two members,
    one of each provider; the first provider's id is canonical). Members are bounded by the gate, not collected.
    """
    ident = F.struct(*identity)
    per_id = snaps.groupBy(id_col).agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.min("provider").alias("provider"), F.max("provider").alias("p2"))
    per_id = per_id.withColumn("bad", (F.col("lo") != F.col("hi")) | (F.col("provider") != F.col("p2")))
    first, second = providers
    good = per_id.filter(~F.col("bad") & F.col("provider").isin(first, second))
    groups = good.groupBy("lo").agg(
        F.count("*").alias("members"), F.count_if(F.col("provider") == first).alias("n1"), F.count_if(F.col("provider") == second).alias("n2"),
        F.min(F.when(F.col("provider") == first, F.col(id_col))).alias("canonical_id"),
    )
    j = per_id.join(groups, "lo", "left")
    bridged = (F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("members") == 2)
    reason = (
        F.when(F.col("bad"), "INCONSISTENT_IDENTITY").when(bridged, F.lit(None).cast("string"))
        .when(F.col("members") >= 2, "AMBIGUOUS_PROVIDER_IDENTITY").otherwise("NO_COUNTERPART")
    )
    ok = ~F.col("bad") & F.coalesce(bridged, F.lit(False))
    return j.select(id_col, F.when(ok, F.col("canonical_id")).alias("canonical_id"), F.when(~ok, reason).alias("reason"))


def feed_bridge(snaps: DataFrame, providers: tuple[str, str], book: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """source_id, canonical_id, policy, reason: ids of two feeds that are one match, by exact names, kickoff and competition.

    snaps: source_id, provider, provider_fixture_id, bookmaker, home, away, league, kickoff_us, observed_us; trusted rows
    in scope only. Gates of an id: one identity; nothing of it blank; a bridged provider whose prefix the id carries; all
    its rows of that book and before kickoff. aliases name competitions that are one. Bridged are exactly two ids: one
    of each provider, or of the first provider one with its native number and one whose hash its own fields reproduce.
    """
    first, second = providers
    ident, book_ok = F.struct("home", "away", "kickoff_us", "league"), F.lower("bookmaker").eqNullSafe(F.lit(book)) & (F.col("observed_us") < F.col("kickoff_us"))
    per_id = snaps.filter(F.coalesce("source_id", F.lit("")) != "").groupBy("source_id").agg(
        F.min(ident).alias("lo"), F.max(ident).alias("hi"), F.min("provider").alias("provider"), F.max("provider").alias("p2"), F.count("provider").alias("np"), F.count("*").alias("n"),
        F.min("provider_fixture_id").alias("pid"), F.min(F.coalesce(book_ok, F.lit(False))).alias("book_ok"),
    )
    text = [blank(F.col(f"lo.{x}")) for x in ("home", "away", "league")]
    own = F.coalesce((F.col("provider") == F.col("p2")) & (F.col("np") == F.col("n")), F.lit(False))
    prefix = F.col("provider").isin(first, second) & F.startswith(F.col("source_id"), F.concat("provider", F.lit(":")))
    gate = first_reason([
        (~F.col("lo").eqNullSafe(F.col("hi")), "INCONSISTENT_IDENTITY"), (text[0] | text[1] | text[2] | F.col("lo.kickoff_us").isNull(), "INCOMPLETE_IDENTITY"),
        (~F.coalesce(prefix, F.lit(False)), "PROVIDER_NOT_BRIDGED"), (~(own & F.col("book_ok")), "BOOK_OR_TIME_NOT_TRUSTED"),
    ])
    league = F.col("lo.league")
    for a, b in (aliases or {}).items():
        league = F.when(F.col("lo.league") == a, F.lit(b)).otherwise(league)
    number = F.expr(f"substring(source_id, {len(first) + 2})")
    mine = (F.col("provider") == first) & F.col("pid").eqNullSafe(number)
    hashed = F.substring(F.sha1(F.concat_ws("|", "lo.home", "lo.away", F.col("lo.kickoff_us").cast("string"))), 1, 16)
    ids = per_id.withColumn("gate", gate).select(
        "source_id", "provider", "gate", F.struct("lo.home", "lo.away", "lo.kickoff_us", league.alias("competition")).alias("match"),
        (mine & number.rlike("^[0-9]+$")).alias("native"), (mine & (number == hashed)).alias("reproduced"),
    )
    good = F.col("gate").isNull()
    is_first = F.col("provider") == first
    groups = ids.filter(good).groupBy("match").agg(
        F.count("*").alias("members"), F.count_if(is_first).alias("n1"), F.count_if("native").alias("natives"), F.count_if("reproduced").alias("hashes"),
        F.min(F.when(is_first, F.col("source_id"))).alias("of_first"), F.min(F.when(F.col("native"), F.col("source_id"))).alias("of_native"),
    )
    j = ids.join(groups, "match", "left")
    two = good & (F.col("members") == 2)
    duplicate, pair = two & (F.col("n1") == 2) & (F.col("natives") == 1) & (F.col("hashes") == 1), two & (F.col("n1") == 1)
    return j.select(
        "source_id", F.when(duplicate, F.col("of_native")).when(pair, F.col("of_first")).alias("canonical_id"),
        F.when(duplicate, "REPRODUCED_HASH_AND_NATIVE_ID").when(pair, "EXACT_MATCH_UNIQUE_PER_PROVIDER").alias("policy"),
        F.when(~good, F.col("gate")).when(duplicate | pair, F.lit(None).cast("string")).when(F.col("members") >= 2, "AMBIGUOUS_PROVIDER_IDENTITY").otherwise("NO_COUNTERPART").alias("reason"),
    )


def expand_evidence(evidence: DataFrame, snaps: DataFrame, existing: DataFrame) -> DataFrame:
    """evidence_id, fixture_id, outcome: reviewed results brought to all fixtures with exactly the reported match.

    evidence: evidence_id, fixture_ids (array), home, away, kickoff_us, competition (null: any), goals ft_home_goals and
    ft_away_goals, quality (a TIER_ status or the reason against it). Rejected evidence gives one row with a null fixture.
    Outcomes: WEB_EVIDENCE_<tier>, SKIPPED_TRUSTED (a result from elsewhere stays), or why not. existing: one per fixture.
    """
    key = names.alnum_key
    ident = F.struct(key(F.col("home")).alias("h"), key(F.col("away")).alias("a"), F.col("kickoff_us").alias("k"), key(F.col("league")).alias("l"))
    seen = snaps.groupBy("fixture_id").agg(F.min(ident).alias("lo"), F.max(ident).alias("hi"))
    ok = F.startswith(F.coalesce("quality", F.lit("")), F.lit("TIER_"))
    bad = evidence.filter(~ok).select("evidence_id", F.lit(None).cast(snaps.schema["fixture_id"].dataType).alias("fixture_id"), F.coalesce("quality", F.lit("MISSING_SOURCE_ASSERTIONS")).alias("outcome"))
    e = evidence.filter(ok).withColumn("m", F.struct(key(F.col("home")).alias("h"), key(F.col("away")).alias("a"), F.col("kickoff_us").alias("k"), F.when(~blank(F.col("competition")), key(F.col("competition"))).alias("l")))
    listed = e.select("evidence_id", F.explode("fixture_ids").alias("fixture_id")).filter("fixture_id is not null")
    by_match = seen.select("fixture_id", F.col("lo.h").alias("h"), F.col("lo.a").alias("a"), F.col("lo.k").alias("k"), F.col("lo.l").alias("l2"))
    same = e.select("evidence_id", "m.*").join(by_match, ["h", "a", "k"]).filter(F.col("l").isNull() | (F.col("l") == F.col("l2"))).select("evidence_id", "fixture_id")
    wanted = listed.union(same).distinct().join(e.select("evidence_id", "m", "quality", "ft_home_goals", "ft_away_goals"), "evidence_id")
    old = existing.select("fixture_id", "result_source", F.col("ft_home_goals").alias("oh"), F.col("ft_away_goals").alias("oa"), F.lit(True).alias("there"))
    j = wanted.join(seen, "fixture_id", "left").join(old, "fixture_id", "left")
    match = (F.col("lo.h") == F.col("m.h")) & (F.col("lo.a") == F.col("m.a")) & (F.col("lo.k") == F.col("m.k")) & (F.col("m.l").isNull() | (F.col("m.l") == F.col("lo.l")))
    web = F.startswith(F.coalesce("result_source", F.lit("")), F.lit("WEB_EVIDENCE"))
    differs = ~(F.col("oh").eqNullSafe(F.col("ft_home_goals")) & F.col("oa").eqNullSafe(F.col("ft_away_goals")))
    reason = first_reason([
        (~F.col("lo").eqNullSafe(F.col("hi")), "CONFLICTING_SOURCE_FIXTURE_IDENTITY"), (~F.coalesce(match, F.lit(False)), "IDENTITY_MISMATCH_OR_UNKNOWN_FIXTURE"),
        (F.col("there") & ~web, "SKIPPED_TRUSTED"), (F.col("there") & differs, "CONFLICT_WITH_EXISTING_WEB_EVIDENCE"),
    ])
    return j.select("evidence_id", "fixture_id", F.coalesce(reason, F.concat(F.lit("WEB_EVIDENCE_"), "quality")).alias("outcome")).unionByName(bad)


def project(rows: DataFrame, bridge: DataFrame, id_col: str = "source_id") -> DataFrame:
    """Re-key rows to the canonical id; the source id stays."""
    m = bridge.filter(F.col("canonical_id").isNotNull()).select(id_col, "canonical_id")
    return rows.join(m, id_col, "left").withColumn("fixture_key", F.coalesce("canonical_id", id_col)).drop("canonical_id")


def map_to_canonical(rows: DataFrame, mapping: DataFrame, on: Sequence[str], target: str, existing: str | None = None) -> DataFrame:
    """Canonical id by mapping; a different id already on the row is a conflict, not an overwrite.

    A key with several targets maps to none of them, and no row is multiplied.
    """
    one = mapping.groupBy(*on).agg(F.min(target).alias("_mapped"), F.max(target).alias("_other"))
    j = rows.join(one, list(on), "left")
    several = F.coalesce(F.col("_mapped") != F.col("_other"), F.lit(False))
    have = F.col(existing) if existing else F.lit(None).cast("string")
    conflict = have.isNotNull() & F.col("_mapped").isNotNull() & (have != F.col("_mapped"))
    return j.withColumn("canonical_id", F.when(~F.coalesce(conflict, F.lit(False)) & ~several, F.coalesce(F.col("_mapped"), have))).withColumn(
        "reason", F.when(several, "MAPPING_NOT_UNIQUE").when(conflict, "CANONICAL_ID_CONFLICT").when(F.coalesce(F.col("_mapped"), have).isNull(), "UNMAPPED")
    ).drop("_mapped", "_other")


def reuse_results(fixtures: DataFrame, results: DataFrame, identity: Sequence[str], blocked: DataFrame) -> DataFrame:
    """Scores reused for fixtures without one, through a full identity that carries a single score."""
    ident = F.struct(*identity)
    scored = fixtures.join(results.select("fixture_id", "ft_home_goals", "ft_away_goals"), "fixture_id")
    score = F.struct("ft_home_goals", "ft_away_goals")
    one = (
        scored.join(blocked.select("fixture_id"), "fixture_id", "left_anti")
        .groupBy(ident.alias("_i"))
        .agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.min("fixture_id").alias("reused_from"))
        .filter(F.col("lo") == F.col("hi"))
    )
    need = fixtures.join(results.select("fixture_id"), "fixture_id", "left_anti").join(blocked.select("fixture_id"), "fixture_id", "left_anti")
    return need.withColumn("_i", ident).join(one, "_i").select("fixture_id", "lo.ft_home_goals", "lo.ft_away_goals", "reused_from")


def nearest_offset(probes: DataFrame, others: DataFrame, keys: Sequence[str], time: str, probe_id: str) -> DataFrame:
    """Minutes to the nearest other instant of the key, before or after (diagnostics).

    One instant per (key, time) on the other side; neighbours by ordered window over distinct instants.
    """
    o = others.select(*keys, F.col(time).alias("_o")).distinct().withColumn("_t", F.col("_o"))
    p = probes.select(*keys, F.col(time).alias("_t")).distinct()
    u = o.unionByName(p, allowMissingColumns=True).groupBy(*keys, "_t").agg(F.max("_o").alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_t")
    prev = F.last("_o", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    nxt = F.first("_o", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = u.withColumn("_b", prev).withColumn("_a", nxt).select(*keys, F.col("_t").alias(time), F.least(
        F.col("_t") - F.col("_b"), F.col("_a") - F.col("_t")).alias("_gap"))
    return probes.join(near, [*keys, time], "left").select(probe_id, (F.col("_gap") / F.lit(60_000_000.0)).alias("nearest_minutes"))


def result_cascade(missing: DataFrame, events: DataFrame, aliases: DataFrame) -> DataFrame:
    """fixture_id, outcome, level, event_id and score of fixtures without a result, from a day's events.

    missing: fixture_id, home, away, league, kickoff_us. events: event_id, home, away, league, kickoff_us, finished, hg,
    ag. aliases: league, name, club, reviewed and valid in that league only. Both teams and the kickoff must agree at one
    level: exact keys, keys without edge designators, reviewed aliases within an equal league, or keys without the
    category that the fixture's league and the event have. The first level with a match decides; more than one event
    there (copies that differ count) is AMBIGUOUS; a single one must be finished with two whole scores.
    """
    norm, club = names.alnum_key, names.club_key
    e = events.select("event_id", "home", "away", "league", "kickoff_us", "finished", "hg", "ag").distinct()
    e = e.withColumn("copy", F.xxhash64(*e.columns))
    one = aliases.groupBy(norm(F.col("league")).alias("_l"), norm(F.col("name")).alias("_n")).agg(F.min("club").alias("c1"), F.max("club").alias("c2")).filter("c1 = c2")
    m = missing.withColumn("_l", norm(F.col("league")))
    for side in ("home", "away"):
        look = one.select("_l", F.col("_n").alias(f"_{side}"), F.col("c1").alias(f"{side}_club"))
        m = m.withColumn(f"_{side}", norm(F.col(side))).join(look, ["_l", f"_{side}"], "left")
    m = m.withColumn("_cat", names.category(F.col("league")))
    e = e.withColumn("_cat", F.coalesce(names.category(F.col("league")), names.category(F.col("home")), names.category(F.col("away"))))
    key = lambda *parts: F.concat_ws("|", *parts)
    home, away, league = F.col("home"), F.col("away"), F.col("league")
    both = lambda f: key(f(home), f(away))
    base = lambda x: names.category_base_key(x, F.col("_cat"))
    in_category = F.when(F.coalesce("_cat", F.lit("")) != "", key(F.col("_cat"), both(base)))
    reviewed = key(norm(league), club(F.coalesce("home_club", home)), club(F.coalesce("away_club", away)))
    levels = [("EXACT", both(norm), both(norm)), ("CLUB", both(club), both(club)), ("REVIEWED_ALIAS", F.when(norm(league) != "", reviewed), F.when(norm(league) != "", key(norm(league), both(club)))), ("CATEGORY", in_category, in_category)]
    hit = cascade(m, e, levels, ["kickoff_us"], "fixture_id", "copy")
    near = e.select("kickoff_us", F.lit(True).alias("near")).distinct()
    j = hit.join(missing.select("fixture_id", "kickoff_us").join(near, "kickoff_us", "left").select("fixture_id", "near"), "fixture_id").join(e.select("copy", "event_id", "finished", "hg", "ag"), "copy", "left")
    usable = F.coalesce(F.col("finished") & (F.least("hg", "ag") >= 0) & F.col("hg").isNotNull() & F.col("ag").isNotNull() & F.col("event_id").isNotNull(), F.lit(False))
    outcome = (
        F.when(F.col("reason") == "AMBIGUOUS", "AMBIGUOUS").when(F.col("reason").isNotNull(), F.when(F.col("near"), "KICKOFF_CANDIDATE_ONLY").otherwise("NO_EXACT_IDENTITY")).when(~usable, "EXACT_IDENTITY_UNFINISHED").otherwise("MATCHED")
    )
    ok = lambda c: F.when(outcome == "MATCHED", F.col(c))
    return j.select("fixture_id", outcome.alias("outcome"), "level", ok("event_id").alias("event_id"), ok("hg").alias("ft_home_goals"), ok("ag").alias("ft_away_goals"))


def attach_external(snaps: DataFrame, refs: DataFrame, run_at: Column, key: str = "fixture_id") -> DataFrame:
    """snaps with external ids and their source, on the rows of one observation run only; several refs of a fixture are none.

    refs: the key and external, a map of provider to exact id; null and empty maps add nothing.
    """
    one = refs.filter(F.size(F.coalesce("external", F.create_map().cast("map<string,string>"))) > 0).groupBy(key).agg(F.count("*").alias("_n"), F.first("external").alias("_x")).filter("_n = 1")
    j = snaps.join(one.select(key, "_x"), key, "left")
    mine = F.coalesce(run_at, F.lit(False)) & F.col("_x").isNotNull()
    return j.withColumns({"external": F.when(mine, F.col("_x")), "external_source": F.when(mine, "CURRENT_EXACT_EXTERNAL_IDS")}).drop("_x")


def official_aliases(records: DataFrame, memberships: DataFrame, clubs: DataFrame, declared: str | None = None, languages: Sequence[str] = ()) -> DataFrame:
    """competition, club, alias, reason: a row per label of an official record, or one with the rule that the record breaks.

    records: record, competition, club, canonical, official_id, labels (array), sources (array of struct(language, entity_id)),
    and with `declared` the array of labels that the sources must give, no more and no fewer. The club must belong to the
    competition under this canonical name, occur in one record, and every source must name the record's official id.
    A label that ends in the words Football Club also counts without them.
    """
    rec = records.join(memberships.select("club", F.col("competition").alias("_c")).groupBy("club").agg(F.collect_set("_c").alias("_cs")), "club", "left")
    rec = rec.join(clubs.groupBy("club").agg(F.min("canonical_name").alias("_n")), "club", "left")
    times_used = records.groupBy("club").agg(F.count("*").alias("_times"))
    rec = rec.join(times_used, "club", "left")
    labels = F.array_sort(F.array_distinct(F.filter("labels", lambda x: ~blank(x))))
    rules = [
        (F.col("_times") > 1, "CLUB_IN_SEVERAL_RECORDS"), (~F.coalesce(F.array_contains("_cs", F.col("competition")), F.lit(False)), "NOT_A_MEMBER"), (~F.col("_n").eqNullSafe(F.col("canonical")), "CANONICAL_NAME_DIFFERS"),
        (F.coalesce(F.size("sources"), F.lit(0)) < 1, "NO_SOURCE"), (~F.coalesce(F.forall("sources", lambda s: s["entity_id"].eqNullSafe(F.col("official_id"))), F.lit(False)), "OFFICIAL_ID_DIFFERS"),
    ]
    if languages:
        rules.append((F.array_sort(F.array_distinct(F.transform("sources", lambda s: s["language"]))) != F.array(*[F.lit(x) for x in sorted(languages)]), "LANGUAGES_DIFFER"))
    if declared is not None:
        rules.append((~labels.eqNullSafe(F.array_sort(F.array_distinct(F.coalesce(declared, F.array().cast("array<string>"))))), "LABELS_DIFFER"))
    short = F.transform(F.filter(labels, lambda x: F.lower(x).endswith(" football club")), lambda x: F.regexp_replace(x, r"(?i)\s* football club$", ""))
    told = rec.select("competition", "club", first_reason(rules).alias("reason"), F.array_union(labels, short).alias("all"))
    good = told.filter("reason is null").select("competition", "club", F.explode("all").alias("alias"), "reason")
    return good.unionByName(told.filter("reason is not null").select("competition", "club", F.lit(None).cast("string").alias("alias"), "reason"))
