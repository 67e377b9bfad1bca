"""Reason-coded validity rules for quotes, snapshots, evidence and scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions import names, times
from fairline.functions.lines import on_grid
from fairline.functions.reasons import blank, first_reason, truly

# Pre-match statuses.
PREMATCH_STATUSES = ("scheduled", "pre_match", "prematch", "open")
CORE = (1.80, 2.20)


def execution_reason(
    now_us: Column, *, status: Column, stale: Column, tradable: Column, current_feed: Column,
    observed_at: Column, as_of: Column, freshness_basis: Column, max_age_minutes: int = 30,
) -> Column:
    """Null when a quote may be executed. A verified current feed is judged by its observation time,
    any other source by its quote time."""
    current = truly(current_feed)
    stamp_text = F.when(current, observed_at).otherwise(as_of)
    kind = lambda a, b: F.when(current, F.lit(a)).otherwise(F.lit(b))
    problem = times.timestamp_problem(stamp_text, "MISSING", "INVALID", "NOT_UTC_AWARE")
    age = (now_us - F.unix_micros(times.strict_utc(stamp_text))) / F.lit(1e6)
    early = first_reason([
        (~F.lower(status).isin(*PREMATCH_STATUSES) | status.isNull(), "EXECUTION_STATUS_INVALID_OR_MISSING"),
        (~stale.eqNullSafe(F.lit(False)), "STALE_OR_UNVERIFIED_QUOTE"),
        (~truly(tradable), "MARKET_NOT_VERIFIED_TRADABLE"),
    ])
    stamp = F.when(
        problem.isNotNull(), F.concat(kind("OBSERVATION", "QUOTE"), F.lit("_TIMESTAMP_"), problem)
    )
    late = first_reason([
        (current & blank(freshness_basis), "CURRENT_FEED_FRESHNESS_BASIS_MISSING"),
        (age < -300, "QUOTE_TIMESTAMP_IN_FUTURE"),
        (age > max_age_minutes * 60, "QUOTE_TOO_OLD"),
    ])
    return F.coalesce(early, stamp, late)


def selected_pair_consistent(tol: float = 1e-9) -> Column:
    """Opposite lines, both prices above 1, selected side equals its own side's line and price, line on grid."""
    home = F.col("favorite_side") == "H"
    ok = (
        F.col("favorite_side").isin("H", "A")
        & (F.abs(F.col("home_line") + F.col("away_line")) < tol)
        & (F.col("home_price") > 1) & (F.col("away_price") > 1)
        & on_grid(F.col("line"), tol)
        & (F.abs(F.col("line") - F.when(home, F.col("home_line")).otherwise(F.col("away_line"))) < tol)
        & (F.abs(F.col("price") - F.when(home, F.col("home_price")).otherwise(F.col("away_price"))) < tol)
    )
    return F.coalesce(ok, F.lit(False))


def is_prematch() -> Column:
    return F.coalesce(F.col("observed_us") < F.col("kickoff_us"), F.lit(False))


def trusted(guarded: Column, bookmaker: str, semantics: str) -> Column:
    """Rows of a guarded provider must prove main line, provenance, core price and pre-match time; others pass."""
    proven = (
        (F.lower("bookmaker") == bookmaker) & truly(F.col("mainline_verified")) & (F.col("source_semantics") == semantics)
        & selected_pair_consistent() & F.col("price").between(*CORE) & is_prematch()
    )
    return ~F.coalesce(guarded, F.lit(False)) | F.coalesce(proven, F.lit(False))


def collectable() -> Column:
    """Usable for slot coverage."""
    return F.col("fixture_id").isNotNull() & is_prematch() & selected_pair_consistent() & F.col("price").between(*CORE)


def prematch_order() -> Column:
    """Ordering key of a valid pre-match observation, else null."""
    return F.when(
        is_prematch() & selected_pair_consistent(),
        F.struct("observed_us", "provider", F.col("fixture_id").cast("string").alias("source_id"), "event_id"),
    )


def total_quote_status() -> Column:
    """Status of a total quote taken with the handicap."""
    line = F.col("ou_line")
    return first_reason(
        [
            (line.isNull() & F.col("over_price").isNull() & F.col("under_price").isNull(), "MISSING_OU"),
            (line.isNull() | (line < 0) | ~on_grid(line), "INVALID_OU_LINE"),
            (~((F.col("over_price") > 1) & (F.col("under_price") > 1)) | F.col("over_price").isNull() | F.col("under_price").isNull(),
             "INVALID_OU_TWO_SIDED_PRICE"),
            (F.col("observed_us").isNull() | F.col("kickoff_us").isNull(), "INVALID_QUOTE_TIMESTAMP"),
            (~is_prematch(), "NOT_PREMATCH"),
            (blank(F.col("bookmaker")) | blank(F.col("source_semantics")), "MISSING_PRICE_PROVENANCE"),
            (truly(F.col("mainline_verified")), "VERIFIED_MAINLINE"),
        ],
        accepted="PAIRED_QUOTE_MAINLINE_UNVERIFIED",
    )


def exact_total_status(line_value: float = 2.5) -> Column:
    """Status of a quote on one exact total."""
    line = F.col("ou_line")
    return first_reason(
        [
            (line.isNull() & F.col("over_price").isNull(), "MISSING_QUOTE"),
            (~(line == line_value) | line.isNull(), "NOT_EXACT_2_5"),
            (~((F.col("over_price") > 1) & (F.col("under_price") > 1)) | F.col("over_price").isNull() | F.col("under_price").isNull(),
             "INVALID_TWO_SIDED_PRICES"),
            (~is_prematch() | blank(F.col("bookmaker")) | blank(F.col("source_semantics")),
             "UNVERIFIED_PROVENANCE_OR_TIMESTAMP"),
        ],
        accepted="VERIFIED_EXACT_2_5_PREMATCH",
    )


def historical_quote_reason(bookmaker: str, semantics: Sequence[str]) -> Column:
    """Null when a historical quote is admissible evidence."""
    hl, side = F.col("home_line"), F.col("favorite_side")
    own_line = F.when(side == "H", hl).otherwise(F.col("away_line"))
    own_price = F.when(side == "H", F.col("home_price")).otherwise(F.col("away_price"))
    return first_reason([
        (~F.lower(F.trim("bookmaker")).eqNullSafe(F.lit(bookmaker)), "NOT_REFERENCE_BOOKMAKER"),
        (~truly(F.col("mainline_verified")) | ~F.col("source_semantics").isin(*semantics), "MAINLINE_SEMANTICS_NOT_VERIFIED"),
        (~is_prematch(), "TIMESTAMP_NOT_VERIFIED_PREMATCH"),
        (~((F.col("home_price") > 1) & (F.col("away_price") > 1)) | hl.isNull() | F.col("away_line").isNull(), "INVALID_TWO_SIDED_PAIR"),
        ((F.abs(hl + F.col("away_line")) > 1e-9) | ~on_grid(hl, 1e-9), "INVALID_OPPOSITE_QUARTER_LINES"),
        (~side.isin("H", "A") | ((hl < 0) & (side != "H")) | ((hl > 0) & (side != "A")), "FAVORITE_SIDE_CONFLICT"),
        (~(F.col("line").eqNullSafe(own_line) & F.col("price").eqNullSafe(own_price)), "SELECTED_PAIR_CONFLICT"),
        (~F.col("price").between(*CORE), "OUTSIDE_RESEARCH_CORE_PRICE"),
    ])


def is_legacy(provider: str, semantics: Sequence[str]) -> Column:
    verified = truly(F.col("mainline_verified")) & F.coalesce(F.col("source_semantics").isin(*semantics), F.lit(False))
    return (F.col("provider") == provider) & ~verified


def population_reason(
    text: Sequence[Column], competition: Column | None = None, fixture: Column | None = None,
    league: Column | None = None, excluded_competitions: Sequence[str] = (), excluded_fixtures: Sequence[str] = (),
    excluded_leagues: Sequence[str] = (),
) -> Column:
    """Null when a row belongs to the studied population. Age and gender come from explicit markers only."""
    words = F.replace(F.concat_ws(" ", *text), F.lit("_"), F.lit(" "))
    rules = []
    if competition is not None and excluded_competitions:
        rules.append((competition.isin(*excluded_competitions), "USER_REVIEWED_COMPETITION_OUT_OF_SCOPE"))
    if fixture is not None and excluded_fixtures:
        rules.append((fixture.isin(*excluded_fixtures), "USER_REVIEWED_FIXTURE_OUT_OF_SCOPE"))
    rules += [(words.rlike(names.WOMEN_SCOPE), "WOMEN_OUT_OF_SCOPE"), (words.rlike(names.YOUTH_SCOPE), "YOUTH_OUT_OF_SCOPE")]
    if league is not None and excluded_leagues:
        rules.append((F.lower(F.trim(league)).isin(*excluded_leagues), "REVIEWED_LEAGUE_OUT_OF_SCOPE"))
    return first_reason(rules)


def evidence_quality(sources: Column, home: Column, away: Column, kickoff_us: Column, goals: tuple[Column, Column], primary_url: Column) -> Column:
    """Status of an array of struct(url, tier, assertion: struct(verification_method, source_title, status, home, away,
    ft_home_goals, ft_away_goals, kickoff, match_date)).

    Accepted: TIER_A_OFFICIAL or TIER_B_TWO_INDEPENDENT_SOURCES. The first defect of the first defective source
    names a rejection. A source must say when the match was: by a kickoff with its offset, a UTC date, or both, and
    whatever it says must be right. A leading www. does not make another host; ports and user names are not allowed.
    """
    host = lambda s: F.regexp_replace(F.lower(F.regexp_extract(s["url"], "^https://([^/?#@:]+)(?:[/?#]|$)", 1)), r"^www\.", "")
    hosts = F.transform(sources, host)

    def defect(s: Column, i: Column) -> Column:
        a = s["assertion"]
        said = F.unix_micros(times.strict_utc(a["kickoff"]))
        other = lambda x, y: a[x].isNull() | (names.alnum_key(a[x]) != names.alnum_key(y))
        return first_reason([
            (s.isNull(), "MALFORMED_SOURCE"),
            (F.coalesce(host(s), F.lit("")) == "", "INVALID_SOURCE_URL"),
            (F.array_position(hosts, host(s)) != i + 1, "DUPLICATE_SOURCE_HOST"),
            (~s["tier"].isin("A_OFFICIAL", "B_REPUTABLE") | s["tier"].isNull(), "INVALID_SOURCE_TIER"),
            (a.isNull(), "MISSING_SOURCE_ASSERTIONS"),
            (~a["verification_method"].eqNullSafe(F.lit("MANUAL_WEB_REVIEW")), "INVALID_VERIFICATION_METHOD"),
            (blank(a["source_title"]), "MISSING_SOURCE_TITLE"),
            (~a["status"].eqNullSafe(F.lit("FT")), "SOURCE_RESULT_NOT_FINAL"),
            (other("home", home) | other("away", away), "SOURCE_IDENTITY_MISMATCH"),
            (~(a["ft_home_goals"].eqNullSafe(goals[0]) & a["ft_away_goals"].eqNullSafe(goals[1])) | a["ft_home_goals"].isNull() | a["ft_away_goals"].isNull(), "SOURCE_SCORE_MISMATCH"),
            (blank(a["kickoff"]) & blank(a["match_date"]), "MISSING_SOURCE_DATE"),
            (~blank(a["kickoff"]) & ~said.eqNullSafe(kickoff_us), "SOURCE_KICKOFF_MISMATCH"),
            (~blank(a["match_date"]) & ~a["match_date"].eqNullSafe(F.date_format(F.timestamp_micros(kickoff_us), "yyyy-MM-dd")), "SOURCE_DATE_MISMATCH"),
        ])

    defects = F.filter(F.transform(sources, defect), lambda d: d.isNotNull())
    official = F.exists(sources, lambda s: s["tier"] == "A_OFFICIAL")
    return F.coalesce(
        first_reason([
            (sources.isNull() | (F.size(sources) < 1), "MISSING_SOURCE_ASSERTIONS"),
            (kickoff_us.isNull() | (names.alnum_key(home) == "") | (names.alnum_key(away) == ""), "INVALID_MATCH_IDENTITY"),
        ]),
        F.get(defects, F.lit(0)),
        first_reason(
            [
                (~F.exists(sources, lambda s: s["url"] == primary_url), "PRIMARY_SOURCE_NOT_ASSERTED"),
                (official, "TIER_A_OFFICIAL"),
                (F.size(sources) >= 2, "TIER_B_TWO_INDEPENDENT_SOURCES"),
            ],
            accepted="INSUFFICIENT_SOURCE_CORROBORATION",
        ),
    )


def with_reason(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason)
