from __future__ import annotations

import random

from pyspark.sql import functions as F

from fairline.operators import asof, identity, movement, quality, resampling, results, sequences
from fairline.operators.multipletests import benjamini_hochberg

c = F.col


def brute_sequence(values):
    cum = peak = dd = run = best = 0
    for v in values:
        cum += v
        peak = max(peak, cum)
        dd = max(dd, peak - cum)
        run = run + 1 if v < 0 else 0
        best = max(best, run)
    return len(values), cum, dd, best


def test_sequence_metrics_match_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.choice([-1_000_000, -500_000, 0, 900_000])) for i in range(4000)]
    rows += [("all_loss", i, -1_000_000) for i in range(500)] + [("wins", i, 700_000) for i in range(50)] + [("one", 0, -1)]
    df = spark.createDataFrame(rows, "k string, t long, p long").repartition(5)
    for parts in (1, 7, 16):
        got = {r["k"]: (r["n"], r["total"], r["max_drawdown"], r["longest_losing_streak"])
               for r in sequences.sequence_metrics(df, ["k"], ["t"], "p", parts=parts).collect()}
        for k in ("hot", "all_loss", "wins", "one"):
            assert got[k] == brute_sequence([p for kk, _, p in sorted(rows) if kk == k]), (k, parts)


def test_sequence_spreads_one_key_over_chunks(spark):
    df = spark.range(10_000).select(F.lit("x").alias("k"), "id", F.lit(1).cast("long").alias("p"))
    tagged = sequences.ordered_chunks(df, ["k"], ["id"], 8)
    assert tagged.select("_chunk").distinct().count() >= 6


def test_benjamini_hochberg(spark):
    rng = random.Random(5)
    ps = [round(rng.random() ** 2, 3) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(ps)), "id int, p double")
    got = {r["id"]: r["q"] for r in benjamini_hochberg(df, "p", "q", digits=None).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    run, want = 1.0, {}
    for rank in range(len(ps), 0, -1):
        run = min(run, ps[order[rank - 1]] * len(ps) / rank)
        want[order[rank - 1]] = run
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    by_p = sorted((ps[i], got[i]) for i in got)
    assert all(a[1] <= b[1] for a, b in zip(by_p, by_p[1:]))


def test_bootstrap_matches_normal_theory_and_is_reproducible(spark):
    rows = [("a", i, 1_000_000 if i % 2 else -1_000_000) for i in range(4000)] + [("b", i, -500_000) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, p long")
    run = lambda d: {r["k"]: (r["ci_low"], r["ci_high"]) for r in resampling.bootstrap_interval(
        resampling.histogram(d, ["k"], c("p")), ["k"], c("k"), 1500).collect()}
    first, again = run(df), run(df.repartition(7))
    assert first == again
    half = 1.96 / 4000**0.5
    assert abs(first["a"][0] + half) < half * 0.2 and abs(first["a"][1] - half) < half * 0.2
    assert first["b"] == (-0.5, -0.5)


def test_draws_of_small_histograms_spread_over_tasks(spark):
    rows = [(f"k{k}", v, 5 + v) for k in range(4) for v in range(6)]
    h = spark.createDataFrame(rows, "k string, v long, c long")
    for kind in ("bootstrap", "signflip"):
        d = resampling.draws(h, ["k"], c("k"), 2000, kind).withColumn("task", F.spark_partition_id())
        got = d.groupBy("task").agg(F.count_distinct("k", "draw").alias("n")).collect()
        assert sum(r["n"] for r in got) == 8000 and len(got) >= 6 and max(r["n"] for r in got) < 4000  # before, all in one


def test_sign_flip(spark):
    rows = [("null", i, 1_000_000 if i % 2 else -1_000_000) for i in range(400)] + [("edge", i, 1_000_000 if i % 10 else -1_000_000) for i in range(400)]
    h = resampling.histogram(spark.createDataFrame(rows, "k string, i int, p long"), ["k"], c("p"))
    two = {r["k"]: r["p"] for r in resampling.sign_flip_p(h, ["k"], c("k"), 1000).collect()}
    one = {r["k"]: r["p"] for r in resampling.sign_flip_p(h, ["k"], c("k"), 1000, two_sided=False).collect()}
    assert two["null"] == 1.0 and two["edge"] == 1 / 1001
    assert one["null"] == 1.0 and one["edge"] == 1 / 1001


def _ticks(rng, n):
    return [(rng.choice(["f", "g"]), rng.choice(["H", "A"]), rng.randrange(0, 400), rng.choice([1.8, 1.9, 2.0]), rng.random() > 0.2) for _ in range(n)]


def test_slot_states_match_brute_force(spark):
    rng = random.Random(11)
    ticks = _ticks(rng, 300)
    slots = [50, 60, 200, 390]
    df = spark.createDataFrame(ticks, "fixture_id string, side string, created_us long, price double, active boolean")
    sched = spark.createDataFrame([("f", slots), ("g", slots)], "fixture_id string, slots array<long>")
    got = {(r["fixture_id"], r["side"], r["slot_us"]): (r["at_us"], r["ambiguous"]) for r in asof.slot_states(df, sched, ["fixture_id", "side"]).collect()}
    for f in "fg":
        for s in "HA":
            for at in slots:
                mine = [t for t in ticks if t[0] == f and t[1] == s and t[2] <= at]
                last = max((t[2] for t in mine), default=None)
                states = {(t[3], t[4]) for t in mine if t[2] == last}
                assert got[(f, s, at)] == (last, None if last is None else len(states) > 1)


def test_nearest_prior_matches_brute_force(spark):
    rng = random.Random(13)
    quotes = [(rng.choice(["hot", "hot", "g"]), rng.randrange(0, 3000), rng.choice([1.8, 1.9])) for _ in range(600)]
    probes = [(i, rng.choice(["hot", "g", "none"]), rng.randrange(0, 3200)) for i in range(200)]
    q = spark.createDataFrame(quotes, "k string, t long, price double")
    p = spark.createDataFrame(probes, "id int, k string, at long")
    got = {r["id"]: (r["status"], r["at_us"]) for r in asof.nearest_prior(p, q, ["k"], "at", "t", ["price"], 40, "id").collect()}
    for i, k, at in probes:
        mine = [x for x in quotes if x[0] == k and at - 40 <= x[1] <= at]
        last = max((x[1] for x in mine), default=None)
        states = {x[2] for x in mine if x[1] == last}
        want = "NO_CANDIDATE" if last is None else "AMBIGUOUS_NEAREST" if len(states) > 1 else "RECOVERED"
        assert got[i] == (want, last)


def test_transitions_across_chunks(spark):
    rng = random.Random(17)
    rows = [("x", i, rng.choice("ab")) for i in range(300)] + [("y", i, "a" if i < 150 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    got = {(r["k"], r["from_state"], r["to_state"]) for r in movement.transitions(df, ["k"], ["t"], c("s")).collect()}
    want = set()
    for k in "xy":
        seq = [s for kk, _, s in rows if kk == k]
        want |= {(k, a, b) for a, b in zip(seq, seq[1:]) if a != b}
    assert got == want


def test_results_and_conflicts(spark):
    cols = "fixture_id long, ft_home_goals int, ft_away_goals int, result_source string"
    old = spark.createDataFrame([(1, 1, 0, "A"), (2, 2, 2, "A"), (9, 0, 0, "A")], cols)
    new = spark.createDataFrame([(1, 1, 0, "B"), (2, 2, 1, "B"), (3, 0, 4, "B"), (4, -1, 0, "B")], cols)
    ledger0 = spark.createDataFrame([(9, "EARLIER")], "fixture_id long, reason string")
    kept, ledger = results.merge_results(old, new, ledger0)
    assert {(r["fixture_id"], r["result_source"]) for r in kept.collect()} == {(1, "A"), (3, "B")}
    assert {r["fixture_id"] for r in ledger.collect()} == {2, 9}


def test_upsert_and_insert_only(spark):
    old = spark.createDataFrame([(1, 0, "old"), (2, 0, "old")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 5, "late"), (2, 4, "early"), (3, 1, "new")], "k int, seq int, v string")
    assert {(r["k"], r["v"]) for r in results.upsert(old, new, ["k"], "seq").collect()} == {(1, "old"), (2, "late"), (3, "new")}
    assert {(r["k"], r["v"]) for r in results.insert_only(old, new, ["k"], "seq").collect()} == {(1, "old"), (2, "old"), (3, "new")}


def test_identity_bridge(spark):
    rows = [("p:1", "p", "a", "b", 5, "L"), ("q:1", "q", "a", "b", 5, "L"), ("p:2", "p", "c", "d", 5, "L"), ("p:3", "p", "e", "f", 5, "L"), ("p:4", "p", "e", "f", 5, "L"),
            ("q:3", "q", "e", "f", 5, "L"), ("q:9", "q", "g", "h", 5, "L"), ("q:9", "q", "g", "h", 6, "L")]
    df = spark.createDataFrame(rows, "source_id string, provider string, home string, away string, kickoff_us long, league string")
    got = {r["source_id"]: (r["canonical_id"], r["reason"]) for r in identity.identity_bridge(df, ("p", "q")).collect()}
    assert got["p:1"] == got["q:1"] == ("p:1", None)
    assert got["p:2"] == (None, "NO_COUNTERPART")
    assert got["p:3"] == got["q:3"] == (None, "AMBIGUOUS_PROVIDER_IDENTITY")
    assert got["q:9"] == (None, "INCONSISTENT_IDENTITY")


def test_unique_match_never_picks_a_winner(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id int, k string")
    right = spark.createDataFrame([(10, "a"), (20, "b"), (21, "b")], "rid int, k string")
    got = {r["id"]: (r["rid"], r["reason"]) for r in identity.unique_match(left, right, ["k"], "id", "rid").collect()}
    assert got == {1: (10, None), 2: (None, "AMBIGUOUS"), 3: (None, "UNMATCHED")}


def test_multiset_equality(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted(r["key"] for r in quality.multiset_equal(a, b, "r").collect()) == ["1", "3"]


def test_plans_keep_hot_groups_partial(spark):
    """Per-fixture reductions run as partial aggregates, not as windows over a whole fixture."""
    df = spark.range(10).select(c("id").alias("fixture_id"), F.lit(1).alias("ft_home_goals"), F.lit(0).alias("ft_away_goals"), F.lit("s").alias("result_source"))
    plan = results.result_index(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan and "Window" not in plan


def _market_rows(spark, n=400):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice(xs)
    rows = [
        (pick("9798", "9899"), pick("A", "B", None), pick("H", "A", None), pick(-0.25, 0.5, None), pick(1.4, 1.55, 1.9), pick(2.0, 2.25, None), pick(1.6, 1.9, None), pick(1.7, 3.0), pick(0.31, 0.52, None), pick(0.0, 0.25, None), pick(0.0, 0.25, None), rng.randrange(3), rng.randrange(3))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "season string, league string, favorite_side string, favorite_ah_line double, favorite_ah_price double, ou_line double, over_price double, under_price double, favorite_fair_probability double, ah_line_move double, ou_line_move double, home_goals int, away_goals int")


def test_rolled_up_buckets_equal_those_of_all_families(spark):
    from fairline.operators import patterns as P

    rows, keep = _market_rows(spark), ["league", "season"]
    text = lambda df: sorted(str(r) for r in df.select(*keep, *P.KEY, "n", "ah_profit", "ou_profit", *P.counts_of("ah"), *P.counts_of("ou")).collect())
    assert text(P.pattern_buckets(rows, keep)) == text(P.season_buckets(P.observations(rows, keep), keep))
    scoped = rows.withColumn("league", F.explode(F.array("league", F.lit("ALL"))))
    assert text(P.pattern_buckets(rows, keep, {"league": "ALL"})) == text(P.season_buckets(P.observations(scoped, keep), keep))
    assert P.observations(rows, keep, finest=True).count() <= 5 * rows.count()


def test_counted_patterns_go_to_the_markets(spark, monkeypatch):
    from fairline.functions import settlement
    from fairline.plans import screen

    markets = spark.createDataFrame([(1, 1.5, 3.0, 4.0, -0.25, 2.5, 1.95, 1.9, 1.9, 1.95), (2, 4.0, 3.0, 1.5, 0.25, 2.5, 1.9, 1.95, 1.9, None)], "fixture_id long, open_h double, open_d double, open_a double, home_line double, ou_line double, ah_home double, ah_away double, over_price double, under_price double")
    dist = [f"{ph}_{c.lower()}" for ph in screen.PHASES for c in settlement.CLASSES]
    kinds = "pattern_id string, market string, favorite_side string, ah_q int, ou_side string, ou_q int, ah_band long, ou_band long, p_band long, holdout_n long, q_validation_bh double, " + ", ".join(f"{c} long" for c in dist)
    patterns = spark.createDataFrame([(f"{m}{s}", m, s, -1, None, None, None, None, None, 50, 0.1, *([60, 10, 10, 10, 10] * 3)) for m in ("AH", "OU") for s in "HA"], kinds)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # what a large estimate does
    try:
        def joined():
            df = screen.candidates(markets, patterns)
            plan = df._jdf.queryExecution().executedPlan().toString()
            return sorted(map(str, df.select("fixture_id", "k_pattern_id", "reason", "min_phase_ev").collect())), plan.count("BroadcastHashJoin")

        few = joined()
        monkeypatch.setattr(screen, "MOST_BROADCAST", 1)
        many = joined()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few[0] == many[0] and len(few[0]) == 4 and (few[1], many[1]) == (1, 0)
