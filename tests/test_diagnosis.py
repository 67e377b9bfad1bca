"""Text search, interval joins, proofs in two worlds, causes, persistence and replay against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fairline.operators import diagnosis, replay, textsearch


@pytest.mark.parametrize("per_task", [1, 7, 100_000])
def test_contains_join(spark, per_task):
    rng = random.Random(per_task)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randint(0, 9)))
    texts = [(i, word() + word()) for i in range(80)] + [(900, None), (901, ""), (902, "ab%_c")]
    phrases = [(i, word()[: rng.randint(0, 5)]) for i in range(60)] + [(990, None), (991, ""), (992, "zzz"), (993, "%_"), (994, "a"), (995, "a")]
    t, p = spark.createDataFrame(texts, "id long, body string"), spark.createDataFrame(phrases, "pid long, hint string")
    got = sorted(map(tuple, textsearch.contains_join(t, p, "id", "body", "pid", "hint", per_task=per_task).collect()))
    assert got == sorted((i, j) for i, b in texts for j, h in phrases if h and b and h in b)
    assert textsearch.contains_join(t, p.filter("pid > 989 and pid < 992"), "id", "body", "pid", "hint").count() == 0
    assert textsearch.contains_join(t.limit(0), p, "id", "body", "pid", "hint").count() == 0


def test_search_text(spark):
    row = spark.createDataFrame([("Süper  Lig-1_a", None, "日本 Éa")], "a string, b string, c string").select(textsearch.search_text(F.col("a"), F.col("b"), F.col("c"))).first()
    assert row[0] == "super lig 1 a ea"


@pytest.mark.parametrize(("bin_us", "per_part"), [(1, 1), (7, 2), (1000, 100)])
def test_interval_join(spark, bin_us, per_part):
    rng = random.Random(bin_us)
    windows = [(i, rng.choice(["x", "y", None]), (s := rng.randint(-50, 50)), s + rng.randint(-3, 20)) for i in range(40)]
    events = [(i, rng.choice(["x", "y", "z", None]), rng.choice([None, rng.randint(-60, 80)])) for i in range(120)] + [(500, "x", 3)] * 30
    w, e = spark.createDataFrame(windows, "w int, k string, s long, e long"), spark.createDataFrame(events, "i int, k string, at long")
    got = Counter((r["w"], r["i"], r["at"]) for r in diagnosis.interval_join(w, e, ["k"], "s", "e", "at", bin_us, per_part).collect())
    assert got == Counter((n, i, at) for n, k, s, t in windows for i, kk, at in events if at is not None and k is not None and k == kk and s <= at < t)


def test_proof_delta_equals_two_runs(spark):
    rng = random.Random(3)
    rows = [("c%d" % rng.randint(0, 3), rng.choice(["t1", "t2", "t3", "t4", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, 3, 0])) for _ in range(90)]

    def proven(bit):
        by, owner, doubt = defaultdict(list), defaultdict(set), set()
        for s, t, a, m in rows:
            if m & bit and t and a:
                by[s, t].append(a)
                owner[s, a].add(t)
        ok = {k for k, v in by.items() if len(set(v)) == 1 and len(v) >= 2 and len(owner[k[0], v[0]]) == 1}
        doubt = {k for k, v in by.items() if len(set(v)) > 1 or any(len(owner[k[0], a]) > 1 for a in v)}
        return ok, doubt

    (p1, d1), (p2, d2) = proven(1), proven(2)
    got = {(r["scope"], r["team"]): r["state"] for r in diagnosis.proof_delta(spark.createDataFrame(rows, "scope string, team string, alias string, m int"), "scope", "team", "alias", "m").collect()}
    for k, state in got.items():
        assert state == ("KEPT" if k in p1 & p2 else "GAINED" if k in p2 else "LOST" if k in p1 else "NEWLY_AMBIGUOUS" if k in d2 - d1 else "UNPROVEN")
    assert p1 | p2 <= set(got)


def test_causes(spark):
    schedule = spark.createDataFrame([(i, i == 1, i not in (3, 4), i in (5, 6), i != 8) for i in range(1, 13)], "id int, started boolean, requested boolean, errors boolean, answered boolean")
    ids = lambda *n: spark.createDataFrame([(x,) for x in n], "id int")
    audits = spark.createDataFrame([(1, 1, "OK"), (4, 1, "OK"), (6, 1, "OK"), (9, 1, "OK"), (9, 2, "ID_CONFLICT x"), (10, 1, None), (11, 5, "OK"), (11, 4, "NO"), (99, 1, "OK")], "id int, at int, reason string")
    got = {r["id"]: (r["cause"], r["provider_reason"]) for r in diagnosis.causes(schedule, ids(7, 5, 98), audits, ids(1, 2, 3, 97), ["id"]).collect()}
    assert got == {
        1: ("ALREADY_KICKOFF", "OK"), 2: ("VALID_ODDS", None), 3: ("VALID_ODDS", None), 4: ("QUOTA_SKIPPED", "OK"), 5: ("PROVIDER_FAILURE", None), 6: ("VALIDATION_REJECTED", "OK"), 7: ("COLLECTOR_FAILURE", None),
        8: ("INSUFFICIENT_EVIDENCE", None), 9: ("MAPPING_FAILURE", "ID_CONFLICT x"), 10: ("MARKET_UNAVAILABLE", None), 11: ("VALIDATION_REJECTED", "OK"), 12: ("MARKET_UNAVAILABLE", None),
    }


def test_persistence(spark):
    rows = [(1, ["a", "b"], ["b", "c"], True, "UP"), (1, ["a"], None, None, None), (2, None, ["a", "a"], False, "UP"), (None, ["c"], ["c"], True, "DOWN"), (3, [], [], True, "UP"), (4, [None, "b"], ["b"], False, "UP")]
    out = diagnosis.persistence(spark.createDataFrame(rows, "f int, a array<string>, b array<string>, sw boolean, m string"), "a", "b", "f", F.col("sw"), {"move": F.col("m")})
    got = {r["candidate"]: (r["members"], r["first_hits"], r["latest_hits"], r["persisted"], r["appeared"], r["disappeared"], r["switched"], r["move"], r["persistence_rate"]) for r in out.collect()}
    assert got == {
        "a": (2, 2, 1, 0, 1, 2, 1, {"UP": 2, "UNKNOWN": 1}, 0.0), "b": (2, 2, 2, 2, 0, 0, 1, {"UP": 2}, 1.0), "c": (1, 1, 2, 1, 1, 0, 2, {"UP": 1, "DOWN": 1}, 1.0),
    }


def test_replay_equals_full_rebuild_and_touches_only_what_changed(spark):
    rows = [(r, i, v) for r in "abcde" for i, v in enumerate(range(ord(r) % 4 + 2))]
    df = lambda x: spark.createDataFrame(x, "req string, i int, v int")
    seen = []

    def rebuild(part):
        seen.append({r["req"] for r in part.select("req").distinct().collect()})
        return part.groupBy("req").agg(F.sum("v").alias("total"), F.max("i").alias("last"))

    before = df([x for x in rows if x[0] in "abd" and not (x[0] == "b" and x[1] == 1)] + [("gone", 1, 5)])
    stored = rebuild(before).join(replay.contents(before, ["req"], ["i", "v"]), "req")
    asked = df([(r, 0, 0) for r in ("a", "b", "c", "d", "gone", "never")])
    now = df(rows).repartition(3)
    planned = replay.plan(asked, replay.contents(now, ["req"], ["i", "v"]), stored, ["req"])
    assert {r["req"]: r["state"] for r in planned.collect()} == {"a": "REUSED", "b": "GROWN", "c": "MISSING", "d": "REUSED", "gone": "KEPT", "never": "UNPROCESSED"}
    got = {r["req"]: (r["total"], r["last"], r["rows"]) for r in replay.replay(planned, now, stored, ["req"], rebuild).collect()}
    assert seen[1] == {"b", "c"}
    want = {r: (sum(v for q, _, v in rows if q == r), max(i for q, i, _ in rows if q == r), sum(q == r for q, *_ in rows)) for r in "abcd"}
    assert got == want | {"gone": (5, 1, 1)}


def test_fixture_failures(spark):
    from fairline.operators import readiness

    df = spark.createDataFrame
    competitions = df([(1, "t1", True), (2, "t2", False), (3, None, True)], "competition_id int, provider_id string, verified boolean")
    alternatives = df([(1, "t1", "One"), (1, "old1", "One"), (2, "t2", "Two"), (3, "t3", "Three")], "competition_id int, provider_id string, provider_name string")
    clubs = df([(10, "p10", True, ["A"]), (11, "p11", True, ["B", "BB"]), (12, "p12", False, ["C"]), (20, "p20", True, ["D"]), (30, "pp", True, ["E"]), (31, "pp", True, ["F"])], "club_id int, provider_id string, verified boolean, names array<string>")
    members = df([(1, 10), (1, 11), (1, 12), (2, 20), (1, 30), (1, 31)], "competition_id int, club_id int")
    s = lambda i, t, n, k, a, an, b, bn: (i, t, n, k, a, an, b, bn)
    schedule = df([
        s(1, "t1", "One", 5, "p10", "A", "p11", "BB"), s(2, "t1", "Uno", 5, "p10", "A", "p11", "b"), s(3, "old1", "One", 5, "p10", "A", "p12", "C"), s(4, "t2", "Two", 5, "p20", "D", "p10", "A"), s(5, "t1", "One", 5, "p10", "A", "p10", "A"),
        s(6, "t1", "One", 5, "p10", "A", "p11", "B"), s(6, "t1", "One", 6, "p10", "A", "p11", "B"), s(7, "t1", "One", 99, "p10", "A", "p11", "B"), s(8, "t9", "Nine", 5, "p10", "A", "p11", "B"), s(9, "t3", "Three", 5, "pp", "E", None, None),
    ], "fixture_id int, tournament_id string, tournament_name string, kickoff_us long, id1 string, name1 string, id2 string, name2 string")
    got = {(r["competition_id"], r["fixture_id"]): r["reasons"] for r in readiness.fixture_failures(competitions, alternatives, clubs, members, schedule, 0, 10).collect()}
    assert got == {
        (1, 1): [], (1, 2): ["PROVIDER_COMPETITION_NAME_CHANGED", "PROVIDER_NAME_CHANGED_2"], (1, 3): ["COMPETITION_ID_UNVERIFIED", "UNVERIFIED_PARTICIPANT_2"], (2, 4): ["COMPETITION_ID_UNVERIFIED", "PARTICIPANT_OUTSIDE_CURRENT_ROSTER_2"],
        (1, 5): ["DUPLICATE_SIDE_IDENTITY"], (1, 6): ["CONFLICTING_FIXTURE_VERSIONS"], (3, 9): ["COMPETITION_ID_UNVERIFIED", "UNVERIFIED_PARTICIPANT_1", "UNVERIFIED_PARTICIPANT_2"],
    }


def test_contains_join_broadcasts_no_texts(spark):
    """The corpus side of every join is shuffled, however small it looks."""
    from fairline.operators import textsearch

    texts = spark.range(2000).selectExpr("id AS t", "concat('row ', id, ' of the table') AS txt")
    phrases = spark.createDataFrame([(1, "row 17 "), (2, "the")], "p long, ph string")
    found = textsearch.contains_join(texts, phrases, "t", "txt", "p", "ph")
    assert sorted(map(tuple, found.filter("p = 1 or t < 3").collect())) == [(0, 2), (1, 2), (2, 2), (17, 1)]
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BuildLeft" not in "".join(x for x in plan.split("\n") if "Join [gram" in x and "LeftSemi" not in x and "part" in x)
    assert [x for x in plan.split("\n") if "SortMergeJoin [t" in x]
