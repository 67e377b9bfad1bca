"""Promotion and undoing, contracts, imports and bundles on small tables, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fairline.operators import publishing as pub
from fairline.streaming import stream

SCHEMA = "fixture_id long, bookmaker string, day int, cents long, provenance string"
KEY = ["fixture_id", "bookmaker", "day"]
ROWS = [(1, "A", 1, 190, "LIVE"), (1, "A", 1, 191, "LIVE"), (1, "A", 1, 191, "LIVE"), (1, "B", 1, 192, None), (2, "A", 1, 193, "LIVE"), (2, None, 1, 194, "LIVE"), (3, "A", 2, None, "OLD")]
BATCH = [(1, "A", 1, 200, "RUN"), (2, "A", 1, 201, "RUN"), (9, "A", 1, 202, "RUN")]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_of_a_promotion(spark):
    table, batch = frame(spark, ROWS), frame(spark, BATCH)
    done = pub.promote(table, table.limit(0), batch, KEY, "RUN")
    assert done.state == "PROMOTED" and rows_of(done.archive) == sorted([r for r in ROWS if r[:3] in {(1, "A", 1), (2, "A", 1)}], key=str)
    assert rows_of(done.table) == sorted([r for r in ROWS if r[:3] not in {(1, "A", 1), (2, "A", 1)}] + BATCH, key=str)
    again = pub.promote(done.table, done.archive, batch.repartition(3), KEY, "RUN", done.receipt)
    assert (again.state, again.reason) == ("NOOP", None) and rows_of(again.table) == rows_of(done.table)
    undone = pub.revert(done.table, done.archive, "RUN", done.receipt)
    assert undone.state == "REVERTED" and rows_of(undone.table) == rows_of(table) and rows_of(undone.archive) == []


def test_promotions_that_change_nothing(spark):
    table, batch = frame(spark, ROWS), frame(spark, BATCH)
    done = pub.promote(table, table.limit(0), batch, KEY, "RUN")
    other = frame(spark, [(*BATCH[0][:3], 205, "RUN"), *BATCH[1:]])
    cases = [
        (pub.promote(done.table, done.archive, other, KEY, "RUN", done.receipt), "EXISTING_DIFFERS"), (pub.promote(done.table, done.archive, batch, KEY, "RUN"), "RECEIPT_MISSING"),
        (pub.promote(table, done.archive, batch, KEY, "RUN"), "ARCHIVE_EXISTS"), (pub.promote(done.table, done.archive, frame(spark, BATCH + BATCH[:1]), KEY, "RUN", done.receipt), "EXISTING_DIFFERS"),
        (pub.revert(done.table.filter("fixture_id <> 3"), done.archive, "RUN", done.receipt), "NOT_AS_IN_RECEIPT"), (pub.revert(done.table, done.archive.limit(1), "RUN", done.receipt), "NOT_AS_IN_RECEIPT"),
    ]
    for p, reason in cases:
        assert (p.state, p.reason) == ("CONFLICT", reason)
    assert rows_of(cases[0][0].table) == rows_of(done.table)


def test_digests_are_of_multisets(spark):
    one = lambda rows: tuple(pub.digests(frame(spark, rows), KEY + ["cents"]).first())
    assert one(ROWS) == one(ROWS[::-1]) != one(ROWS[:-1]) and one(ROWS) != one(ROWS + ROWS[:1]) and one([]) == (0, 0, 0)
    assert one([(1, "AB", 2, 3, "")]) != one([(1, "A", 2, 3, "")]) and one([(1, None, 2, 3, "")]) != one([(1, "-", 2, 3, "")])


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_differing_keys(spark, buckets):
    rng = random.Random(buckets)
    a, b = ({(rng.randrange(400), rng.choice(["x", "y", None])) for _ in range(500)} for _ in range(2))
    df = lambda rows: spark.createDataFrame(sorted(rows, key=str), "k long, s string")
    got = {tuple(r) for r in pub.differing_keys(df(a), df(b), ["k", "s"], buckets).collect()}
    assert got == {(*k, "left") for k in a - b} | {(*k, "right") for k in b - a}
    assert pub.differing_keys(df(a), df(a), ["k", "s"], buckets).isEmpty()


def test_contract(spark):
    good, stop = ("COMPLETED", [], 0, True, pub.SCOPES[0]), [pub.RUNTIME_STOP]
    told = {"ok": good, "none": good, "err": ("COMPLETED", ["x"], 0, True, pub.SCOPES[1]), "null": (None, None, None, None, None), "dup": good, "half": good, "more": good, "part": ("STOPPED", stop, 0, True, pub.SCOPES[0]), "void": ("STOPPED", stop, 0, True, pub.SCOPES[0])}
    runs = spark.createDataFrame([(k, *v) for k, v in told.items()], "run string, status string, errors array<string>, production_writes int, research_only boolean, scope string")
    c = [("ok", 1), ("ok", 2), ("err", 1), ("null", 1), ("dup", 1), ("dup", 1), ("half", 1), ("half", 2), ("more", 1), ("part", 1), ("part", 2), ("void", 1)]
    r = [("ok", 2), ("ok", 1), ("err", 1), ("null", 1), ("dup", 1), ("dup", 1), ("dup", 1), ("half", 1), ("more", 1), ("more", 5), ("part", 2)]
    df = lambda rows: spark.createDataFrame(rows, "run string, id int")
    got = {tuple(x) for x in pub.publish_contract(runs, df(c), df(r), ["id"], allow_partial=True).collect()}
    assert got == {
        ("ok", None, None, 2), ("none", None, None, 0), ("part", None, None, 2), ("err", "SCAN_NOT_COMPLETED", None, 1), ("null", "SCAN_NOT_COMPLETED", None, 1), ("null", "UNTRUSTED_REPORT_ORIGIN", None, 1), ("null", "UNTRUSTED_MANIFEST_SCOPE", None, 1),
        ("dup", "DUPLICATE_CANDIDATE", 1, 2), ("dup", "DUPLICATE_RESULT", 1, 3), ("half", "INCOMPLETE_RESULT_SET", 2, 1), ("more", "RESULT_MANIFEST_MISMATCH", 5, 1), ("void", "NO_VERIFIED_PARTIAL_RESULTS", None, 1),
    }
    strict = {(x["run"], x["reason"]) for x in pub.publish_contract(runs, df(c), df(r), ["id"]).collect()}
    assert {("part", "SCAN_NOT_COMPLETED"), ("part", "INCOMPLETE_RESULT_SET"), ("void", "INCOMPLETE_RESULT_SET")} <= strict


def test_contract_counts_its_keys_once(spark):
    runs = spark.createDataFrame([("a", "COMPLETED", [], 0, True, pub.SCOPES[0])], "run string, status string, errors array<string>, production_writes int, research_only boolean, scope string")
    keys = spark.createDataFrame([("a", 1), ("a", 2)], "run string, id int")
    plan = pub.publish_contract(runs, keys, keys, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6  # no rule counts the keys anew


def test_import_leaves_the_table_alone_unless_clean(spark, tmp_path):
    path = str(tmp_path / "t")
    slots = lambda rows: spark.createDataFrame(rows, "id int, price int, status string")
    load = lambda v, rows, told, run="r1": pub.import_reviewed(spark, path, v, slots(rows), told, run, ["id"], "OK", F.col("price").between(180, 220))
    now = lambda: sorted(tuple(r)[:2] for r in spark.read.parquet(f"{path}/versions/{pub.current_version(spark, path)}").collect())
    assert pub.current_version(spark, path) is None
    assert load(0, [(1, 190, "OK")], {"OK": 2, "BAD": 0}).reason == "STATUS_COUNTS_DIFFER" and pub.current_version(spark, path) is None
    first = load(1, [(1, 190, "OK"), (1, 190, "OK"), (2, 191, "OK"), (3, 5, "BAD")], {"OK": 3, "BAD": 1})
    assert (first.state, first.added, first.observed["BAD"]) == ("CURRENT", 2, 1) and now() == [(1, 190), (2, 191)]
    assert load(2, [(1, 179, "OK")], {"OK": 1}).reason == "PRICE_GATE_FAILED" and load(3, [(1, None, "OK")], {"OK": 1}).reason == "PRICE_GATE_FAILED"
    assert load(4, [(1, 190, "OK"), (1, 191, "OK")], {"OK": 2}).reason == "CONFLICTING_DUPLICATE"
    assert load(5, [(1, 190, "OK"), (2, 1, None)], {"OK": 1}).reason == "STATUS_COUNTS_DIFFER"
    assert load(6, [(2, 195, "OK")], {"OK": 1}, "r2").reason == "DIFFERENT_PROVENANCE" and now() == [(1, 190), (2, 191)]
    last = load(7, [(1, 190, "OK"), (2, 195, "OK"), (4, 200, "OK")], {"OK": 3})
    assert (last.added, last.replaced, last.unchanged) == (1, 1, 1) and now() == [(1, 190), (2, 195), (4, 200)]
    assert load(8, [], {"OK": 0}).state == "CURRENT" and now() == [(1, 190), (2, 195), (4, 200)]


def test_bundle_is_visible_as_a_whole_or_not(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(20).withColumns({"members": F.lit(1), "members_hash": pub.population(["id"])})
    total = lambda df: df.groupBy((F.col("id") % 3).alias("g")).agg(F.sum("members").alias("members"), F.sum("members_hash").alias("members_hash"))
    assert pub.read_bundle(spark, path, "a") is None
    assert all(t[3] for t in pub.bundle(spark, path, 1, {"a": rows, "b": total(rows)})) and pub.read_bundle(spark, path, "b").count() == 3
    swapped = rows.filter("id <> 4").union(spark.range(99, 100).withColumns({"members": F.lit(1), "members_hash": pub.population(["id"])}))
    told = pub.bundle(spark, path, 2, {"a": rows, "b": total(swapped)})  # as many members, but others
    assert [t[3] for t in told] == [True, False] and pub.current_version(spark, path) == 1


def test_guard_publishes_rows_and_may_compare_values(spark, tmp_path):
    path = str(tmp_path / "g")
    write = stream.monotone_writer(path, "id", values=["goals"])
    df = lambda *rows: spark.createDataFrame(rows, "id int, goals int, source string")
    for batch, rows in enumerate([df((1, 2, "a"), (2, None, "a")), df((1, 3, "b"), (2, None, "b")), df((1, 2, "c"), (2, None, "c"), (3, 0, "c"))]):
        write(rows, batch)
    assert sorted(tuple(r) for r in stream.published(spark, path).collect()) == [(1, 2, "c"), (2, None, "c"), (3, 0, "c")]
