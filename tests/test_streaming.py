from __future__ import annotations

from pyspark.sql import functions as F

from fairline.sources import views as V
from fairline.streaming import stream

SF = "/root/testdata/sf0.001"


def _land(spark, tmp_path, parts=3):
    s = V.snapshots(spark, SF)
    path = str(tmp_path / "landing")
    for i in range(parts):
        s.filter(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return s, path


def _run(df, tmp_path, name, mode, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_movement_state_stream_equals_batch(spark, tmp_path):
    s, path = _land(spark, tmp_path)
    src = stream.snapshot_stream(spark, path, s.schema)
    out = _run(stream.movement_state(src), tmp_path, "mv", "complete", spark)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in stream.movement_state(s).collect()}


def test_football_day_stream(spark, tmp_path):
    s, path = _land(spark, tmp_path, parts=1)
    src = stream.snapshot_stream(spark, path, s.schema)
    out = _run(stream.football_day_counts(src), tmp_path, "fd", "complete", spark)
    batch = stream.football_day_counts(s)
    assert out.agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0]


def test_first_entry_ledger_is_immutable_and_replayable(spark, tmp_path):
    s, path = _land(spark, tmp_path)
    rows = s.select("fixture_id", "observed_us", "event_id", "price")
    ledger = str(tmp_path / "ledger")
    write = stream.ledger_writer(ledger, ["fixture_id"], "observed_us")
    src = stream.snapshot_stream(spark, path, s.schema).select(*rows.columns)
    q = src.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck_l")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    read = lambda: spark.read.parquet(ledger)
    first = {r["fixture_id"]: r["event_id"] for r in read().collect()}
    assert len(first) == rows.select("fixture_id").distinct().count() == read().count()
    last = read().agg(F.max("batch")).first()[0]
    write(rows.filter("event_id % 3 = 2"), last)  # a replayed batch changes nothing
    assert {r["fixture_id"]: r["event_id"] for r in read().collect()}.keys() == first.keys()


def test_deduplicate_stream(spark, tmp_path):
    s, path = _land(spark, tmp_path, parts=1)
    s.coalesce(1).write.mode("append").parquet(path)
    src = stream.snapshot_stream(spark, path, s.schema, max_files=10)
    out = _run(stream.deduplicate(src, ["event_id"]), tmp_path, "dd", "append", spark)
    assert out.count() == s.count()


def test_monotone_guard(spark, tmp_path):
    path = str(tmp_path / "m")
    assert stream.published(spark, path) is None
    write = stream.monotone_writer(path, "id")
    write(spark.range(10), 0)
    write(spark.range(5), 1)
    assert stream.published(spark, path).count() == 10
    write(spark.range(1, 20), 2)  # more keys, but one is lost
    assert stream.published(spark, path).count() == 10
    write(spark.range(12), 3)
    write(spark.range(12), 3)  # replayed
    assert stream.published(spark, path).count() == 12
    stream.monotone_writer(path, "id", exempt=spark.range(2))(spark.range(2, 12), 4)
    assert stream.published(spark, path).count() == 10


def test_routing(spark):
    s = V.snapshots(spark, SF)
    r = stream.route_by_reason(s, 1_705_000_000_000_000, 86_400_000_000)
    assert r.filter("reason is null").count() + r.filter("reason is not null").count() == s.count()
    assert r.filter("reason = 'QUOTE_TIMESTAMP_IN_FUTURE' and observed_us <= 1705000000000000").count() == 0
