import datetime as dt

from folio.streaming import limits

EVENTS = "tenant_id string, idempotency_key string, ts timestamp"


def stream(spark, tmp_path, rows, schema):
    """The rows as a stream of one file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def drained(df, tmp_path, name, mode):
    run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        run.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        run.stop()


def at(minute):
    return dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_window_counters(spark, tmp_path):
    events = stream(spark, tmp_path, [("a", "1", at(0)), ("a", "2", at(4)), ("a", "3", at(6)), ("b", "4", at(1))], EVENTS)
    got = drained(limits.counters(events, 300, "10 minutes", ["tenant_id"]), tmp_path, "counted", "update")
    assert sorted((r.tenant_id, r.window_start.minute, r.value) for r in got) == [("a", 0, 2), ("a", 5, 1), ("b", 0, 1)]


def test_replays_are_dropped(spark, tmp_path):
    events = stream(spark, tmp_path, [("a", "k", at(0)), ("a", "k", at(1)), ("b", "k", at(1))], EVENTS)
    assert len(drained(limits.submissions(events, "1 hour"), tmp_path, "submitted", "append")) == 2
