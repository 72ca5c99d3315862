"""Runs through stages: what is reused, what fails, what is skipped, and what is counted meanwhile."""

import pytest
from pyspark.sql import functions as F

from folio.operators import stages as S

SCHEMA = "run_id string, source_id string, payload string"
ROWS = [("1", "a", "one 11"), ("2", "b", "two"), ("3", "a", "one 11"), ("4", "c", "  "), ("5", "d", "five 55 x"), ("6", "e", None), ("7", "f", "sevenfold " * 3000 + "77")]


def parse(rows):
    return rows.select("artifact_id", F.trim("source").alias("payload"), F.when(F.trim("source") == "", "empty_result").alias("failure"))


def extract(rows):
    found = F.regexp_extract("parse", "[0-9]{2}", 0)
    return rows.select("artifact_id", found.alias("payload"), F.when(found == "", "no_value").alias("failure"))


def ground(rows):
    return rows.select("artifact_id", F.expr("instr(parse, extract)").cast("string").alias("payload"), F.lit(None).cast("string").alias("failure"))


def stages(option=1, make=ground):
    return [S.Stage("parse", "p", "1", {}, parse), S.Stage("extract", "x", "1", {"n": option}, extract), S.Stage("ground", "g", "1", {}, make, ("parse", "extract"))]


def by_run(run):
    out = {}
    for r in run.outcomes.collect():
        out.setdefault(r["run_id"], {})[r["stage"]] = r["status"] if r["failure"] is None else r["failure"]
    return {k: tuple(v[s] for s in ("parse", "extract", "ground")) for k, v in out.items()}


WHOLE = ("executed",) * 3
FIRST = {
    "1": WHOLE, "2": ("executed", "no_value", "skipped"), "3": ("reused",) * 3, "4": ("empty_result", "skipped", "skipped"), "5": WHOLE,
    "6": ("no_result", "skipped", "skipped"), "7": WHOLE,
}


def counted(run):
    want = run.outcomes.groupBy("stage").pivot("status", list(S.STATUSES)).count().na.fill(0)
    key = lambda df: sorted(tuple(r) for r in df.select("stage", *S.STATUSES).collect())
    return key(run.counters), key(want)


def test_second_run_executes_nothing_and_an_option_moves_what_follows(spark, tmp_path):
    store, docs = str(tmp_path / "s"), spark.createDataFrame(ROWS, SCHEMA)
    first = S.run(docs, stages(), store, "b1")
    assert by_run(first) == FIRST
    assert {r["payload"] for r in first.artifacts.where("stage = 'ground'").collect()} == {"5", "6", str(30001)}
    assert counted(first)[0] == counted(first)[1]

    def never(rows):
        raise_if = F.udf(lambda x: 1 / 0, "string")
        return rows.select("artifact_id", raise_if("parse").alias("payload"), F.lit(None).alias("failure"))

    second = S.run(docs, stages(make=never), store, "b2")
    again = {k: tuple("reused" if s == "executed" else s for s in v) for k, v in FIRST.items()}
    assert by_run(second) == again
    made = {r["stage"]: (r["made"], r["characters"]) for r in second.counters.collect()}
    assert made == {"parse": (0, 0), "extract": (0, 0), "ground": (0, 0)}
    assert counted(second)[0] == counted(second)[1]

    third = S.run(docs, stages(option=2), store, "b3")
    assert by_run(third)["1"] == ("reused", "executed", "executed")
    assert by_run(third)["3"] == ("reused", "reused", "reused")
    assert by_run(third)["2"] == ("reused", "no_value", "skipped")
    assert S.outcomes(spark, store).select("batch").distinct().count() == 3


def test_a_repeated_batch_gives_the_same_rows(spark, tmp_path):
    store, docs = str(tmp_path / "s"), spark.createDataFrame(ROWS, SCHEMA)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    one = S.run(docs, stages(), store, "b1")
    before = key(one.outcomes), key(one.artifacts)
    two = S.run(docs, stages(), store, "b1")
    assert (key(two.outcomes), key(two.artifacts)) == before


def test_verification_finds_what_drifted(spark, tmp_path):
    store, docs = str(tmp_path / "s"), spark.createDataFrame(ROWS, SCHEMA)
    S.run(docs, stages(), store, "b1")
    checked = S.run(docs, stages(), store, "b2", verify=True)
    assert by_run(checked)["3"] == WHOLE
    assert checked.artifacts.count() == checked.artifacts.select("artifact_id").distinct().count()
    drifted = lambda rows: ground(rows).withColumn("payload", F.concat("payload", F.lit("!")))
    with pytest.raises(S.Conflict, match="3 results of ground"):
        S.run(docs, stages(make=drifted), store, "b3", verify=True)
    assert {r["payload"] for r in S.artifacts(spark, store).where("stage = 'ground' AND NOT failed").collect()} == {"5", "6", str(30001)}


def test_empty_tables_extra_columns_and_ids(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = S.run(docs.where("false"), stages(), str(tmp_path / "s"), "b1")
    assert none.outcomes.count() == 0
    assert [tuple(r)[1:7] for r in none.counters.collect()] == [(0,) * 6] * 3
    extra = docs.withColumn("artifact_id", F.lit("x")).withColumn("status", F.lit("failed")).withColumn("ids", F.lit(1))
    assert by_run(S.run(extra, stages(), str(tmp_path / "t"), "b1")) == FIRST
    for wrong in ([("1", "a", "x"), ("1", "b", "y")], [(None, "a", "x")], [("1", None, "x")]):
        with pytest.raises(ValueError, match="no id of their own"):
            S.run(spark.createDataFrame(wrong, SCHEMA), stages(), str(tmp_path / "u"), "b1")
    with pytest.raises(ValueError, match="names of their own"):
        S.run(docs, stages() + stages(), str(tmp_path / "u"), "b1")


def test_streamed_batches(spark, tmp_path):
    store, into = str(tmp_path / "s"), str(tmp_path / "in")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for part in ("run_id <= '2'", "run_id > '2'"):
        docs.where(part).coalesce(1).write.mode("append").parquet(into)
        stream = spark.readStream.schema(SCHEMA).parquet(into).writeStream.foreachBatch(S.each_batch(stages(), store, "docs"))
        stream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = S.outcomes(spark, store).where("stage = 'ground'").select("batch", "run_id", "status").collect()
    assert {(r["batch"], r["run_id"], r["status"]) for r in rows} == {
        ("docs-0", "1", "executed"), ("docs-0", "2", "skipped"), ("docs-1", "3", "reused"), ("docs-1", "4", "skipped"), ("docs-1", "5", "executed"), ("docs-1", "6", "skipped"), ("docs-1", "7", "executed"),
    }
