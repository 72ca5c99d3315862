"""Stages over many documents as one run, with reuse of what earlier runs made and counters observed while it writes.

A store is a folder of two tables. `artifacts` (stage, batch, failed; artifact_id, input_artifact_id, payload, content_id, failure,
first) has what stages made, `outcomes` (batch, stage; run_id, ids, status, failure) what became of each document in each stage:
executed, reused, failed or skipped. A stage plans the ids of its results from the ids of its inputs alone, so a document that an
earlier run has processed costs a join of ids and no payload is read for it.

Failures are kept, but never reused. Each batch has its own folders and is overwritten when it is repeated: a batch looks for its
results in the other batches only, so repeating one after a lost driver, or in a stream, gives the same rows. One run writes to a
store at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.functions.canonical import options_hash
from folio.functions.text import content_id
from folio.operators.identity import artifact_id

ARTIFACTS = "artifact_id string, input_artifact_id string, payload string, content_id string, failure string, first string, stage string, batch string, failed boolean"
OUTCOMES = "run_id string, ids map<string,string>, status string, failure string, stage string, batch string"
STATUSES = ("executed", "reused", "failed", "skipped")
COUNTERS = "stage string, executed long, reused long, failed long, skipped long, made long, characters long, duration_ms long"


class Stage(NamedTuple):
    """One stage: what names its results, and the work itself.

    `make` gets rows of artifact_id and a column of payload for each name in `uses` ("source" or an earlier stage; none: the one
    before), and returns artifact_id, payload and failure: one row each, where a failure is a reason in place of a payload. A row
    that it doesn't return has failed as `no_result`.
    """

    name: str
    processor: str
    version: str
    options: dict[str, Any]
    make: Callable[[DataFrame], DataFrame]
    uses: tuple[str, ...] = ()


class Conflict(ValueError):
    """A stage made something else of the same input under the same id."""


class Run(NamedTuple):
    outcomes: DataFrame
    counters: DataFrame
    artifacts: DataFrame


def artifacts(spark: SparkSession, store: str) -> DataFrame:
    """What stages have made, failures among them."""
    return spark.read.schema(ARTIFACTS).parquet(f"{store}/artifacts")


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    """What became of each document in each stage of each batch."""
    return spark.read.schema(OUTCOMES).parquet(f"{store}/outcomes")


def _prepare(spark: SparkSession, store: str) -> None:
    """An append of nothing makes the folders of a new store."""
    spark.createDataFrame([], ARTIFACTS).write.mode("append").partitionBy("stage", "batch", "failed").parquet(f"{store}/artifacts")
    spark.createDataFrame([], OUTCOMES).write.mode("append").partitionBy("batch", "stage").parquet(f"{store}/outcomes")


def run(documents: DataFrame, stages: list[Stage], store: str, batch: str, verify: bool = False) -> Run:
    """Take documents (run_id, source_id, payload) through the stages, in order.

    Documents of equal content are made once: the first by run_id is executed, the others reuse it. A document that fails in a
    stage is skipped in the rest. A null or repeated run_id is refused, as is a null source_id. With `verify` everything is made again and held against the store; what
    differs raises Conflict, after the batch is written without it.
    """
    spark = documents.sparkSession
    names = [s.name for s in stages]
    if len(set(names)) < len(names) or "source" in names:
        raise ValueError("stages need names of their own")
    _prepare(spark, store)
    seen = Observation()
    given = documents.select(F.col("run_id").cast("string").alias("run_id"), F.col("source_id").cast("string").alias("source_id")).groupBy("run_id").agg(F.count("*").alias("_n"), F.min("source_id").alias("source_id"))
    bad = F.count_if((F.col("_n") > 1) | F.col("run_id").isNull() | F.col("source_id").isNull()).alias("bad")
    now = given.observe(seen, bad).select("run_id", F.create_map(F.lit("source"), F.col("source_id")).alias("ids"), F.lit("executed").alias("status"), F.lit(None).cast("string").alias("failure"))
    _write(now, f"{store}/outcomes/batch={batch}/stage=source")
    if seen.get["bad"]:
        raise ValueError(f"{seen.get['bad']} documents have no id of their own")
    sources = documents.select(F.col("source_id").cast("string").alias("source_id"), F.col("payload").alias("source")).dropDuplicates(["source_id"])
    counted, conflicts = [], 0
    for i, stage in enumerate(stages):
        made, different, duration = _stage(spark, stage, ["source", *names][i], sources, store, batch, verify)
        counted.append((stage.name, *made, duration))
        conflicts += different
        if conflicts:
            break
    if conflicts:
        raise Conflict(f"{conflicts} results of {stage.name} differ from what the store has under their ids")
    rows = outcomes(spark, store).where((F.col("batch") == batch) & F.col("stage").isin(*names))
    return Run(rows, spark.createDataFrame(counted, COUNTERS), artifacts(spark, store).where(~F.col("failed")))


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def _stage(spark: SparkSession, stage: Stage, before: str, sources: DataFrame, store: str, batch: str, verify: bool):
    began = time.monotonic()
    last = outcomes(spark, store).where((F.col("batch") == batch) & (F.col("stage") == before))
    going = F.col("status").isin("executed", "reused")
    digest = options_hash(stage.options)
    planned = last.select("run_id", "ids", going.alias("_going"), F.when(going, artifact_id(F.col("ids")[before], stage.processor, stage.version, digest)).alias("artifact_id"))
    every = artifacts(spark, store)
    kept = every.where((F.col("stage") == stage.name) & (F.col("batch") != batch) & ~F.col("failed"))
    has = kept.select("artifact_id").distinct()

    todo = planned.where("_going").groupBy("artifact_id").agg(F.min("run_id").alias("first"), F.min_by("ids", "run_id").alias("ids"))
    if not verify:
        todo = todo.join(has, "artifact_id", "left_anti")
    inputs = todo
    for use in stage.uses or (before,):
        # A result may stand in more than one batch after a repeat; its content is the same.
        mine = sources if use == "source" else every.where((F.col("stage") == use) & ~F.col("failed")).groupBy("artifact_id").agg(F.first("payload").alias(use))
        key = "source_id" if use == "source" else "artifact_id"
        inputs = inputs.join(mine.withColumnRenamed(key, "_key"), F.col("ids")[use] == F.col("_key"), "left").drop("_key")
    made = stage.make(inputs.drop("first", "ids")).select("artifact_id", "payload", F.col("failure").cast("string").alias("failure"))
    facts = todo.select("artifact_id", F.col("ids")[before].alias("input_artifact_id"), "first")
    made = facts.join(made, "artifact_id", "left")
    reason = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("payload").isNull(), "no_result")
    made = made.select("artifact_id", "input_artifact_id", F.when(reason.isNull(), F.col("payload")).alias("payload"), reason.alias("failure"), "first")
    made = made.select("artifact_id", "input_artifact_id", "payload", F.when(F.col("failure").isNull(), content_id(F.col("payload"))).alias("content_id"), "failure", "first", F.col("failure").isNotNull().alias("failed"))
    work = Observation()
    counts = [F.count_if(~F.col("failed")).alias("made"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).cast("long").alias("characters")]
    if verify:
        known = kept.groupBy("artifact_id").agg(F.min("content_id").alias("_known"))
        differs = F.col("_known").isNotNull() & ~F.col("content_id").eqNullSafe(F.col("_known"))
        made = made.join(known, "artifact_id", "left").observe(work, *counts, F.count_if(differs).alias("differ")).where(F.col("_known").isNull()).drop("_known")
    else:
        made = made.observe(work, *counts)
    _write(made, f"{store}/artifacts/stage={stage.name}/batch={batch}", "failed")
    done = work.get

    # In verification all documents count as executed, though what the store has isn't written again.
    fresh = artifacts(spark, store).where((F.col("stage") == stage.name) & (F.col("batch") == batch)).select("artifact_id", F.col("first").alias("_first"), F.col("failure").alias("_failure"), F.col("failed").alias("_failed"))
    status = (
        F.when(F.col("_failed"), "failed").when(F.col("_has"), "executed" if verify else "reused")
        .when(F.col("_first") == F.col("run_id"), "executed").otherwise("executed" if verify else "reused")
    )
    rows = planned.where("_going").join(fresh, "artifact_id", "left").join(has.withColumn("_has", F.lit(True)), "artifact_id", "left")
    rows = rows.select("run_id", "ids", "artifact_id", status.alias("status"), "_failure")
    good = F.col("status") != "failed"
    rows = rows.select("run_id", F.when(good, F.map_concat("ids", F.create_map(F.lit(stage.name), F.col("artifact_id")))).otherwise(F.col("ids")).alias("ids"), "status", F.when(~good, F.col("_failure")).alias("failure"))
    # Those skipped have no id to be joined by.
    rows = rows.unionByName(planned.where("NOT _going").select("run_id", "ids", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("failure")))
    ends = Observation()
    rows = rows.observe(ends, *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    _write(rows, f"{store}/outcomes/batch={batch}/stage={stage.name}")
    end = ends.get
    return (*(end[s] for s in STATUSES), done["made"], done["characters"]), done.get("differ", 0), round((time.monotonic() - began) * 1000)


def each_batch(stages: list[Stage], store: str, name: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a stream's batch becomes a batch of the store under its number, so one that is given again overwrites itself."""

    def step(rows: DataFrame, number: int) -> None:
        run(rows, stages, store, f"{name}-{number}")

    return step
