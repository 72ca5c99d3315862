"""Queries on runs through stages: documents parsed, a number found in each, its place told, its form judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions.canonical import options_hash
from folio.functions.text import content_id
from folio.operators import stages as S
from folio.operators.lineage import shared_folder
from folio.plans.tables import table

NAMES = ("parse", "extract", "ground", "validate")


def none() -> Column:
    """No failure."""
    return F.lit(None).cast("string").alias("failure")


def parse(rows: DataFrame) -> DataFrame:
    text = F.trim(F.regexp_replace("source", "[ \t\r\n]+", " "))
    return rows.select("artifact_id", text.alias("payload"), F.when(text == "", "empty_result").alias("failure"))


def extract(rows: DataFrame) -> DataFrame:
    found = F.regexp_extract("parse", "[0-9][0-9]+", 0)
    return rows.select("artifact_id", found.alias("payload"), F.when(found == "", "no_value").alias("failure"))


def ground(rows: DataFrame) -> DataFrame:
    return rows.select("artifact_id", F.expr("instr(parse, extract) - 1").cast("string").alias("payload"), none())


def validate(rows: DataFrame) -> DataFrame:
    return rows.select("artifact_id", F.when(F.length("extract") % 2 == 0, "valid").otherwise("needs_review").alias("payload"), none())


def stages(version: int = 1) -> list[S.Stage]:
    """The four stages; the version is an option of the extraction."""
    return [
        S.Stage("parse", "parse", "1", {}, parse), S.Stage("extract", "extract", "1", {"version": version}, extract),
        S.Stage("ground", "ground", "1", {}, ground, ("parse", "extract")), S.Stage("validate", "validate", "1", {}, validate, ("extract",)),
    ]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("run_id"), content_id(text).alias("source_id"), text.alias("payload"), "doc_id")


def made_id(before: str, name: str, options: dict) -> str:
    return f"""'sha256:' || sha256('{{"input":"' || {before} || '","options_hash":"{options_hash(options)}","processor_id":"{name}","processor_version":"1"}}')"""


def sql(version: int, earlier: str) -> str:
    """Every document's stages, where `earlier` tells which documents an earlier run of the same options took. `since` is the first stage that no earlier run made."""
    return f"""t AS (SELECT doc_id, coalesce(text, '') AS text, 'sha256:' || sha256(coalesce(text, '')) AS i0 FROM documents),
p AS (SELECT *, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS parsed FROM t),
x AS (SELECT *, regexp_extract(parsed, '[0-9][0-9]+') AS found, {made_id("i0", "parse", {})} AS i1 FROM p),
y AS (SELECT *, {made_id("i1", "extract", {"version": version})} AS i2 FROM x), z AS (SELECT *, {made_id("i2", "ground", {})} AS i3 FROM y),
w AS (
  SELECT *, {made_id("i3", "validate", {})} AS i4, CASE WHEN parsed = '' THEN 1 WHEN found = '' THEN 2 ELSE 9 END AS ends, doc_id::VARCHAR = min(doc_id::VARCHAR) OVER same AS leads, bool_or({earlier}) OVER same AS had,
    (strpos(parsed, found) - 1)::VARCHAR AS place, CASE WHEN length(found) % 2 = 0 THEN 'valid' ELSE 'needs_review' END AS verdict
  FROM z WINDOW same AS (PARTITION BY i0)),
stage AS (SELECT unnest([1, 2, 3, 4]) AS n),
outcome AS (
  SELECT doc_id::VARCHAR AS run_id, n, ['parse', 'extract', 'ground', 'validate'][n] AS stage,
    CASE WHEN n > ends THEN 'skipped' WHEN n = ends THEN 'failed' WHEN had AND n < since THEN 'reused' WHEN leads THEN 'executed' ELSE 'reused' END AS status,
    CASE WHEN n = ends THEN ['empty_result', 'no_value'][n] END AS failure, CASE WHEN n < ends THEN [i1, i2, i3, i4][n] END AS artifact_id, [parsed, found, place, verdict][n] AS payload
  FROM w, stage, since)"""


@query("staged_runs", f"WITH since AS (SELECT 9 AS since), {sql(1, 'doc_id % 3 <> 0')} SELECT run_id, stage, status, failure, artifact_id FROM outcome")
def staged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, after a run that took two of three: what is executed, reused, failed and skipped."""
    docs, store = documents(spark, sf_dir), shared_folder(spark, "stages")
    S.run(docs.where("doc_id % 3 <> 0"), stages(), store, "earlier")
    rows = S.run(docs, stages(), store, "later").outcomes
    return rows.select("run_id", "stage", "status", "failure", F.when(F.col("status").isin("executed", "reused"), F.col("ids")[F.col("stage")]).alias("artifact_id"))


@query("observed_counts", f"""
WITH since AS (SELECT 2 AS since), {sql(2, 'true')}
SELECT stage, count(*) FILTER (WHERE status = 'executed')::BIGINT AS executed, count(*) FILTER (WHERE status = 'reused')::BIGINT AS reused, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed, count(*) FILTER (WHERE status = 'skipped')::BIGINT AS skipped,
  count(*) FILTER (WHERE status = 'executed')::BIGINT AS made, coalesce(sum(length(payload)) FILTER (WHERE status = 'executed'), 0)::BIGINT AS characters FROM outcome GROUP BY stage
""")
def observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a run observes while it writes, after an option of the extraction has changed."""
    docs, store = documents(spark, sf_dir), shared_folder(spark, "stages")
    S.run(docs, stages(1), store, "one")
    return S.run(docs, stages(2), store, "two").counters.drop("duration_ms")


@query("staged_results", f"WITH since AS (SELECT 9 AS since), {sql(1, 'false')} SELECT artifact_id, stage, payload, 'sha256:' || sha256(payload) AS content_id FROM outcome WHERE status = 'executed'")
def staged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of all documents, each distinct text once."""
    return S.run(documents(spark, sf_dir), stages(), shared_folder(spark, "stages"), "one").artifacts.select("artifact_id", "stage", "payload", "content_id")
