"""Queries on the console's composite reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators import console as C
from folio.operators import runs as R
from folio.operators.grounding import viewed
from folio.plans.conforming import TABLE_MERGED, identity, merged_registry
from folio.plans.declared import SCHEMA
from folio.plans.documents import docs
from folio.plans.queue import CORRECTED, corrections
from folio.plans.runs import RUNS, now_of, runs
from folio.plans.tables import table
from folio.sources.payloads import typed
from folio.sources.schemas import field_rows


@query("overview", f"""
WITH {RUNS},
recent AS (SELECT run.* FROM run, now WHERE status IN ('queued', 'running') OR updated_at >= moment - INTERVAL 60 MINUTE)
SELECT 'counts' AS section, kind || '/' || status AS label, NULL::BIGINT AS run_id, count(*)::BIGINT AS n FROM recent GROUP BY kind, status
UNION ALL SELECT * FROM (SELECT 'failures', tenant_id, run_id, NULL::BIGINT FROM run WHERE status = 'failed' ORDER BY updated_at DESC, run_id DESC LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'longest', tenant_id, run_id, NULL::BIGINT FROM run WHERE status = 'running' ORDER BY started_at ASC NULLS LAST, run_id LIMIT 10)
""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overview(runs(spark, sf_dir), now_of(spark, sf_dir) - dt.timedelta(minutes=60), 10)


@query("overview_cards", f"""
WITH {RUNS} SELECT CASE status WHEN 'queued' THEN 'waiting' WHEN 'running' THEN 'working' WHEN 'succeeded' THEN 'done' ELSE 'broken' END AS card, count(*) FILTER (WHERE kind = 'extract')::BIGINT AS extract, count(*) FILTER (WHERE kind = 'ocr')::BIGINT AS ocr FROM run GROUP BY 1
""")
def overview_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cards(runs(spark, sf_dir))


@query("next_page", f"WITH {RUNS} SELECT created_at, run_id FROM run ORDER BY created_at DESC, run_id DESC LIMIT 1 OFFSET 24")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the page after the first 25 runs begins."""
    return C.next_page(R.page(runs(spark, sf_dir), 25), 25)


@query("schema_listing", f"""
WITH {TABLE_MERGED}, field AS (SELECT lang || '@' || doc_id % 4 AS schema_identity, source, bool_or(doc_id % 3 = 0) AS required FROM documents WHERE lang IS NOT NULL GROUP BY ALL)
SELECT schema_identity, m.source, shadowed, count(f.schema_identity) AS fields, count(*) FILTER (WHERE required) AS required FROM merged m JOIN field f USING (schema_identity) GROUP BY ALL
UNION ALL SELECT schema_identity, source, shadowed, NULL, NULL FROM merged WHERE schema_identity NOT IN (SELECT schema_identity FROM field)
""")  # fmt: skip
def schema_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered schemas with the fields declared for them: each language and version is a schema, its sources are fields."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    fields = rows.groupBy(identity(4).alias("schema_identity"), F.col("source").alias("path")).agg(F.bool_or(F.col("doc_id") % 3 == 0).alias("required"))
    return C.schema_listing(fields, merged_registry(spark, sf_dir).drop("prompt"))


@query("field_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, path, CASE path WHEN 'items.price' THEN 'decimal' WHEN 'items' THEN 'group' WHEN 'placed' THEN 'date' END AS type, CASE WHEN path = 'items.price' THEN 'items' END AS group_path
FROM (SELECT *, ['items.price', 'items', 'placed', 'other'][l_partkey % 4 + 1] AS path FROM lineitem)
""")
def field_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.array(*(F.lit(p) for p in ("items.price", "items", "placed", "other")))
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("order@1").alias("schema_identity"), F.try_element_at(paths, (F.col("l_partkey") % 4 + 1).cast("int")).alias("path"))
    return C.field_at(field_rows(spark, [SCHEMA]), asked).select("l_orderkey", "l_linenumber", "l_partkey", "path", "type", "group_path")


@query("default_locations", "SELECT vec_id AS document_id, 'value' AS field_path, CASE WHEN vec_id % 3 > 0 THEN embedding[1]::DOUBLE END AS x0 FROM embeddings")
def default_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda i: F.struct(F.element_at("embedding", i).cast("double").alias("x0"))
    boxes = F.slice(F.array(box(1), box(2)), F.lit(1), (F.col("vec_id") % 3).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit("value").alias("field_path"), boxes.alias("boxes"))
    return C.default_location(rows).select("document_id", "field_path", F.col("box.x0").alias("x0"))


@query("check_problems", f"""
WITH {RUNS} SELECT run_id, CASE WHEN run_id % 11 = 0 THEN 'unknown_run' WHEN run_id % 7 = 0 THEN 'unknown_field' WHEN status <> 'succeeded' THEN 'not_succeeded' WHEN run_id % 5 = 0 THEN 'value_type' END AS problem FROM run
""")
def check_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("run_id")
    given = F.when(k % 5 == 0, "2026-1-1").when(k % 3 == 0, "2026-01-01")
    return runs(spark, sf_dir).select("run_id", C.check_problem(k % 11 != 0, k % 7 != 0, F.col("status"), typed(given, "date"), given).alias("problem"))


@query("corrections_for_run", f"WITH {CORRECTED} SELECT annotator, given_at AS at, value FROM correction WHERE blob_id = 3")
def corrections_for_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corrections_for(corrections(spark, sf_dir).withColumnRenamed("blob_id", "run_id"), 3).select("annotator", "at", "value")


@query("erased_tenant", f"""
WITH {RUNS}, gone AS (SELECT * FROM run WHERE tenant_id = 'tenant7'), rest AS (SELECT * FROM run WHERE tenant_id <> 'tenant7')
SELECT 'runs' AS kept, count(*)::BIGINT AS n FROM rest UNION ALL SELECT 'corrections', count(*)::BIGINT FROM run WHERE run_id % 2 = 0 AND tenant_id <> 'tenant7'
UNION ALL SELECT 'artifacts removed', count(DISTINCT artifact_id)::BIGINT FROM gone WHERE artifact_id NOT IN (SELECT artifact_id FROM rest)
""")
def erased_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    parts = C.erased(rows, rows.where("run_id % 2 = 0").select("run_id"), "tenant7")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name, df in zip(("runs", "corrections", "artifacts removed"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("evaluation_list", f"""
WITH {RUNS} SELECT run_id AS evaluation_id, tenant_id, status, CASE WHEN run_id % 4 = 0 THEN run_id / 8.0::DOUBLE END AS field_accuracy, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, run_id DESC)::INT AS rank FROM run
""")
def evaluation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select(F.col("run_id").alias("evaluation_id"), "tenant_id", "status", "created_at")
    metrics = rows.where("evaluation_id % 4 = 0").select("evaluation_id", F.lit("field_accuracy").alias("metric"), (F.col("evaluation_id") / 8.0).alias("value"))
    return C.evaluation_summary(rows, metrics).drop("created_at")


@query("run_transitions", f"""
WITH {RUNS}, e AS (
  SELECT run_id, 'queued' AS to_state, created_at AS at_time, 0 AS o FROM run UNION ALL SELECT run_id, 'running', started_at, 1 FROM run WHERE started_at IS NOT NULL
  UNION ALL SELECT run_id, status, updated_at, 2 FROM run WHERE status IN ('succeeded', 'failed', 'cancelled'))
SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY o) - 1)::INT AS step, to_state, at_time AS "at" FROM e
""")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.transitions(runs(spark, sf_dir))


@query("view_offsets")
def view_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's view: are the parts that the fold changed in order and apart in both texts? Composition has no SQL form."""
    return C.offsets_sound(viewed(docs(spark, sf_dir)).select("document_id", F.col("_parts").alias("parts")))
