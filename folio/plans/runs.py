"""Queries on identity, lineage, the run queue, limits, retention and delivery."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions.text import content_id
from folio.operators import identity as I
from folio.operators import runs as R
from folio.plans.tables import table

#: Events as runs: their type is the status. Times are relative to the newest event.
STATUS = {"click": "queued", "view": "running", "purchase": "succeeded", "error": "failed", "signup": "cancelled"}
RUNS = """now AS (SELECT max(ts) AS moment FROM events),
run AS (
  SELECT event_id AS run_id, 'tenant' || user_id % 50 AS tenant_id, CASE WHEN event_id % 4 = 0 THEN 'ocr' ELSE 'extract' END AS kind,
    CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
    event_id % 4 AS attempts, user_id % 3 AS priority, ts AS created_at, ts + INTERVAL 1 HOUR AS updated_at, CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN ts END AS started_at,
    ts + INTERVAL 2 HOUR AS lease_until, ts + INTERVAL 10 DAY AS expires_at, 'artifact' || event_id // 2 AS artifact_id
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.lit("cancelled")
    for kind, name in STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    hours = lambda n: F.col("ts") + F.expr(f"INTERVAL {n} HOURS")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.concat(F.lit("tenant"), (F.col("user_id") % 50).cast("string")).alias("tenant_id"), F.when(F.col("event_id") % 4 == 0, "ocr").otherwise("extract").alias("kind"),
        status.alias("status"), (F.col("event_id") % 4).alias("attempts"), (F.col("user_id") % 3).alias("priority"), F.col("ts").alias("created_at"), hours(1).alias("updated_at"),
        F.when((F.col("event_type") == "view") & (F.col("event_id") % 5 != 0), F.col("ts")).alias("started_at"), hours(2).alias("lease_until"), hours(240).alias("expires_at"),
        F.concat(F.lit("artifact"), F.floor(F.col("event_id") / 2).cast("string")).alias("artifact_id"),
    )


def now_of(spark: SparkSession, sf_dir: str) -> dt.datetime:
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


@query("identity_chain", """
WITH a AS (SELECT doc_id, 'sha256:' || sha256(text) AS blob_id FROM documents),
b AS (SELECT *, 'sha256:' || sha256('{"blob_id":"' || blob_id || '","options_hash":"o1","parser_id":"native","parser_version":"2","v":"1"}') AS document_id FROM a)
SELECT doc_id, blob_id, document_id, 'sha256:' || sha256('{"input":"' || document_id || '","options_hash":"o2","processor_id":"extract","processor_version":"1"}') AS extraction_id FROM b
""")
def identity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", content_id(F.col("text")).alias("blob_id"))
    rows = rows.withColumn("document_id", I.document_id(F.col("blob_id"), "native", "2", "o1"))
    return rows.withColumn("extraction_id", I.artifact_id(F.col("document_id"), "extract", "1", "o2"))


@query("reuse_antijoin", """
SELECT 'sha256:' || sha256(text) AS artifact_id, count(*)::BIGINT AS documents, bool_or(r.h IS NOT NULL) AS reused
FROM documents LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 2 = 0) r ON r.h = sha256(text) GROUP BY ALL
""")
def reuse_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose artifact is there already, as even documents made it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", content_id(F.col("text")).alias("artifact_id"))
    ids = docs.groupBy("artifact_id").agg(F.count("*").alias("documents"))
    return I.planned(ids, docs.where("doc_id % 2 = 0"))


@query("set_ids", f"""
WITH doc AS (SELECT source, 'sha256:' || sha256(text) AS h FROM documents), {I.set_id_sql("ids", "doc", "source", "h")}
SELECT source, set_id, members FROM ids
""")
def set_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", content_id(F.col("text")).alias("h"))
    return I.set_id(rows, ["source"], "h")


@query("derivation_chain", """
WITH RECURSIVE store AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 2 END AS input, o_orderstatus AS stage FROM orders),
chain AS (
  SELECT id AS root_id, 0 AS step, id AS artifact_id, stage, input, [id] AS seen FROM store
  UNION ALL SELECT c.root_id, c.step + 1, s.id, s.stage, s.input, list_append(c.seen, s.id) FROM chain c JOIN store s ON s.id = c.input WHERE NOT list_contains(c.seen, s.id))
SELECT root_id::VARCHAR AS root_id, step, artifact_id::VARCHAR AS artifact_id, stage FROM chain
""")
def derivation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as artifacts made of the one of half their number."""
    text = lambda c: c.cast("string")
    store = table(spark, sf_dir, "orders").select(text(F.col("o_orderkey")).alias("artifact_id"), text(F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_orderkey") / 2))).alias("input_artifact_id"), F.col("o_orderstatus").alias("stage"))
    return I.lineage(store, store)


@query("artifact_put", """
WITH store AS (SELECT doc_id % 300 AS id, min(sha256(text)) AS c FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), new AS (SELECT doc_id % 400 AS id, min(sha256(text)) AS c FROM documents GROUP BY 1)
SELECT n.id::VARCHAR AS artifact_id, CASE WHEN s.id IS NULL THEN 'added' ELSE 'conflict' END AS result FROM new n LEFT JOIN store s USING (id) WHERE s.id IS NULL OR s.c <> n.c
""")
def artifact_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What adding artifacts to a store adds, and where it conflicts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("_c"))
    made = lambda rows, n: rows.groupBy((F.col("doc_id") % n).cast("string").alias("artifact_id")).agg(F.min("_c").alias("content_id"))
    add, conflicts = I.put(made(docs.where("doc_id % 2 = 0"), 300), made(docs, 400))
    return add.select("artifact_id", F.lit("added").alias("result")).unionByName(conflicts.select("artifact_id", F.lit("conflict").alias("result")))


STAGE_ROWS = """step AS (
  SELECT l_orderkey AS run_id, ['parse', 'extract', 'ground', 'validate'][(l_linenumber - 1) % 4 + 1] AS stage, max(CASE WHEN l_partkey % 9 = 0 THEN 'failed' WHEN l_partkey % 2 = 0 THEN 'reused' ELSE 'executed' END) AS status, max(l_partkey)::BIGINT AS duration_ms
  FROM lineitem GROUP BY 1, 2)"""


@query("stage_counts", f"""
WITH {STAGE_ROWS}, o AS (SELECT *, list_position(['parse', 'extract', 'ground', 'validate'], stage) AS k FROM step), f AS (SELECT run_id, min(k) AS moment FROM o WHERE status = 'failed' GROUP BY 1),
out AS (
  SELECT o.run_id, o.stage, o.status, o.duration_ms FROM o LEFT JOIN f USING (run_id) WHERE moment IS NULL OR k <= moment
  UNION ALL SELECT run_id, s, 'skipped', 0 FROM f, unnest(['parse', 'extract', 'ground', 'validate']) AS u(s) WHERE list_position(['parse', 'extract', 'ground', 'validate'], s) > moment)
SELECT stage, count(*) FILTER (WHERE status = 'executed')::BIGINT AS executed, count(*) FILTER (WHERE status = 'reused')::BIGINT AS reused, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed,
  count(*) FILTER (WHERE status = 'skipped')::BIGINT AS skipped, coalesce(sum(duration_ms) FILTER (WHERE status = 'executed'), 0)::BIGINT AS duration_ms
FROM out GROUP BY stage
""")  # fmt: skip
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as stages of a run: after a failed stage the others are skipped."""
    status = F.when(F.col("l_partkey") % 9 == 0, "failed").when(F.col("l_partkey") % 2 == 0, "reused").otherwise("executed")
    stage = F.element_at(F.array(*(F.lit(s) for s in I.STAGES)), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int")).alias("stage")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), stage).agg(F.max(status).alias("status"), F.max("l_partkey").alias("duration_ms"))
    return I.stage_counts(I.with_skipped(rows))


@query("runs_page", f"""
WITH {RUNS}
SELECT run_id, tenant_id, status, created_at FROM run, now WHERE status = 'failed' AND (created_at, run_id) < (moment - INTERVAL 1 DAY, 0) ORDER BY created_at DESC, run_id DESC LIMIT 50
""")
def runs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = now_of(spark, sf_dir) - dt.timedelta(days=1), 0
    return R.page(runs(spark, sf_dir), 50, before, status="failed").select("run_id", "tenant_id", "status", "created_at")


@query("status_counts", f"WITH {RUNS} SELECT kind, status, count(*)::BIGINT AS runs FROM run, now WHERE status IN ('queued', 'running') OR updated_at >= moment - INTERVAL 60 MINUTE GROUP BY kind, status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.status_counts(runs(spark, sf_dir), now_of(spark, sf_dir) - dt.timedelta(hours=1))


@query("latest_failed", f"WITH {RUNS} SELECT run_id, tenant_id, updated_at FROM run WHERE status = 'failed' ORDER BY updated_at DESC, run_id DESC LIMIT 10")
def latest_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(runs(spark, sf_dir), "failed", 10).select("run_id", "tenant_id", "updated_at")


@query("longest_running", f"WITH {RUNS} SELECT run_id, tenant_id, started_at FROM run WHERE status = 'running' ORDER BY started_at NULLS LAST, run_id LIMIT 10")
def longest_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_running(runs(spark, sf_dir), 10).select("run_id", "tenant_id", "started_at")


@query("claim_order", f"""
WITH {RUNS}, served AS (SELECT tenant_id, count(*) AS recent FROM run, now WHERE status <> 'queued' AND updated_at >= moment - INTERVAL 86400 SECOND GROUP BY 1)
SELECT run_id, tenant_id, coalesce(recent, 0)::BIGINT AS recent, created_at < moment - INTERVAL 259200 SECOND AS starved, priority
FROM run CROSS JOIN now LEFT JOIN served USING (tenant_id) WHERE (status = 'queued' OR (status = 'running' AND lease_until < moment)) AND attempts < 3
ORDER BY starved DESC, 3, priority DESC, created_at, run_id LIMIT 100
""")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.claim_order(runs(spark, sf_dir), now_of(spark, sf_dir), 259_200, 86_400, 3, 100).select("run_id", "tenant_id", "recent", "starved", "priority")


@query("abandoned_runs", f"WITH {RUNS} SELECT run_id, tenant_id, 'failed' AS status FROM run, now WHERE (status = 'queued' OR (status = 'running' AND lease_until < moment)) AND attempts >= 3")
def abandoned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.abandoned(runs(spark, sf_dir), now_of(spark, sf_dir), 3).select("run_id", "tenant_id", "status")


ANSWERS = "answer AS (SELECT event_type AS schema_name, user_id AS blob_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("schema_name"), F.col("user_id").alias("blob_id"), "event_id", "value", "ts")
    return R.newest(rows, ["schema_name", "blob_id"], [F.desc("ts"), F.desc("event_id")])


@query("answers_newest", f"WITH {ANSWERS} SELECT * FROM answer")
def answers_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).drop("ts")


@query("answer_summary", f"WITH {ANSWERS} SELECT schema_name, count(DISTINCT blob_id)::BIGINT AS documents, count(*)::BIGINT AS answers FROM answer GROUP BY schema_name")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answer_summary(answers(spark, sf_dir))


WINDOW_S = 7 * 86_400
WINDOWS = f"""counter AS (
  SELECT 'tenant' || user_id % 50 AS tenant_id, make_timestamp((epoch_us(ts) // 1000000 // {WINDOW_S}) * {WINDOW_S} * 1000000) AS window_start, count(*)::BIGINT AS value FROM events GROUP BY 1, 2)"""


@query("limit_windows", f"WITH {WINDOWS} SELECT * FROM counter")
def limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions by tenant in weeks that begin with the epoch's."""
    return R.windows(runs(spark, sf_dir), WINDOW_S, ["tenant_id"], "created_at")


@query("limit_refusals", f"""
WITH {WINDOWS}, now AS (SELECT max(ts) AS moment FROM events),
used AS (SELECT tenant_id, value, CASE WHEN substr(tenant_id, 7)::INT < 10 THEN substr(tenant_id, 7)::INT ELSE 20 END::BIGINT AS permitted, window_start, moment FROM counter, now WHERE window_start <= moment AND moment < window_start + INTERVAL {WINDOW_S} SECOND)
SELECT tenant_id, value, permitted, (epoch_us(window_start) // 1000000 + {WINDOW_S} - epoch_us(moment) // 1000000 + 1)::BIGINT AS retry_after_s FROM used WHERE value >= permitted
""")
def limit_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants over their limit in the newest week: ten of them have one of their own."""
    own = [(f"tenant{i}", i) for i in range(10)] + [(None, 20)]
    limits = spark.createDataFrame(own, "tenant_id string, permitted long")
    return R.refusals(limit_windows(spark, sf_dir), limits, now_of(spark, sf_dir), WINDOW_S)


@query("retention_difference", f"""
WITH {RUNS}, gone AS (SELECT run_id FROM run, now WHERE status IN ('succeeded', 'failed', 'cancelled') AND expires_at <= moment - INTERVAL 2 DAY AND run_id % 6 <> 0)
SELECT DISTINCT artifact_id FROM run WHERE run_id IN (FROM gone) AND artifact_id NOT IN (SELECT artifact_id FROM run WHERE run_id NOT IN (FROM gone))
""")
def retention_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts that go with the runs past their time; every sixth run is pinned by a correction."""
    rows, now = runs(spark, sf_dir), now_of(spark, sf_dir) - dt.timedelta(days=2)
    corrections = rows.where("run_id % 6 = 0").select("run_id", F.lit(now + dt.timedelta(days=1)).alias("expires_at"))
    gone = R.sweep(rows, corrections, now)
    return R.unreferenced(gone, rows.join(gone.select("run_id"), "run_id", "left_anti"))


@query("delivery_backoff", """
WITH d AS (SELECT event_id, event_id % 6 + 1 AS attempts, CASE WHEN event_type = 'purchase' THEN 204 ELSE 503 END AS code, (SELECT max(ts) FROM events) AS moment FROM events)
SELECT event_id, attempts, CASE WHEN code = 204 THEN 'delivered' WHEN attempts >= 6 THEN 'failed' ELSE 'pending' END AS state,
  CASE WHEN code <> 204 AND attempts < 6 THEN epoch_us(moment) // 1000000 + least(7200 * pow(2, attempts - 1), 86400)::BIGINT END::BIGINT AS next_attempt_s
FROM d
""")
def delivery_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 6).alias("attempts"), F.when(F.col("event_type") == "purchase", 204).otherwise(503).alias("code"))
    return R.attempted(rows, now_of(spark, sf_dir), 7200).select("event_id", "attempts", "state", "next_attempt_s")


@query("evaluation_settled", f"WITH {RUNS} SELECT tenant_id AS evaluation_id, bool_and(status NOT IN ('queued', 'running')) AS settled, count(*)::BIGINT AS runs FROM run GROUP BY 1")
def evaluation_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.settled(runs(spark, sf_dir).withColumnRenamed("tenant_id", "evaluation_id"))


@query("tenants", f"WITH {RUNS} SELECT DISTINCT tenant_id FROM run UNION SELECT DISTINCT source FROM documents")
def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("tenant_id").unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("tenant_id"))).distinct()


@query("schema_flatten", """
SELECT event_id, 'k' AS field_path, 'int' AS type, props->>'k' AS value, (props->>'k') IS NOT NULL AS present FROM events
""")
def schema_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that a payload holds for a declared field."""
    from folio.sources.payloads import flattened

    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"))
    return flattened(rows, ["event_id"], {"k": "int"})
