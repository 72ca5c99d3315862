"""Queries on the run queue's writes, its composite reads, corrections, evaluations and identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions import canonical as C
from folio.functions.text import content_id
from folio.operators import identity as I
from folio.operators import queue as Q
from folio.operators import runs as R
from folio.plans.runs import RUNS, now_of, runs
from folio.plans.tables import table

#: Runs with a worker, and a command to every third one, of which some come late or from another worker.
WORKED = f"""{RUNS},
worked AS (SELECT *, CASE WHEN status = 'running' THEN 'w' || run_id % 3 END AS worker_id FROM run),
command AS (
  SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'w9' ELSE 'w' || run_id % 3 END AS asking, CASE WHEN run_id % 6 = 0 THEN created_at + INTERVAL 3 HOUR ELSE created_at + INTERVAL 90 MINUTE END AS asked_at,
    CASE run_id % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' ELSE 'odd' END AS outcome
  FROM run WHERE run_id % 3 = 0),
held AS (SELECT w.*, c.asking, c.asked_at, c.outcome, c.run_id IS NOT NULL AS asked, coalesce(status = 'running' AND worker_id = asking AND lease_until > asked_at, false) AS holds FROM worked w LEFT JOIN command c USING (run_id))"""


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).withColumn("worker_id", F.when(F.col("status") == "running", F.concat(F.lit("w"), (F.col("run_id") % 3).cast("string"))))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("run_id")
    later = lambda text: F.col("created_at") + F.expr(f"INTERVAL {text}")
    outcome = F.when(k % 4 == 0, "succeeded").when(k % 4 == 1, "failed").when(k % 4 == 2, "cancelled").otherwise("odd")
    return runs(spark, sf_dir).where("run_id % 3 = 0").select(
        "run_id", F.when(k % 9 == 0, "w9").otherwise(F.concat(F.lit("w"), (k % 3).cast("string"))).alias("worker_id"), F.when(k % 6 == 0, later("3 HOURS")).otherwise(later("90 MINUTES")).alias("at"), outcome.alias("outcome")
    )


@query("heartbeats", f"WITH {WORKED} SELECT run_id, CASE WHEN holds THEN asked_at + INTERVAL 5 MINUTE ELSE lease_until END AS lease_until, CASE WHEN asked THEN holds END AS accepted FROM held")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.heartbeat(worked(spark, sf_dir), commands(spark, sf_dir), 300).select("run_id", "lease_until", "accepted")


@query("releases", f"""
WITH {WORKED} SELECT run_id, CASE WHEN holds THEN 'queued' ELSE status END AS status, CASE WHEN holds THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts, CASE WHEN NOT holds THEN worker_id END AS worker_id, CASE WHEN asked THEN holds END AS accepted FROM held
""")
def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.release(worked(spark, sf_dir), commands(spark, sf_dir)).select("run_id", "status", "attempts", "worker_id", "accepted")


@query("finishes", f"""
WITH {WORKED}, f AS (SELECT *, coalesce(status = 'running' AND worker_id = asking AND outcome <> 'odd', false) AS ends FROM held)
SELECT run_id, CASE WHEN ends THEN outcome ELSE status END AS status, CASE WHEN ends AND kind = 'ocr' THEN asked_at + INTERVAL 1 HOUR ELSE expires_at END AS expires_at, CASE WHEN asked THEN ends END AS accepted FROM f
""")
def finishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.finish(worked(spark, sf_dir), commands(spark, sf_dir), 3600).select("run_id", "status", "expires_at", "accepted")


@query("cancels", f"""
WITH {WORKED}, c AS (SELECT *, asked AND run_id % 9 <> 0 AND status IN ('queued', 'running', 'cancelled') AS yes FROM held)
SELECT run_id, CASE WHEN yes AND status = 'queued' THEN 'cancelled' ELSE status END AS status, yes AS cancel_requested, CASE WHEN asked THEN yes END AS accepted FROM c
""")
def cancels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancelled by the tenant, but every third time by another one."""
    rows = worked(spark, sf_dir)
    asked = commands(spark, sf_dir).drop("worker_id").join(rows.select("run_id", "tenant_id"), "run_id")
    asked = asked.select("run_id", F.when(F.col("run_id") % 9 == 0, "nobody").otherwise(F.col("tenant_id")).alias("worker_id"), "at")
    return Q.cancel(rows, asked).select("run_id", "status", "cancel_requested", "accepted")


KEYED = """have AS (SELECT event_id AS run_id, 'tenant' || user_id % 50 AS tenant_id, CASE WHEN event_id % 4 = 1 THEN 'k' || user_id END AS idempotency_key, ts AS created_at FROM events WHERE event_id % 2 = 1),
new AS (SELECT event_id AS run_id, 'tenant' || user_id % 50 AS tenant_id, CASE WHEN event_id % 4 = 0 THEN 'k' || user_id END AS idempotency_key, ts AS created_at FROM events WHERE event_id % 2 = 0),
first AS (SELECT tenant_id, idempotency_key, arg_min(run_id, {'c': created_at, 'r': run_id}) AS run_id FROM new WHERE idempotency_key IS NOT NULL GROUP BY ALL),
old AS (SELECT tenant_id, idempotency_key, min(run_id) AS run_id FROM have WHERE idempotency_key IS NOT NULL GROUP BY ALL)"""


@query("submissions", f"""
WITH {KEYED}
SELECT n.run_id AS submission, coalesce(o.run_id, f.run_id, n.run_id) AS run_id, o.run_id IS NULL AND coalesce(f.run_id, n.run_id) = n.run_id AS created
FROM new n LEFT JOIN first f USING (tenant_id, idempotency_key) LEFT JOIN old o USING (tenant_id, idempotency_key)
""")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's key names one run, whether it was there before or comes first in the batch."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("run_id"), F.concat(F.lit("tenant"), (F.col("user_id") % 50).cast("string")).alias("tenant_id"), F.when(k % 4 < 2, F.concat(F.lit("k"), F.col("user_id").cast("string"))).alias("idempotency_key"), F.col("ts").alias("created_at"))
    return Q.submit(rows.where("run_id % 2 = 1"), rows.where("run_id % 2 = 0"))[1]


@query("active_runs", f"WITH {RUNS} SELECT tenant_id, kind, count(*)::BIGINT AS active FROM run WHERE status IN ('queued', 'running') GROUP BY ALL")
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.active(runs(spark, sf_dir))


@query("run_lookup", f"""
WITH {RUNS} SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'other' ELSE tenant_id END AS tenant_id, CASE WHEN run_id % 5 = 0 THEN 'unknown' WHEN run_id % 7 = 0 THEN 'erased' ELSE status END AS answer FROM run
""")
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    left, stones = Q.entombed(rows, rows.where("run_id % 7 = 0"), now_of(spark, sf_dir))
    return Q.lookup(rows.select("run_id", F.when(F.col("run_id") % 5 == 0, "other").otherwise(F.col("tenant_id")).alias("tenant_id")), left, stones)


@query("run_owners", f"WITH {RUNS} SELECT run_id, tenant_id FROM run")
def run_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    return Q.owners(*Q.entombed(rows, rows.where("run_id % 7 = 0"), now_of(spark, sf_dir)))


@query("purge_counts", f"""
WITH {RUNS} SELECT 'runs' AS "table", count(*)::BIGINT AS removed FROM run WHERE tenant_id = 'tenant3' UNION ALL SELECT 'artifacts', count(*)::BIGINT FROM (SELECT DISTINCT tenant_id, artifact_id FROM run) WHERE tenant_id = 'tenant3'
""")
def purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What erasing a tenant removes, table by table."""
    rows = runs(spark, sf_dir)
    return Q.purged({"runs": rows, "artifacts": rows.select("tenant_id", "artifact_id").distinct()}, rows.where("tenant_id = 'tenant3'"), "tenant_id")


@query("public_runs", f"""
WITH {RUNS} SELECT run_id, status, CASE priority WHEN 0 THEN 'low' WHEN 1 THEN 'normal' ELSE 'high' END AS priority, CASE WHEN status IN ('succeeded', 'failed', 'cancelled') THEN updated_at END AS finished_at, least(priority, 1) AS granted FROM run
""")
def public_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worked(spark, sf_dir).withColumn("granted", Q.granted(F.col("priority"), F.lit(1)))
    return Q.public(rows).select("run_id", "status", "priority", "finished_at", "granted")


@query("ocr_admission", f"""
WITH {RUNS}, q AS (SELECT tenant_id, count(*) AS active FROM run WHERE status IN ('queued', 'running') AND kind = 'ocr' GROUP BY ALL), t AS (SELECT DISTINCT tenant_id FROM run)
SELECT t.tenant_id, CASE WHEN coalesce(active, 0) >= CASE WHEN t.tenant_id = 'tenant1' THEN 1 ELSE 4 END THEN 429 ELSE 202 END AS code FROM t LEFT JOIN q USING (tenant_id)
""")
def ocr_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir)
    queued = rows.where("kind = 'ocr' AND status IN ('queued', 'running')").groupBy("tenant_id").agg(F.count("*").alias("active"))
    return Q.admission(rows.select("tenant_id").distinct(), queued, 10**9, spark.createDataFrame([("tenant1", 1)], "tenant_id string, cap int"), 4)


@query("limit_order", f"""
WITH {RUNS}, u AS (SELECT tenant_id, count(*) AS submissions, count(*) FILTER (WHERE kind = 'extract') AS runs, sum(attempts) AS tokens, count(*) FILTER (WHERE status = 'running') AS concurrency FROM run GROUP BY ALL)
SELECT tenant_id, CASE WHEN submissions >= CASE WHEN tenant_id = 'tenant2' THEN 1 ELSE 1000000 END THEN 'submissions' WHEN runs >= 16 THEN 'runs' WHEN concurrency >= 5 THEN 'concurrency' END AS refused FROM u
""")
def limit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that a tenant has reached: submissions, runs, tokens (unlimited here), concurrency."""
    usage = runs(spark, sf_dir).groupBy("tenant_id").agg(F.count("*").alias("submissions"), F.count_if(F.col("kind") == "extract").alias("runs"), F.sum("attempts").alias("tokens"), F.count_if(F.col("status") == "running").alias("concurrency"))
    own = spark.createDataFrame([("tenant2", 1, None, None, None)], "tenant_id string, submissions long, runs long, tokens long, concurrency long")
    return Q.first_refusal(usage, own, {"submissions": 1_000_000, "runs": 16, "tokens": None, "concurrency": 5})


@query("listing_problems", f"""
WITH {RUNS} SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'status' WHEN run_id % 7 * 50 < 1 OR run_id % 7 * 50 > 200 THEN 'limit' WHEN run_id % 11 = 0 THEN 'cursor' END AS problem FROM run
""")
def listing_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("run_id")
    return runs(spark, sf_dir).select("run_id", Q.page_problem(F.when(k % 5 == 0, "odd").otherwise(F.col("status")), k % 7 * 50, F.when(k % 11 == 0, "other"), F.col("tenant_id")).alias("problem"))


@query("cursors", f"WITH {RUNS} SELECT run_id, CASE WHEN run_id % 3 <> 0 THEN run_id::VARCHAR END AS decoded_id FROM run")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's cursor there and back; another tenant's is refused."""
    code = R.cursor(F.col("tenant_id"), F.col("created_at"), F.col("run_id"))
    return runs(spark, sf_dir).select("run_id", Q.decoded(code, F.when(F.col("run_id") % 3 == 0, "other").otherwise(F.col("tenant_id")))["id"].alias("decoded_id"))


@query("run_outcomes", """
WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS n, CASE WHEN l_linenumber = l_partkey % 9 THEN 'failed' ELSE 'executed' END AS status, 'e' || l_partkey AS error FROM lineitem),
f AS (SELECT run_id, min({'n': n, 'e': error}) FILTER (WHERE status = 'failed') AS f FROM s GROUP BY run_id)
SELECT run_id, CASE WHEN f IS NULL THEN 'succeeded' ELSE 'failed' END AS outcome, f.n AS failed_stage, f.e AS error, CASE WHEN run_id % 4 = 0 THEN 'cancelled' ELSE coalesce(f.e, 'completed') END AS reason FROM f
""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, lines as stages: the outcome with the first stage that failed, and the transition's reason."""
    n = F.col("l_linenumber")
    stages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), n.alias("stage"), F.when(n == F.col("l_partkey") % 9, "failed").otherwise("executed").alias("status"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("error"))
    state = F.when(F.col("run_id") % 4 == 0, "cancelled").otherwise(F.col("outcome"))
    return Q.run_outcome(stages).withColumn("reason", Q.transition_reason(state, F.col("error")))


@query("deliveries_due", f"WITH {RUNS} SELECT run_id AS delivery_id, updated_at AS next_attempt_at FROM run, now WHERE attempts < 2 AND updated_at <= moment ORDER BY updated_at, run_id LIMIT 50")
def deliveries_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("attempts") < 2, "pending").otherwise("failed")
    return Q.due(runs(spark, sf_dir).select(F.col("run_id").alias("delivery_id"), state.alias("state"), F.col("updated_at").alias("next_attempt_at")), now_of(spark, sf_dir), 50).select("delivery_id", "next_attempt_at")


@query("delivery_payloads", f"""
WITH {RUNS} SELECT run_id, '{{"id":' || run_id || ',"status":"' || status || '","artifact_id":"' || artifact_id || '"' || CASE WHEN started_at IS NOT NULL THEN ',"started_at":"' || strftime(started_at, '%Y-%m-%d %H:%M:%S') || '"' ELSE '' END || '}}' AS payload FROM run
""")
def delivery_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).select("run_id", Q.payload(runs(spark, sf_dir)).alias("payload"))


CORRECTED = "correction AS (SELECT user_id AS blob_id, event_type AS field_path, event_id AS annotator, ts AS given_at, CASE WHEN event_id % 3 <> 0 THEN props END AS value FROM events)"


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("blob_id"), F.col("event_type").alias("field_path"), F.col("event_id").alias("annotator"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("value"))


@query("promotion_order", f"WITH {CORRECTED} SELECT annotator, row_number() OVER (PARTITION BY blob_id ORDER BY field_path, given_at, annotator)::INT AS rank FROM correction")
def promotion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.for_promotion(corrections(spark, sf_dir)).select("annotator", "rank")


@query("answer_set", f"""
WITH {CORRECTED}, newest AS (SELECT * FROM correction QUALIFY row_number() OVER (PARTITION BY blob_id, field_path ORDER BY given_at DESC, annotator DESC) = 1)
SELECT blob_id AS document_id, field_path, CASE WHEN value IS NULL THEN 'absent' ELSE 'value' END AS expectation, value FROM newest WHERE field_path IN ('click', 'view')
""")
def answer_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = R.newest(corrections(spark, sf_dir), ["blob_id", "field_path"], [F.desc("at"), F.desc("annotator")])
    return Q.answer_set(newest, ["click", "view"])


@query("run_predictions", f"""
WITH {RUNS}, e AS (SELECT DISTINCT artifact_id, 'v' || artifact_id AS value FROM run WHERE run_id % 5 <> 0)
SELECT run_id, CASE WHEN status <> 'failed' THEN value END AS value, CASE WHEN status = 'failed' THEN CASE WHEN run_id % 2 = 0 THEN 'ground' ELSE 'parse' END WHEN value IS NULL THEN 'missing_artifact' END AS reason FROM run LEFT JOIN e USING (artifact_id)
""")
def run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("failed_stage", F.when(F.col("run_id") % 2 == 0, "ground"))
    return Q.predictions_of(rows, rows.where("run_id % 5 <> 0").select("artifact_id", F.concat(F.lit("v"), "artifact_id").alias("value")).distinct())


@query("startable_evaluations", f"""
WITH {RUNS} SELECT tenant_id, kind AS schema_name, min(run_id) AS evaluation_id FROM run a WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.tenant_id = a.tenant_id AND b.kind = a.kind AND b.status = 'running' AND b.run_id % 3 = 0) GROUP BY ALL
""")
def startable_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).select("tenant_id", F.col("kind").alias("schema_name"), F.col("run_id").alias("evaluation_id"), "status")
    return Q.startable(rows.drop("status"), rows.where("status = 'running' AND evaluation_id % 3 = 0"))


@query("forgotten_documents", "SELECT o_custkey AS report_id, count(*) FILTER (WHERE o_orderkey <> 7)::BIGINT AS outcomes FROM orders GROUP BY ALL")
def forgotten_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as reports on documents: order 7 is struck from them."""
    reports = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("report_id")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("document_id"))).alias("outcomes"))
    return Q.forgotten(reports, 7).select("report_id", F.size("outcomes").cast("long").alias("outcomes"))


@query("evaluation_detail", """
SELECT l.doc_id AS document_id, 'quality' AS field_path, quality::VARCHAR AS expected, CASE WHEN l.doc_id % 3 <> 0 THEN n_chars::VARCHAR END AS extracted, CASE WHEN l.doc_id % 2 = 0 THEN 'correct' END AS kind FROM labels l LEFT JOIN documents d USING (doc_id)
""")
def evaluation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.col("doc_id").alias("document_id"), F.lit("quality").alias("field_path")]
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return Q.evaluation_detail(labels.select(*key, F.col("quality").cast("string").alias("value")), docs.where("doc_id % 3 <> 0").select(*key, F.col("n_chars").cast("string").alias("value")), labels.where("doc_id % 2 = 0").select(*key, F.lit("correct").alias("kind")))


@query("job_status", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'unavailable' ELSE 'succeeded' END AS job_status FROM documents
""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = content_id(F.concat(F.lit("job"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, "sha256:odd").otherwise(real).alias("artifact_id"))
    artifacts = docs.select(real.alias("artifact_id"), F.when(F.col("doc_id") % 3 == 0, "ground").otherwise("validate").alias("stage"))
    return Q.job_status(asked, artifacts).select("doc_id", "job_status")


#: The options of the three stages, and their hashes.
STAGES = (("extract", "3", C.extraction_options_hash(schema_identity="order@1", model_id="m", temperature=0.0)), ("ground", "2", C.options_hash({"threshold": 0.9, "budget": 1500})), ("validate", "1", C.options_hash({"rules": None})))
CHAIN = "a0 AS (SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS document_id FROM documents)" + "".join(
    f""", a{i} AS (SELECT *, 'sha256:' || sha256('{{"input":"' || {source} || '","options_hash":"{options}","processor_id":"{name}","processor_version":"{version}"}}') AS {out} FROM a{i - 1})"""
    for i, ((name, version, options), source, out) in enumerate(zip(STAGES, ("document_id", "extraction_id", "grounding_id"), ("extraction_id", "grounding_id", "validation_id"), strict=True), 1)
)


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", content_id(F.coalesce("text", F.lit(""))).alias("document_id"))
    return rows.withColumns(C.artifact_chain(F.col("document_id"), *STAGES))


@query("artifact_ids", f"WITH {CHAIN} SELECT doc_id, extraction_id, grounding_id, validation_id, 'sha256:' || sha256('{{\"document_id\":\"' || document_id || '\",\"kind\":\"orientation\",\"v\":\"1\"}}') AS orientation_id FROM a3")
def artifact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a document's extraction, grounding and validation, each of its input and options."""
    return chain(spark, sf_dir).withColumn("orientation_id", C.orientation_id(F.col("document_id"))).drop("document_id")


@query("report_ids", f"""
WITH {CHAIN}, pair AS (SELECT source, document_id, validation_id FROM a3 JOIN documents USING (doc_id)),
{I.set_id_sql("gold", "pair", "source", "document_id")}, {I.set_id_sql("made", "pair", "source", "validation_id")}
SELECT gold.source, 'sha256:' || sha256('{{"golden_set_id":"' || gold.set_id || '","options_hash":"o","prediction_set_id":"' || made.set_id || '"}}') AS report_id
FROM gold JOIN made USING (source)
""")
def report_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's id of its labelled set, its predictions and its options, for each source."""
    rows = chain(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    of = lambda member, name: I.set_id(rows, ["source"], member).select("source", F.col("set_id").alias(name))
    both = of("document_id", "_g").join(of("validation_id", "_p"), "source")
    return both.select("source", C.report_id(F.col("_g"), F.col("_p"), "o").alias("report_id"))


@query("stored_results", f"""
WITH {CHAIN}
SELECT validation_id, CASE WHEN true THEN grounding_id END AS grounding_id, CASE WHEN min(doc_id % 7) > 0 OR max(doc_id % 7) > 0 THEN extraction_id END AS extraction_id, bool_or(doc_id % 7 <> 0) AND bool_or(doc_id % 5 <> 0) AS complete
FROM a3 GROUP BY validation_id, grounding_id, extraction_id
""")
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validations with the grounding and extraction they came from, where the store has them."""
    rows = chain(spark, sf_dir)
    part = lambda df, out, source: df.select(F.col(out).alias("artifact_id"), F.col(source).alias("input_artifact_id")).distinct()
    return Q.stored_result(part(rows, "validation_id", "grounding_id"), part(rows.where("doc_id % 7 <> 0"), "grounding_id", "extraction_id"), part(rows.where("doc_id % 5 <> 0"), "extraction_id", "document_id"))
