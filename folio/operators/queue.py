"""The run queue's writes as decisions over a table of runs: one row a run, one command a run and batch.

Each function takes runs and commands(run_id, worker_id, at) and returns all runs after the batch, with `accepted` where a
command was given (else null). A table format's merge by run_id applies the result; nothing is updated in place here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.runs import TERMINAL


def commanded(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """Runs with their command's worker and time as _worker and _at; of several commands to one run the earliest counts."""
    first = commands.groupBy("run_id").agg(F.min(F.struct("at", "worker_id", *(c for c in commands.columns if c not in ("run_id", "at", "worker_id")))).alias("_c"))
    return runs.join(first, "run_id", "left")


def answered(rows: DataFrame, accepted: Column, changes: dict[str, Column]) -> DataFrame:
    """The rows with `changes` where the command is accepted."""
    asked = F.col("_c").isNotNull()
    yes = asked & F.coalesce(accepted, F.lit(False))
    return rows.withColumns({**{c: F.when(yes, v).otherwise(F.col(c)) for c, v in changes.items()}, "accepted": F.when(asked, yes)}).drop("_c")


def holds() -> Column:
    """Whether the command's worker holds the run: it is running, by that worker, and its lease hasn't run out."""
    return (F.col("status") == "running") & (F.col("worker_id") == F.col("_c.worker_id")) & (F.col("lease_until") > F.col("_c.at"))


def heartbeat(runs: DataFrame, commands: DataFrame, lease_s: int) -> DataFrame:
    """The holder's lease is extended."""
    return answered(commanded(runs, commands), holds(), {"lease_until": F.col("_c.at") + F.expr(f"INTERVAL {lease_s} SECONDS")})


def release(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """The holder gives the run back: queued, as if it hadn't been claimed."""
    changes = {"status": F.lit("queued"), "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)), "worker_id": F.lit(None).cast("string"), "lease_until": F.lit(None).cast(runs.schema["lease_until"].dataType), "updated_at": F.col("_c.at")}
    return answered(commanded(runs, commands), holds(), changes)


def finish(runs: DataFrame, commands: DataFrame, retained_s: int) -> DataFrame:
    """The holder ends the run with the command's outcome, once; a recognition run's time to live starts anew."""
    changes = {
        "status": F.col("_c.outcome"), "updated_at": F.col("_c.at"), "lease_until": F.lit(None).cast(runs.schema["lease_until"].dataType),
        "expires_at": F.when(F.col("kind") == "ocr", F.col("_c.at") + F.expr(f"INTERVAL {retained_s} SECONDS")).otherwise(F.col("expires_at")),
    }
    return answered(commanded(runs, commands), (F.col("status") == "running") & (F.col("worker_id") == F.col("_c.worker_id")) & F.col("_c.outcome").isin(*TERMINAL), changes)


def cancel(runs: DataFrame, commands: DataFrame) -> DataFrame:
    """A queued run ends at once, a running one is marked; cancelling again is accepted, another ended run refuses. worker_id is the asking tenant."""
    mine = F.col("tenant_id") == F.col("_c.worker_id")
    status = F.when(F.col("status").isin("queued", "cancelled"), "cancelled").otherwise(F.col("status"))
    changes = {"status": status, "cancel_requested": F.lit(True), "updated_at": F.when(F.col("status") == "queued", F.col("_c.at")).otherwise(F.col("updated_at"))}
    return answered(commanded(runs.withColumn("cancel_requested", F.lit(False)), commands), mine & F.col("status").isin("queued", "running", "cancelled"), changes)


def submit(runs: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to add, and for each submission the run that answers it: (submission, run_id, created).

    A tenant's idempotency key names one run: the existing one, else that of the earliest submission in the batch.
    """
    key = ["tenant_id", "idempotency_key"]
    first = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key, F.when(F.col("idempotency_key").isNull(), F.col("run_id"))).orderBy("created_at", "run_id")))
    have = runs.where("idempotency_key IS NOT NULL").groupBy(*key).agg(F.min("run_id").alias("_have"))
    heads = first.where("_r = 1").join(have, key, "left")
    add = heads.where("_have IS NULL").drop("_r", "_have")
    named = heads.where("idempotency_key IS NOT NULL").select(*key, F.coalesce("_have", "run_id").alias("_run"))
    answer = new.join(named, key, "left").select(F.col("run_id").alias("submission"), F.coalesce("_run", "run_id").alias("run_id"))
    made = add.select("run_id", F.lit(True).alias("_new"))
    created = F.col("_new").isNotNull() & (F.col("submission") == F.col("run_id"))
    return add, answer.join(made, "run_id", "left").select("submission", "run_id", created.alias("created"))


# Reads


def active(runs: DataFrame) -> DataFrame:
    """Queued and running runs by tenant and kind."""
    return runs.where("status IN ('queued', 'running')").groupBy("tenant_id", "kind").agg(F.count("*").alias("active"))


def lookup(asked: DataFrame, runs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What a tenant is told of a run: asked(run_id, tenant_id). A foreign run is unknown; an erased one has its tombstone."""
    mine = runs.select("run_id", "tenant_id", F.col("status").alias("_status"))
    gone = tombstones.select("run_id", "tenant_id", F.lit("erased").alias("_gone"))
    rows = asked.join(mine, ["run_id", "tenant_id"], "left").join(gone, ["run_id", "tenant_id"], "left")
    return rows.select("run_id", "tenant_id", F.coalesce("_status", "_gone", F.lit("unknown")).alias("answer"))


def owners(runs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The tenant of every run there is or was."""
    return runs.select("run_id", "tenant_id").unionByName(tombstones.select("run_id", "tenant_id")).groupBy("run_id").agg(F.min("tenant_id").alias("tenant_id"))


def entombed(runs: DataFrame, removed: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """The runs left and the tombstones of those removed: run_id, tenant_id, status, erased_at."""
    gone = removed.select("run_id").distinct()
    stones = runs.join(gone, "run_id", "left_semi").select("run_id", "tenant_id", "status", F.lit(at).alias("erased_at"))
    return runs.join(gone, "run_id", "left_anti"), stones


def purged(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> DataFrame:
    """How many rows of each table a purge by `key` removes: table, removed."""
    out = None
    for name, df in tables.items():
        one = df.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed")
        out = one if out is None else out.unionByName(one)
    return out


#: What a run's public form leaves out, and how priorities are called.
PRIVATE = ("worker_id", "lease_until", "idempotency_key", "blob_id")
PRIORITIES = {0: "low", 1: "normal", 2: "high"}


def public(runs: DataFrame) -> DataFrame:
    """Runs as they are shown: without private columns, the priority by name, finished_at only of ended ones."""
    label = F.lit(None).cast("string")
    for value, name in PRIORITIES.items():
        label = F.when(F.col("priority") == value, name).otherwise(label)
    return runs.drop(*PRIVATE).withColumns({"priority": label, "finished_at": F.when(F.col("status").isin(*TERMINAL), F.col("updated_at"))})


def granted(requested: Column, ceiling: Column) -> Column:
    """The priority granted: what was asked for, up to the tenant's ceiling; nothing asked is the lowest."""
    return F.least(F.coalesce(requested, F.lit(0)), ceiling)


def admission(asked: DataFrame, queued: DataFrame, total: int, caps: DataFrame, default: int) -> DataFrame:
    """Recognition jobs by tenant: 503 where the whole queue is full, 429 where the tenant's share is, else 202.

    queued(tenant_id, active), caps(tenant_id, cap): a tenant without a cap has the default.
    """
    # One row, from an aggregate without groups; caps are a configuration file's rows.
    whole = queued.agg(F.coalesce(F.sum("active"), F.lit(0)).alias("_all"))
    rows = asked.join(queued, "tenant_id", "left").join(F.broadcast(caps), "tenant_id", "left").join(F.broadcast(whole))
    mine = F.coalesce("active", F.lit(0))
    code = F.when(F.col("_all") >= total, 503).when(mine >= F.coalesce("cap", F.lit(default)), 429).otherwise(202)
    return rows.select(*asked.columns, code.alias("code"))


#: The order in which limits are checked.
CHECKS = ("submissions", "runs", "tokens", "concurrency")


def first_refusal(usage: DataFrame, policy: DataFrame, default: dict[str, int | None]) -> DataFrame:
    """tenant_id, refused: the first limit in order that a tenant has reached; a limit without a number permits all.

    usage(tenant_id, and a count for each of CHECKS), policy the same with the tenants' own limits.
    """
    rows = usage.join(policy.select("tenant_id", *(F.col(c).alias(f"_{c}") for c in CHECKS)), "tenant_id", "left")
    refused = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(0)) >= F.coalesce(f"_{c}", F.lit(default[c]).cast("long")), c) for c in CHECKS))
    return rows.select("tenant_id", refused.alias("refused"))


def page_problem(status: Column, limit: Column, cursor_tenant: Column, tenant: Column) -> Column:
    """Why a listing is refused: a status outside the set, a limit outside 1 to 200, another tenant's cursor."""
    known = status.isNull() | status.isin("queued", "running", *TERMINAL)
    return F.when(~known, "status").when((limit < 1) | (limit > 200), "limit").when(cursor_tenant.isNotNull() & (cursor_tenant != tenant), "cursor")


def decoded(cursor: Column, tenant: Column) -> Column:
    """A cursor's time and id, or null where it is damaged or another tenant's."""
    padded = F.concat(F.translate(cursor, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(cursor), F.lit(4)).cast("int")))
    raw = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "tenant string, at string, id string")
    return F.when(raw["tenant"] == tenant, F.struct(raw["at"].alias("at"), raw["id"].alias("id")))


def transition_reason(to_state: Column, error: Column) -> Column:
    """Why a run changed: cancelled, the class of its error, or completed."""
    return F.when(to_state == "cancelled", "cancelled").otherwise(F.coalesce(error, F.lit("completed")))


def run_outcome(stages: DataFrame) -> DataFrame:
    """A run's outcome from its stages' (run_id, stage, status, error): failed with the first error, else succeeded."""
    failed = F.min(F.when(F.col("status") == "failed", F.struct("stage", "error")))
    rows = stages.groupBy("run_id").agg(failed.alias("_f"))
    return rows.select("run_id", F.when(F.col("_f").isNotNull(), "failed").otherwise("succeeded").alias("outcome"), F.col("_f.stage").alias("failed_stage"), F.col("_f.error").alias("error"))


def due(deliveries: DataFrame, at, limit: int) -> DataFrame:
    """Pending deliveries whose time has come, oldest first."""
    return deliveries.where((F.col("state") == "pending") & (F.col("next_attempt_at") <= F.lit(at))).orderBy("next_attempt_at", "delivery_id").limit(limit)


def payload(runs: DataFrame) -> Column:
    """What a delivery says of a run: id and status, and what else is there."""
    return F.to_json(F.struct(F.col("run_id").alias("id"), "status", "artifact_id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at")), {"ignoreNullFields": "true"})


# Corrections and evaluations


def for_promotion(corrections: DataFrame) -> DataFrame:
    """Corrections with their rank in the order in which they are promoted: path, time, annotator."""
    return corrections.withColumn("rank", F.row_number().over(Window.partitionBy("blob_id").orderBy("field_path", "at", "annotator")))


def answer_set(answers: DataFrame, paths: list[str]) -> DataFrame:
    """The newest answers of declared paths as labels: (document_id, field_path, expectation, value)."""
    rows = answers.where(F.col("field_path").isin(*paths))
    return rows.select(F.col("blob_id").alias("document_id"), "field_path", F.when(F.col("value").isNull(), "absent").otherwise("value").alias("expectation"), "value")


def predictions_of(runs: DataFrame, extractions: DataFrame) -> DataFrame:
    """What each run predicts: its artifact's values, or why there is none (the failed stage, or a missing artifact)."""
    rows = runs.join(extractions.select("artifact_id", "value"), "artifact_id", "left")
    reason = F.when(F.col("status") == "failed", F.coalesce("failed_stage", F.lit("parse"))).when(F.col("value").isNull(), "missing_artifact")
    return rows.select("run_id", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason"))


def startable(asked: DataFrame, unfinished: DataFrame) -> DataFrame:
    """Evaluations that may be created: one unfinished a tenant and schema; of several asked for at once the least id."""
    key = ["tenant_id", "schema_name"]
    first = asked.groupBy(*key).agg(F.min("evaluation_id").alias("evaluation_id"))
    return first.join(unfinished.select(*key).distinct(), key, "left_anti")


def forgotten(reports: DataFrame, document_id) -> DataFrame:
    """Reports without one document's outcomes (outcomes is an array of structs with document_id)."""
    return reports.withColumn("outcomes", F.filter("outcomes", lambda o: o["document_id"] != F.lit(document_id)))


def evaluation_detail(answers: DataFrame, extracted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Expected against extracted value and the outcome, by document and path."""
    key = ["document_id", "field_path"]
    rows = answers.select(*key, F.col("value").alias("expected")).join(extracted.select(*key, F.col("value").alias("extracted")), key, "left")
    return rows.join(outcomes.select(*key, "kind"), key, "left")


def job_status(asked: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Jobs by artifact id: unknown where malformed, unavailable where the store lacks it or it isn't a validation, else succeeded."""
    rows = asked.join(artifacts.where("stage = 'validate'").select("artifact_id", F.lit(True).alias("_has")), "artifact_id", "left")
    state = F.when(~F.col("artifact_id").rlike(r"\Asha256:[0-9a-f]{64}\z"), "unknown").when(F.col("_has"), "succeeded").otherwise("unavailable")
    return rows.select(*asked.columns, state.alias("job_status"))


def stored_result(validations: DataFrame, groundings: DataFrame, extractions: DataFrame) -> DataFrame:
    """A validation with the artifacts it came from: validation_id, grounding_id, extraction_id, complete."""
    v = validations.select(F.col("artifact_id").alias("validation_id"), F.col("input_artifact_id").alias("grounding_id"))
    g = groundings.select(F.col("artifact_id").alias("grounding_id"), F.col("input_artifact_id").alias("extraction_id"))
    rows = v.join(g, "grounding_id", "left").join(extractions.select(F.col("artifact_id").alias("extraction_id"), F.lit(True).alias("_e")), "extraction_id", "left")
    return rows.select("validation_id", "grounding_id", "extraction_id", F.coalesce("_e", F.lit(False)).alias("complete"))
