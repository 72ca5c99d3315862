"""Composite reads: what the console shows of runs, schemas, evaluations and values, and checks of what people answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.runs import TERMINAL, latest, longest_running, status_counts


def overview(runs: DataFrame, since, limit: int) -> DataFrame:
    """One table of the console's overview: section, label, run_id, n: counts by kind and status, newest failures, longest running."""
    none = F.lit(None).cast("long")
    counts = status_counts(runs, since).select(F.lit("counts").alias("section"), F.concat_ws("/", "kind", "status").alias("label"), none.alias("run_id"), F.col("runs").alias("n"))
    listed = lambda df, name: df.select(F.lit(name).alias("section"), F.col("tenant_id").alias("label"), F.col("run_id").cast("long").alias("run_id"), none.alias("n"))
    return counts.unionByName(listed(latest(runs, "failed", limit), "failures")).unionByName(listed(longest_running(runs, limit), "longest"))


def cards(runs: DataFrame) -> DataFrame:
    """The overview's cards: waiting, working, done and broken runs, by kind."""
    card = F.when(F.col("status") == "queued", "waiting").when(F.col("status") == "running", "working").when(F.col("status") == "succeeded", "done").otherwise("broken")
    return runs.groupBy(card.alias("card")).pivot("kind", ["extract", "ocr"]).count().na.fill(0)


def next_page(page: DataFrame, limit: int) -> DataFrame:
    """The last row of a page if the page is full: where the next one begins."""
    by = Window.orderBy("created_at", "run_id")
    # At most `limit` rows, as page() gives them.
    rows = page.withColumn("_n", F.count("*").over(Window.partitionBy())).withColumn("_r", F.row_number().over(by))
    return rows.where((F.col("_n") == limit) & (F.col("_r") == 1)).select("created_at", "run_id")


def schema_listing(fields: DataFrame, registry: DataFrame) -> DataFrame:
    """Schemas with their number of fields, required ones and source: registry(schema_identity, source, shadowed)."""
    sums = fields.groupBy("schema_identity").agg(F.count("*").alias("fields"), F.count_if("required").alias("required"))
    return registry.select("schema_identity", "source", "shadowed").join(sums, "schema_identity", "left")


def field_at(fields: DataFrame, asked: DataFrame) -> DataFrame:
    """Fields by dotted path: asked(schema_identity, path) with type, cardinality and group_path, null where there is none."""
    return asked.join(fields.select("schema_identity", "path", "type", "cardinality", "group_path"), ["schema_identity", "path"], "left")


def default_location(outcomes: DataFrame) -> DataFrame:
    """The first box of a value's grounding, where a person's check begins: (document_id, field_path, box)."""
    return outcomes.select("document_id", "field_path", F.try_element_at("boxes", F.lit(1)).alias("box"))


def check_problem(exists: Column, declared: Column, status: Column, typed_value: Column, given: Column) -> Column:
    """Why a person's check of a value is refused: no run, an undeclared field, a run that did not succeed, a value not of the field's type."""
    return F.when(~exists, "unknown_run").when(~declared, "unknown_field").when(status != "succeeded", "not_succeeded").when(given.isNotNull() & typed_value.isNull(), "value_type")


def corrections_for(corrections: DataFrame, run_id) -> DataFrame:
    return corrections.where(F.col("run_id") == F.lit(run_id)).orderBy("at")


def erased(runs: DataFrame, corrections: DataFrame, tenant: str, blob_id=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Erasing a tenant, or one of its documents, in any state: the runs left, the corrections left, and the artifacts that no run names any more."""
    mine = F.col("tenant_id").eqNullSafe(tenant) & (F.lit(True) if blob_id is None else F.col("blob_id").eqNullSafe(F.lit(blob_id)))
    gone, left = runs.where(mine), runs.where(~mine)
    artifacts = gone.select("artifact_id").distinct().join(left.select("artifact_id"), "artifact_id", "left_anti")
    return left, corrections.join(gone.select("run_id"), "run_id", "left_anti"), artifacts


def evaluation_summary(evaluations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Evaluations, newest first by rank within tenant, with their status and field accuracy."""
    by = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.desc("evaluation_id"))
    rows = evaluations.join(metrics.where("metric = 'field_accuracy'").select("evaluation_id", F.col("value").alias("field_accuracy")), "evaluation_id", "left")
    return rows.withColumn("rank", F.row_number().over(by))


def transitions(runs: DataFrame) -> DataFrame:
    """One event a state that a run has been in: run_id, to_state, at, in order. A run's times say which."""
    event = lambda state, at: F.when(at.isNotNull(), F.struct(F.lit(state).alias("to_state") if isinstance(state, str) else state.alias("to_state"), at.alias("at")))
    ended = F.when(F.col("status").isin(*TERMINAL), F.col("updated_at"))
    events = F.array_compact(F.array(event("queued", F.col("created_at")), event("running", F.col("started_at")), event(F.col("status"), ended)))
    return runs.select("run_id", F.posexplode(events).alias("step", "_e")).select("run_id", "step", "_e.*")


def offsets_sound(parts: DataFrame) -> DataFrame:
    """Whether views' offset maps are sound: parts in order and apart in both texts. parts is an array of structs as the fold gives it."""
    p = F.col("parts")
    after = lambda i: p[i]["view"] + p[i]["view_size"]
    follows = lambda i: (after(i - 1) <= p[i]["view"]) & (p[i - 1]["source"] + p[i - 1]["source_size"] <= p[i]["source"])
    steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
    return parts.select("document_id", F.forall(steps, follows).alias("sound"))
