"""Content identity, artifacts and their lineage.

An id is the hash of the canonical JSON of what it stands for. artifacts(artifact_id, stage, input_artifact_id, payload,
content_id) is the store.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.text import canonical, content_id
from folio.operators.lineage import checkpoint


def document_id(blob_id: Column, parser: str | Column, version: str | Column, options_hash: str) -> Column:
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return content_id(canonical(v=F.lit("1"), blob_id=blob_id, parser_id=of(parser), parser_version=of(version), options_hash=F.lit(options_hash)))


def artifact_id(source: Column, processor: str, version: str, options_hash: str) -> Column:
    """The id of what a processor makes of its input."""
    return content_id(canonical(input=source, processor_id=F.lit(processor), processor_version=F.lit(version), options_hash=F.lit(options_hash)))


#: Hexadecimal digits of the ranges that a set is cut in, level by level: a range of the last holds 256 of the one before.
RANGES = (6, 4, 2, 0)


def set_id(rows: DataFrame, by: list[str], member: str) -> DataFrame:
    """The id of a set of ids, as a tree: by, set_id, members.

    Equal members are one with their number. The members of a range (by their hash's leading six digits) give a digest, as do the
    ranges' digests in order, 256 at most, up to the one of all. No task holds a set: a trillion members come to some sixty thousand a range,
    and a range above has 256 digests. A missing member counts but gives nothing to the hash; a set of nothing else has no id.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(member).cast("string").alias("_at"))
    level = rows.groupBy(*keys, "_at").agg(F.count("*").alias("_n"))
    level = level.select(*keys, F.sha2("_at", 256).alias("_range"), "_at", F.concat("_at", F.lit(":"), F.col("_n").cast("string")).alias("_item"), "_n")
    for digits in RANGES:
        inside = F.array_sort(F.collect_list(F.when(F.col("_item").isNotNull(), F.struct("_at", "_item"))))
        made = level.groupBy(*keys, F.substring("_range", 1, digits).alias("_range")).agg(inside.alias("_i"), F.sum("_n").alias("_n"))
        level = made.select(*keys, "_range", F.col("_range").alias("_at"), F.when(F.size("_i") > 0, F.sha2(F.array_join("_i._item", ","), 256)).alias("_item"), "_n")
    # Missing members have no range; they meet the others at the root.
    root = level.groupBy(*keys).agg(F.max("_item").alias("_item"), F.sum("_n").alias("members"))
    return root.select(*(F.col(k).alias(c) for c, k in zip(by, keys, strict=True)), F.concat(F.lit("sha256:"), F.col("_item")).alias("set_id"), "members")


def set_id_sql(name: str, rows: str, by: str, member: str) -> str:
    """The same tree in DuckDB's SQL: tables name_6, name_4, name_2 and name_0 (by, d the digest, n the members)."""
    out = f"{name}_m AS (SELECT {by}, {member} AS k, sha256({member}) AS r, {member} || ':' || count(*) AS item, count(*) AS n FROM {rows} GROUP BY {by}, {member})"
    below = f"{name}_m"
    for digits in RANGES:
        out += f", {name}_{digits} AS (SELECT {by}, r, r AS k, sha256(i) AS item, n FROM (SELECT {by}, r[1:{digits}] AS r, string_agg(item, ',' ORDER BY k) AS i, sum(n)::BIGINT AS n FROM {below} GROUP BY {by}, r[1:{digits}]))"
        below = f"{name}_{digits}"
    return f"{out}, {name} AS (SELECT {by}, 'sha256:' || max(item) AS set_id, sum(n)::BIGINT AS members FROM {below} GROUP BY {by})"


def planned(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Which planned artifacts are in the store already: artifact_id, reused."""
    mine = store.select("artifact_id").distinct().withColumn("_has", F.lit(True))
    return ids.join(mine, "artifact_id", "left").withColumn("reused", F.coalesce("_has", F.lit(False))).drop("_has")


def put(store: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to add (ids that the store lacks) and the conflicts (ids that it holds with other content)."""
    add = new.dropDuplicates(["artifact_id"]).join(store, "artifact_id", "left_anti")
    other = new.select("artifact_id", F.col("content_id").alias("_c")).join(store.select("artifact_id", "content_id"), "artifact_id")
    return add, other.where("_c <> content_id").select("artifact_id").distinct()


def damaged(store: DataFrame) -> DataFrame:
    """Artifacts whose payload isn't what its content id says."""
    return store.where(content_id(F.col("payload")) != F.col("content_id")).select("artifact_id")


def lineage(store: DataFrame, start: DataFrame) -> DataFrame:
    """Each start's chain of inputs: root_id, step (from 0), artifact_id, stage. A cycle ends where it closes."""
    edges = store.select("artifact_id", "stage", "input_artifact_id")
    now = start.select(F.col("artifact_id").alias("root_id"), "artifact_id", F.array().cast("array<string>").alias("_seen"))
    out = None
    for step in itertools.count():
        rows = now.join(edges, "artifact_id")
        mine = rows.select("root_id", F.lit(step).alias("step"), "artifact_id", "stage")
        out = mine if out is None else out.unionByName(mine)
        now = rows.where(F.col("input_artifact_id").isNotNull() & ~F.array_contains("_seen", F.col("input_artifact_id")) & (F.col("input_artifact_id") != F.col("artifact_id")))
        now = checkpoint(now.select("root_id", F.col("input_artifact_id").alias("artifact_id"), F.array_append("_seen", F.col("artifact_id")).alias("_seen")))
        if now.isEmpty():
            break
    return out


def stage_counts(outcomes: DataFrame) -> DataFrame:
    """How many steps were executed, reused, failed and skipped, and how long the executed ones took."""
    n = lambda s: F.count_if(F.col("status") == s)
    return outcomes.groupBy("stage").agg(n("executed").alias("executed"), n("reused").alias("reused"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.sum(F.when(F.col("status") == "executed", F.col("duration_ms")).otherwise(0)).alias("duration_ms"))


STAGES = ("parse", "extract", "ground", "validate")


def with_skipped(outcomes: DataFrame) -> DataFrame:
    """Every run's four stages: those after a failed one are skipped."""
    order = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage")).cast("int")
    failed = outcomes.where("status = 'failed'").groupBy("run_id").agg(F.min(order).alias("_at"))
    rest = failed.select("run_id", F.explode(F.slice(F.array(*(F.lit(s) for s in STAGES)), F.col("_at") + 1, F.lit(len(STAGES)))).alias("stage"))
    kept = outcomes.join(failed, "run_id", "left").where(F.col("_at").isNull() | (order <= F.col("_at"))).select("run_id", "stage", "status", "duration_ms")
    return kept.unionByName(rest.select("run_id", "stage", F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("duration_ms")))
