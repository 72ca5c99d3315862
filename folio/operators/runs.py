"""The run queue's reads and batch decisions.

runs(run_id, tenant_id, kind, status, attempts, priority, created_at, updated_at, started_at, lease_until, expires_at, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")
TERMINAL = ("succeeded", "failed", "cancelled")
DAY = 86_400


def page(runs: DataFrame, limit: int, before: tuple | None = None, **equal) -> DataFrame:
    """A page of runs, newest first; `before` is the (created_at, run_id) of the last row of the page before."""
    for column, value in equal.items():
        if value is not None:
            runs = runs.where(F.col(column) == value)
    if before is not None:
        at, run_id = F.lit(before[0]), F.lit(before[1])
        runs = runs.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("run_id") < run_id)))
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def status_counts(runs: DataFrame, since) -> DataFrame:
    """Runs by kind and status: active ones always, ended ones since a time."""
    return runs.where(F.col("status").isin(*ACTIVE) | (F.col("updated_at") >= F.lit(since))).groupBy("kind", "status").agg(F.count("*").alias("runs"))


def latest(runs: DataFrame, status: str, limit: int) -> DataFrame:
    return runs.where(F.col("status") == status).orderBy(F.desc("updated_at"), F.desc("run_id")).limit(limit)


def longest_running(runs: DataFrame, limit: int) -> DataFrame:
    return runs.where("status = 'running'").orderBy(F.asc_nulls_last("started_at"), "run_id").limit(limit)


def eligible(runs: DataFrame, now, max_attempts: int) -> DataFrame:
    """Runs that a worker may claim: queued or with an expired lease, and attempts left."""
    waiting = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < F.lit(now)))
    return runs.where(waiting & (F.col("attempts") < max_attempts))


def abandoned(runs: DataFrame, now, max_attempts: int) -> DataFrame:
    """Runs out of attempts that no worker holds: they fail."""
    waiting = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") < F.lit(now)))
    return runs.where(waiting & (F.col("attempts") >= max_attempts)).withColumns({"status": F.lit("failed"), "updated_at": F.lit(now)})


def claim_order(runs: DataFrame, now, starvation_s: int, window_s: int, max_attempts: int, limit: int) -> DataFrame:
    """The next runs to claim: starved ones first, then tenants served least of late, then by priority and age."""
    at = F.lit(now)
    served = runs.where((F.col("status") != "queued") & (F.col("updated_at") >= at - F.expr(f"INTERVAL {window_s} SECONDS"))).groupBy("tenant_id").agg(F.count("*").alias("recent"))
    rows = eligible(runs, now, max_attempts).join(served, "tenant_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    rows = rows.withColumn("starved", F.col("created_at") < at - F.expr(f"INTERVAL {starvation_s} SECONDS"))
    return rows.orderBy(F.desc("starved"), "recent", F.desc("priority"), "created_at", "run_id").limit(limit)


def newest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def answer_summary(answers: DataFrame) -> DataFrame:
    """How many documents and answers each schema has."""
    return answers.groupBy("schema_name").agg(F.count_distinct("blob_id").alias("documents"), F.count("*").alias("answers"))


def windows(events: DataFrame, seconds: int, key: list[str], at: str = "ts") -> DataFrame:
    """Counts in fixed windows aligned to the epoch: key, window_start, value. Works on streams too."""
    w = F.window(F.col(at), f"{seconds} seconds")
    return events.groupBy(*key, w).agg(F.count("*").alias("value")).select(*key, F.col("window.start").alias("window_start"), "value")


def refusals(counters: DataFrame, limits: DataFrame, now, seconds: int) -> DataFrame:
    """Tenants at or over their limit in the current window, and in how many seconds to try again.

    limits(tenant_id, permitted): a row without tenant_id is the default.
    """
    at = F.lit(now)
    default = limits.where("tenant_id IS NULL").agg(F.max("permitted").alias("_default"))
    mine = counters.where((F.col("window_start") <= at) & (at < F.col("window_start") + F.expr(f"INTERVAL {seconds} SECONDS")))
    # One row, from an aggregate without groups.
    rows = mine.join(limits.where("tenant_id IS NOT NULL"), "tenant_id", "left").join(F.broadcast(default))
    left = F.unix_seconds(F.col("window_start").cast("timestamp")) + seconds - F.unix_seconds(at.cast("timestamp"))
    rows = rows.withColumn("permitted", F.coalesce("permitted", "_default")).where("value >= permitted")
    return rows.select("tenant_id", "value", "permitted", (left + 1).cast("long").alias("retry_after_s"))


def unreferenced(removed: DataFrame, kept: DataFrame, artifact: str = "artifact_id") -> DataFrame:
    """Artifacts that only removed runs name."""
    return removed.select(artifact).distinct().join(kept.select(artifact), artifact, "left_anti")


def sweep(runs: DataFrame, corrections: DataFrame, now, limit: int | None = None, after: tuple | None = None) -> DataFrame:
    """Ended runs past their time without those that an unexpired correction pins: all, or the `limit` oldest behind `after` (expires_at, run_id)."""
    pinned = corrections.where(F.col("expires_at") > F.lit(now)).select("run_id").distinct()
    due = runs.where(F.col("status").isin(*TERMINAL) & (F.col("expires_at") <= F.lit(now))).join(pinned, "run_id", "left_anti")
    if after is not None:
        at, run_id = (F.lit(x) for x in after)
        due = due.where((F.col("expires_at") > at) | ((F.col("expires_at") == at) & (F.col("run_id") > run_id)))
    return due if limit is None else due.orderBy("expires_at", "run_id").limit(limit)


def sweeps(runs: DataFrame, corrections: DataFrame, now, limit: int):
    """Batches of `limit` runs to remove, oldest first, until none is due; only each batch's last key comes to the driver."""
    after = None
    while True:
        batch = sweep(runs, corrections, now, limit, after)
        last = batch.agg(F.max(F.struct("expires_at", "run_id")).alias("_l")).first()[0]
        if last is None:
            return
        yield batch
        after = tuple(last)


def retry_delay(attempts: Column, base: Column | int) -> Column:
    """Seconds until a failed delivery is tried again: doubled each time, a day at most."""
    base = F.lit(base) if isinstance(base, int) else base
    return F.least(base * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(DAY))).cast("long")


def attempted(deliveries: DataFrame, now, base: int, most: int = 6) -> DataFrame:
    """The state of deliveries after an attempt (deliveries.code is the answer): delivered, pending with its next time, or failed."""
    ok = F.col("code").between(200, 299)
    n = F.col("attempts") + 1
    state = F.when(ok, "delivered").when(n >= most, "failed").otherwise("pending")
    later = F.when(~ok & (n < most), F.unix_seconds(F.lit(now).cast("timestamp")) + retry_delay(n, base))
    return deliveries.withColumns({"attempts": n, "state": state, "next_attempt_s": later})


def cursor(tenant: Column, at: Column, run_id: Column) -> Column:
    """A page's cursor: base64url of its JSON, bound to a tenant."""
    return F.rtrim(F.translate(F.base64(F.to_json(F.struct(tenant.alias("tenant"), at.cast("string").alias("at"), run_id.cast("string").alias("id")))), "+/=\r\n", "-_"))


def settled(evaluation_runs: DataFrame) -> DataFrame:
    """Evaluations all of whose runs have ended."""
    return evaluation_runs.groupBy("evaluation_id").agg(F.bool_and(F.coalesce(F.col("status").isin(*TERMINAL), F.lit(True))).alias("settled"), F.count("*").alias("runs"))


def pruned(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """Every table without a tenant's rows."""
    return {name: df.where(~F.col("tenant_id").eqNullSafe(tenant)) for name, df in tables.items()}
