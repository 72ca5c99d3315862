"""Routing: does a validated result go to a person?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    version: str
    required_fields: tuple[str, ...] = ()
    review_verdicts: tuple[str, ...] = ("invalid", "incomplete")
    review_on_error_finding: bool = True
    review_when_required_ungrounded: bool = True
    review_when_required_fuzzy_below: float | None = None


def decide(verdicts: DataFrame, findings: DataFrame, outcomes: DataFrame, policy: Policy) -> DataFrame:
    """document_id, outcome (review if there is any reason, else automatic), policy_version, reasons (field:signal:observed, sorted).

    The verdict, each error, and each required field that is absent, ungrounded or too loosely matched give a reason; how
    sure a model was is not read.
    """
    reason = lambda field, signal, seen: F.concat_ws(":", field, F.lit(signal), seen).alias("_r")
    found = verdicts.where(F.col("verdict").isin(*policy.review_verdicts)).select("document_id", reason(F.lit(""), "validation", F.col("verdict")))
    if policy.review_on_error_finding:
        found = found.unionByName(findings.where("outcome = 'failed' AND severity = 'error'").select("document_id", reason(F.col("field_path"), "validation", F.lit("error"))))
    if policy.required_fields:
        wanted = verdicts.select("document_id", F.explode(F.array(*(F.lit(f) for f in policy.required_fields))).alias("field_path"))
        rows = wanted.join(outcomes, ["document_id", "field_path"], "left")
        seen = F.lit(None).cast("string")
        if policy.review_when_required_fuzzy_below is not None:
            seen = F.when((F.col("status") == "fuzzy") & (F.coalesce("score", F.lit(0.0)) < policy.review_when_required_fuzzy_below), "fuzzy")
        if policy.review_when_required_ungrounded:
            seen = F.when(F.col("status").isNull(), "absent").when(F.col("status") == "ungrounded", "ungrounded").otherwise(seen)
        found = found.unionByName(rows.withColumn("_s", seen).where("_s IS NOT NULL").select("document_id", reason(F.col("field_path"), "grounding", F.col("_s"))))
    all_ = found.groupBy("document_id").agg(F.array_sort(F.collect_list("_r")).alias("reasons"))
    out = verdicts.select("document_id").join(all_, "document_id", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    return out.select("document_id", F.when(F.size("reasons") > 0, "review").otherwise("automatic").alias("outcome"), F.lit(policy.version).alias("policy_version"), "reasons")
