"""Settings and recorded answers from JSON files: limits, routing policies, canned model responses, prediction sets.

The files are small and written by hand, but for prediction sets, which Spark reads in parallel, a file a document.
"""

from __future__ import annotations

import json
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.queue import CHECKS
from folio.operators.routing import Policy

LIMITS = "tenant_id string, " + ", ".join(f"{c} long" for c in CHECKS)


def limits(spark: SparkSession, path: str) -> DataFrame:
    """The default limits (a row without tenant_id) and the tenants' own, of a file {default: {...}, tenants: {name: {...}}}."""
    given = json.loads(Path(path).read_text())
    if set(given) - {"default", "tenants"}:
        raise ValueError("unknown keys in the limits")
    rows = []
    for tenant, own in [(None, given.get("default", {})), *given.get("tenants", {}).items()]:
        if set(own) - set(CHECKS):
            raise ValueError(f"unknown limits: {', '.join(sorted(set(own) - set(CHECKS)))}")
        rows.append((tenant, *(own.get(c) for c in CHECKS)))
    return spark.createDataFrame(rows, LIMITS)


def policy(path: str) -> Policy:
    """A routing policy; a key that it doesn't know is refused."""
    given = json.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(Policy)}
    if unknown:
        raise ValueError(f"unknown keys in the policy: {', '.join(sorted(unknown))}")
    return Policy(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def canned(spark: SparkSession, path: str) -> DataFrame:
    """Canned responses by schema: schema_identity, mode (ok, malformed, refusal, provider_error), payload."""
    given = json.loads(Path(path).read_text())
    rows = [(name, r.get("mode", "ok"), json.dumps(r.get("payload"))) for name, r in given.items()]
    return spark.createDataFrame(rows, "schema_identity string, mode string, payload string")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (with schema_identity) and what the canned model says: payload where it answers, else the failure."""
    rows = requests.join(F.broadcast(responses), "schema_identity", "left")
    text = F.when(F.col("mode") == "ok", F.col("payload")).when(F.col("mode") == "malformed", F.lit("{"))
    failure = F.when(F.col("mode").isNull(), "no_response").when(F.col("mode").isin("refusal", "provider_error"), F.col("mode"))
    return rows.withColumns({"payload": text, "failure": failure}).drop("mode")


PREDICTION = "document_id string, schema_identity string, schema_hash string, failed_stage string, values array<struct<field_path:string,value:string,type:string>>"


def prediction_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The predictions of a folder (one JSON each, recorder.json is none) and their values in long form; a document that has two is refused."""
    rows = spark.read.schema(PREDICTION).option("multiLine", True).json(folder).where(~F.col("_metadata.file_name").isin("recorder.json"))
    twice = rows.groupBy("document_id").count().where("count > 1").limit(1).collect()  # one row, for the message
    if twice:
        raise ValueError(f"two predictions for {twice[0]['document_id']}")
    return rows.drop("values"), rows.select("document_id", F.explode("values").alias("_v")).select("document_id", "_v.*")
