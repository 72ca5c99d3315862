"""Cutting a plan's lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir for tables that later jobs read; without the setting a temporary one, on local masters alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{named or tempfile.mkdtemp(prefix='folio-')}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """`df` as one side of a join that deals both by their keys, for tables that grow with the input.

    Spark takes rows made by an explode for as large as what they were made from, and may send such a table whole through the driver.
    """
    return df.hint("merge")


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster executors could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint()
