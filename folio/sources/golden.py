"""Labelled documents and predictions from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "documents array<struct<document_id:string,blob_sha256:string,tier:string,schema_identity:string,declared_label_count:int>>"
LABELS = "document_id string, labels array<struct<field_path:string,expectation:string,value:string,type:string>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a manifest."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.select(F.explode("documents").alias("_d")).select("_d.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """The labels of a folder of files, one document each."""
    rows = spark.read.schema(LABELS).option("multiLine", True).json(path)
    return rows.select("document_id", F.explode("labels").alias("_l")).select("document_id", "_l.*")


def problems(documents: DataFrame, given: DataFrame) -> DataFrame:
    """What is wrong with a labelled set: (document_id, problem)."""
    twice = documents.groupBy("document_id").count().where("count > 1").select("document_id", F.lit("repeated_document").alias("problem"))
    unknown = given.join(documents.select("document_id"), "document_id", "left_anti").select("document_id", F.lit("unknown_document").alias("problem")).distinct()
    again = given.groupBy("document_id", "field_path").count().where("count > 1").select("document_id", F.lit("repeated_label").alias("problem")).distinct()
    counts = documents.join(given.groupBy("document_id").agg(F.count("*").alias("_n")), "document_id", "left")
    short = counts.where(F.col("declared_label_count") != F.coalesce("_n", F.lit(0))).select("document_id", F.lit("label_count").alias("problem"))
    return twice.unionByName(unknown).unionByName(again).unionByName(short)


def restricted(documents: DataFrame, bundle: DataFrame) -> DataFrame:
    """Labels of restricted documents from a bundle that names them by content: (document_id, field_path, expectation, value, type)."""
    return documents.where("tier = 'restricted'").select("document_id", "blob_sha256").join(bundle, "blob_sha256").drop("blob_sha256")


def write_predictions(rows: DataFrame, path: str) -> None:
    """One folder of JSON for each document."""
    rows.write.partitionBy("document_id").mode("errorifexists").json(path)
