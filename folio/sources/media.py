"""Files as sources: bytes with their type, size, content id and why they are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T


def scan(spark: SparkSession, path: str, limit: int = T.MAX_BYTES) -> DataFrame:
    """path, media_type, size_bytes, blob_id, refusal, content of every file below a path; a declared type is never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("path", T.media_type(F.col("content")).alias("media_type"), F.col("length").alias("size_bytes"), T.content_id(F.col("content")).alias("blob_id"), "content")
    return rows.withColumn("refusal", T.refusal(F.col("media_type"), F.col("size_bytes"), limit))


def page_windows(files: DataFrame, pages: str, size: int) -> DataFrame:
    """Windows of `size` pages of each file: first_page and page_count, for hosts that take so many at once."""
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.col(pages) - 1, F.lit(0)), F.lit(size))).alias("first_page")
    return files.select("*", first).withColumn("page_count", F.least(F.lit(size), F.col(pages) - F.col("first_page")))
