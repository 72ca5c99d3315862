"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code units that separate words: space and the five ASCII controls 09-0D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Stands for a missing doc_id wherever rows need a total order; sorts before all others.
NO_ID = -(2**63)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. Only a local session without that setting gets a
    temporary folder; on a cluster executors could not read it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return df.checkpoint(eager=True)


def text_of(docs: DataFrame) -> Column:
    """The text as a string; a missing text counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a total order over rows: _id (doc_id, missing ones first) and _th (a hash of the text).

    Rows that agree in both are the same document twice; operators treat them alike.
    """
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        text.alias("text"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_th"),
    )


def real_id(key: str) -> Column:
    """The doc_id behind a key _id."""
    return F.when(F.col(key) != NO_ID, F.col(key)).alias("doc_id")


def mark(docs: DataFrame) -> DataFrame:
    """The whole rows of `docs` as _row, whatever their columns are called, with the keys _id and _th."""
    keys = F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_of(docs)).alias("_th")
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"), *keys)


def dealt(df: DataFrame) -> DataFrame:
    """`df` as one side of a join that deals both by their keys, for tables that grow with the input.

    Spark takes rows made by an explode for as large as what they were made from, and a checkpoint keeps that; left to itself it
    may send such a table whole through the driver.
    """
    return df.hint("merge")


def each_batch(docs: DataFrame, step, schema: str) -> DataFrame:
    """Apply `step`, a function of one pandas frame, to the batches of `docs` within its partitions."""

    def run(batches):
        for batch in batches:
            yield step(batch)

    return docs.mapInPandas(run, schema)


def least_hashed(df: DataFrame, n: int, seed: int, *columns: Column | str) -> DataFrame:
    """The rows of least keyed hash, n of them (more only where hashes are equal): only hashes are ordered, not the rows."""
    rows = df.withColumn("_lh", F.xxhash64(F.lit(seed), *columns))
    most = rows.select("_lh").orderBy("_lh").limit(n).agg(F.max("_lh")).first()[0]
    return rows.where(F.lit(False) if most is None else F.col("_lh") <= most).drop("_lh")


def same(before: DataFrame, after: DataFrame) -> bool:
    """Whether two frames of two long columns hold the same rows, by their count and the sum of a hash."""

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()

    return sign(before) == sign(after)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (u, v): a row (node, root) for each node, root its least node.

    Alternating large-star and small-star steps, each a partial minimum and an equality join, with a checkpoint a round:
    the number of rounds grows with the logarithm of the longest path, and a node of high degree is never gathered.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(dealt(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(least), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        if same(now, after):
            break
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
