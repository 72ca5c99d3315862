"""Queries on folders of labelled sets: a set for each customer with the customer's orders as its documents, many with an error.

An order's kind is o_orderkey % 211, a set's is o_custkey % 11.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators.lineage import checkpoint, dealt
from folio.plans.conforming import SCHEMA
from folio.plans.tables import table
from folio.sources import labelled as L
from folio.sources.schemas import walk


def facts(spark: SparkSession) -> DataFrame:
    """The declared fields that labels name."""
    fields = [("order@1", path, "group" if f.get("fields") else f["type"]) for path, f, _ in walk(SCHEMA["fields"])]
    return spark.createDataFrame(fields, "schema_identity string, path string, type string")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, label files and bundles as path and content."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind, doc, lit = k % 211, F.concat(F.lit("order:"), k.cast("string")), F.lit
    folder = F.concat(lit("sets/"), c.cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    tier = F.when(kind == 10, "secret").when(kind.isin(2, 16, 17), "restricted").otherwise("public")
    origin = F.concat(lit('{"kind":"'), F.when(kind.isin(11, 12), "synthetic").otherwise("licensed"), lit('","basis":"'), F.when(kind == 19, " ").otherwise("terms"), lit('"'), F.when(kind == 12, ',"generator_id":"g","generator_version":"1"').otherwise(""), lit("}"))
    entry = F.concat(
        lit('{"document_id":"'), doc, lit('","blob_sha256":"b'), k.cast("string"), lit('","tier":"'), tier, lit('","origin":'), origin, lit(',"schema_identity":"order@1","schema_hash":"h","path":'),
        F.when(kind.isin(1, 16, 17), "null").otherwise('"p"'), lit(',"declared_label_count":'), F.when(kind == 3, "5").otherwise("4"), F.when(kind == 20, ',"owner":1').otherwise(""), lit("}"),
    )
    entries = rows.select("o_custkey", F.explode(F.when(kind == 14, F.array().cast("array<string>")).when(kind == 15, F.array(entry, entry)).otherwise(F.array(entry))).alias("e"))
    keys = F.when(c % 11 == 0, '{"group_path":"marks","key_field":"rank"},{"group_path":"marks","key_field":"word"}').when(c % 11 == 1, '{"group_path":"marks","key_field":"colour"}').otherwise('{"group_path":"marks","key_field":"rank"}')
    manifests = entries.groupBy("o_custkey").agg(F.array_join(F.collect_list("e"), ",").alias("e")).select(F.concat(folder, lit("/manifest.json")).alias("path"), F.concat(lit('{"entry_keys":['), keys, lit('],"documents":['), "e", F.when(c % 11 == 2, "]").otherwise("]}")).alias("content"))
    label = lambda path, value: F.concat(lit(f'{{"field_path":"{path}","expectation":"value","value":'), value, lit("}"))
    total = F.concat(lit('"'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), lit('"'))
    first = label("total", F.when(kind == 6, "12.5").when(kind == 8, "null").otherwise(total))
    second = F.when(kind == 4, first).when(kind == 5, label("colour", lit('"red"'))).when(kind == 18, label("placed", lit('"2026-13-01"'))).otherwise(F.concat(lit('{"field_path":"placed","expectation":"absent"'), F.when(kind == 9, ',"value":"x"').otherwise(""), lit("}")))
    given = F.concat(lit("["), first, lit(","), second, lit(","), label("marks[0].rank", lit("1")), lit(","), label("marks[1].rank", F.when(kind == 7, "1").otherwise("2")), lit("]"))
    beside = rows.where(~kind.isin(2, 16, 17)).select(F.concat(folder, lit("/labels/order_"), k.cast("string"), lit(".json")).alias("path"), F.when(kind == 13, "{").otherwise(given).alias("content"))
    blob = F.concat(F.when(kind == 17, lit('"x')).otherwise(lit('"b')), k.cast("string"), lit('":'), given)
    bundles = rows.where(kind.isin(2, 16, 17)).groupBy("o_custkey").agg(F.array_join(F.collect_list(blob), ",").alias("e")).select(F.concat(folder, lit("/restricted.json")).alias("path"), F.concat(lit("{"), "e", lit("}")).alias("content"))
    return manifests.unionByName(beside).unionByName(bundles)


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files parsed once, as each check reads them."""
    return checkpoint(L.parsed(files(spark, sf_dir)))


REFUSED = """o AS (SELECT o_orderkey % 211 AS n, o_custkey % 11 AS m, 'sets/' || o_custkey AS set_path, o_orderkey::VARCHAR AS k, 'order:' || o_orderkey AS document_id FROM orders),
sets AS (SELECT DISTINCT set_path, m FROM o WHERE n <> 14), readable AS (SELECT * FROM o WHERE m <> 2 AND set_path IN (SELECT set_path FROM sets)),
refused AS (
  SELECT set_path, CASE WHEN n = 17 THEN NULL WHEN n = 14 THEN 'order_' || k ELSE document_id END AS document_id,
    CASE n WHEN 1 THEN 'path' WHEN 2 THEN 'path' WHEN 4 THEN 'total' WHEN 5 THEN 'colour' WHEN 6 THEN 'total' WHEN 10 THEN 'tier' WHEN 11 THEN 'origin' WHEN 17 THEN 'x' || k WHEN 18 THEN 'placed' WHEN 19 THEN 'origin.basis' WHEN 20 THEN 'owner' END AS at,
    CASE n WHEN 1 THEN 'public_without_path' WHEN 2 THEN 'restricted_with_path' WHEN 3 THEN 'label_count' WHEN 4 THEN 'repeated_label' WHEN 5 THEN 'unresolved_path' WHEN 6 THEN 'value_not_carried' WHEN 10 THEN 'unknown_word'
      WHEN 11 THEN 'no_generator' WHEN 14 THEN 'unknown_document' WHEN 15 THEN 'repeated_document' WHEN 17 THEN 'unknown_blob' WHEN 18 THEN 'value_not_carried' WHEN 19 THEN 'empty' WHEN 20 THEN 'unknown_key' END AS problem
    FROM readable WHERE n IN (1, 2, 3, 4, 5, 6, 10, 11, 14, 15, 17, 18, 19, 20)
  UNION ALL SELECT set_path, document_id, 'marks.rank', 'repeated_key_value' FROM readable WHERE n = 7 AND m <> 1
  UNION ALL SELECT set_path, 'order_' || k, CASE n WHEN 8 THEN 'total' WHEN 9 THEN 'placed' ELSE '' END, CASE n WHEN 8 THEN 'no_value' WHEN 9 THEN 'value_given' ELSE 'not_json' END FROM o WHERE n IN (8, 9, 13)
  UNION ALL SELECT set_path, NULL, CASE m WHEN 0 THEN 'marks' WHEN 2 THEN '' END, CASE m WHEN 0 THEN 'repeated_key' ELSE 'not_json' END FROM sets WHERE m IN (0, 2)
  UNION ALL SELECT DISTINCT set_path, NULL, 'marks.colour', 'key_not_scalar' FROM readable WHERE m = 1 AND n NOT IN (10, 11, 14, 19, 20))"""


@query("labelled_set_refusals", f"WITH {REFUSED} SELECT * FROM refused")
def labelled_set_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every authoring error of every set."""
    return L.refusals(parsed(spark, sf_dir), facts(spark))


@query("labelled_documents", f"""
WITH {REFUSED} SELECT set_path, document_id, CASE WHEN n IN (2, 16, 17) THEN 'restricted' ELSE 'public' END AS tier, 4::BIGINT AS declared, 4::BIGINT AS n_labels
FROM o WHERE set_path NOT IN (SELECT set_path FROM refused)""")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the sets without an error, with how many labels each declares and has."""
    good = L.accepted(parsed(spark, sf_dir), facts(spark))
    given = L.labels(good).groupBy("set_path", "document_id").agg(F.count("*").alias("n_labels"))
    return L.documents(good).select("set_path", "document_id", "tier", "declared").join(dealt(given), ["set_path", "document_id"])
