"""Queries on evaluation reports: documents as the labelled set, half of the sources restricted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators import reports as R
from folio.plans.evaluation import COUNTS, SCORED, outcomes
from folio.plans.tables import table

GOLD = """gold AS (SELECT doc_id AS document_id, CASE WHEN source <= 'src1' THEN 'restricted' ELSE 'public' END AS tier, n_chars % 4 + 1 AS declared, 'doc@1' AS schema_identity, 'h1' AS schema_hash FROM documents),
pred AS (
  SELECT doc_id AS document_id, n_chars % 3 AS exact, n_chars % 2 AS fuzzy, doc_id % 2 AS ungrounded, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 7 END AS passed, 'v' || doc_id % 3 AS parser_version,
    CASE WHEN doc_id % 23 = 0 THEN 'doc@2' ELSE 'doc@1' END AS schema_identity, CASE WHEN doc_id % 29 = 0 THEN 'h2' ELSE 'h1' END AS schema_hash, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'p' || doc_id % 4 END AS prompt_hash, lang AS model_id
  FROM documents)"""


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("source") <= "src1", "restricted").otherwise("public").alias("tier"), (F.col("n_chars") % 4 + 1).alias("declared"), F.lit("doc@1").alias("schema_identity"), F.lit("h1").alias("schema_hash")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, text = F.col("doc_id"), F.col("n_chars"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf_dir, "documents").select(
        k.alias("document_id"), (n % 3).alias("exact"), (n % 2).alias("fuzzy"), (k % 2).alias("ungrounded"), F.when(k % 5 != 0, n % 7).alias("passed"), text("v", k % 3).alias("parser_version"),
        F.when(k % 23 == 0, "doc@2").otherwise("doc@1").alias("schema_identity"), F.when(k % 29 == 0, "h2").otherwise("h1").alias("schema_hash"), F.when(k % 2 == 0, "").otherwise(text("p", k % 4)).alias("prompt_hash"), F.col("lang").alias("model_id"),
    )


METRICS = f"""{SCORED.format(m=7)}, {GOLD}, t AS (SELECT {COUNTS} FROM scored), g AS (SELECT sum(exact)::BIGINT AS exact, sum(fuzzy)::BIGINT AS fuzzy, sum(ungrounded)::BIGINT AS ungrounded FROM pred),
l AS (SELECT count(*) FILTER (WHERE n_chars % 5 < 3)::BIGINT AS agrees, count(*) FILTER (WHERE n_chars % 5 = 3)::BIGINT AS disagrees FROM documents),
r AS (SELECT *, correct_value + incorrect + missing + unevaluated_value AS v, correct_absence + spurious + unevaluated_absence AS a FROM t, g, l),
metric AS (
  SELECT 'field_accuracy' AS metric, correct_value + correct_absence AS numerator, v + a AS denominator FROM r UNION ALL SELECT 'coverage', correct_value + incorrect, v FROM r UNION ALL SELECT 'missing_rate', missing, v FROM r
  UNION ALL SELECT 'incorrect_rate', incorrect, v FROM r UNION ALL SELECT 'grounding_rate', exact + fuzzy, exact + fuzzy + ungrounded FROM r UNION ALL SELECT 'spurious_rate', spurious, a FROM r
  UNION ALL SELECT 'unevaluated_rate', unevaluated_value + unevaluated_absence, v + a FROM r UNION ALL SELECT 'mislocation_rate', disagrees, agrees + disagrees FROM r)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.when(F.col("n_chars") % 5 < 3, "agrees").when(F.col("n_chars") % 5 == 3, "disagrees").otherwise("not_assessable")
    return R.report_metrics(outcomes(spark, sf_dir), predictions(spark, sf_dir), table(spark, sf_dir, "documents").select(place.alias("agreement")))


@query("eight_metrics", f"WITH {METRICS} SELECT metric, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator, numerator::DOUBLE / nullif(denominator, 0) AS value FROM metric")
def eight_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


@query("stat_strip", f"WITH {METRICS} SELECT metric, CASE WHEN denominator = 0 THEN '-' ELSE (round(numerator * 1000 / denominator::DOUBLE)::BIGINT / 10)::DECIMAL(10,1)::VARCHAR || '%' END AS shown FROM metric")
def stat_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stat_strip(metrics(spark, sf_dir))


@query("recorded_totals", f"WITH {GOLD} SELECT sum(exact)::BIGINT AS exact, sum(fuzzy)::BIGINT AS fuzzy, sum(ungrounded)::BIGINT AS ungrounded, sum(passed)::BIGINT AS passed FROM pred")
def recorded_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What predictions recorded: grounding counts, 0 where none, and validation counts, null where none."""
    rows = predictions(spark, sf_dir)
    return R.grounding_totals(rows).join(F.broadcast(R.validation_totals(rows, ["passed"])))


@query("tier_sizes", f"WITH {GOLD} SELECT tier, count(*)::BIGINT AS documents, sum(declared)::BIGINT AS labels FROM gold GROUP BY tier")
def tier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tiers(gold(spark, sf_dir))


@query("partial_declaration", f"""
WITH {GOLD}, s AS (SELECT *, tier = 'public' AND document_id % 4 <> 0 AS inside FROM gold)
SELECT count(*) FILTER (WHERE NOT inside)::BIGINT AS skipped_documents, string_agg(DISTINCT tier, ',' ORDER BY tier) FILTER (WHERE NOT inside) AS skipped_tiers, sum(CASE WHEN inside THEN declared ELSE 0 END)::BIGINT AS covered_labels,
  sum(declared)::BIGINT AS declared_labels, sum(CASE WHEN inside THEN declared ELSE 0 END)::DOUBLE / sum(declared) AS covered_fraction FROM s
""")
def partial_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold(spark, sf_dir)
    return R.partial(rows, rows.where("tier = 'public' AND document_id % 4 <> 0"))


SEEN = """SELECT 'parser_version' AS field, string_agg(DISTINCT parser_version, ',' ORDER BY parser_version) AS seen FROM {0} UNION ALL SELECT 'schema_hash', string_agg(DISTINCT schema_hash, ',' ORDER BY schema_hash) FROM {0}
  UNION ALL SELECT 'prompt_hash', string_agg(DISTINCT prompt_hash, ',' ORDER BY prompt_hash) FROM {0} WHERE prompt_hash <> '' UNION ALL SELECT 'model_id', string_agg(DISTINCT model_id, ',' ORDER BY model_id) FROM {0}"""


@query("provenance_sets", f"WITH {GOLD} {SEEN.format('pred')}")
def provenance_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.provenance(predictions(spark, sf_dir))


@query("provenance_changes", f"""
WITH {GOLD}, later AS (SELECT * FROM pred WHERE parser_version <> 'v0' AND schema_hash = 'h1'), b AS ({SEEN.format('pred')}), a AS ({SEEN.format('later')})
SELECT field, b.seen AS before, a.seen AS after FROM b FULL JOIN a USING (field) WHERE b.seen IS DISTINCT FROM a.seen
""")
def provenance_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return R.provenance_changes(R.provenance(rows), R.provenance(rows.where("parser_version <> 'v0' AND schema_hash = 'h1'")))


@query("prediction_problems", f"""
WITH {GOLD}, p AS (SELECT * FROM pred UNION ALL SELECT * FROM pred WHERE document_id % 31 = 0), g AS (SELECT * FROM gold WHERE document_id % 17 <> 0),
c AS (SELECT document_id, count(*) AS n, min(schema_identity) AS i, min(schema_hash) AS h FROM p GROUP BY document_id)
SELECT * FROM (SELECT c.document_id, CASE WHEN n > 1 THEN 'repeated_prediction' WHEN g.document_id IS NULL THEN 'unknown_document' WHEN i <> schema_identity THEN 'schema_mismatch' WHEN h <> schema_hash THEN 'schema_hash_mismatch' END AS problem
FROM c LEFT JOIN g USING (document_id)) WHERE problem IS NOT NULL
""")
def prediction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    return R.prediction_problems(rows.unionByName(rows.where("document_id % 31 = 0")), gold(spark, sf_dir).where("document_id % 17 <> 0"))


@query("comparability", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'golden_set' WHEN doc_id % 3 = 0 THEN 'schemas' WHEN doc_id % 7 = 0 THEN 'metric_version' WHEN doc_id % 2 = 0 THEN 'partial_and_whole' END AS refusal FROM documents
""")
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why two reports may not be compared, the first reason only."""
    k = F.col("doc_id")
    facts = lambda n: F.struct(F.when(k % 5 == 0, n).otherwise("g").alias("golden_set_id"), F.when(k % 3 == 0, n).otherwise("s").alias("schemas"), F.when(k % 7 == 0, n).otherwise("1").alias("metric_version"), F.when(k % 2 == 0, n).otherwise("w").alias("partial"))
    return R.incomparable(table(spark, sf_dir, "documents").select("doc_id", facts("a").alias("before"), facts("b").alias("after"))).select("doc_id", "refusal")


PATHS = "path AS (SELECT l_orderkey AS document_id, 'items[' || l_linenumber % 12 || '].' || CASE WHEN l_partkey % 2 = 0 THEN 'price' ELSE 'tax' END AS field_path, l_linenumber % 12 AS i FROM lineitem)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("l_linenumber") % 12
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat(F.lit("items["), i.cast("string"), F.lit("]."), F.when(F.col("l_partkey") % 2 == 0, "price").otherwise("tax")).alias("field_path"), i.alias("i"))


@query("outcome_order", f"WITH {PATHS} SELECT document_id, field_path, row_number() OVER (PARTITION BY document_id ORDER BY i, field_path)::INT AS rank FROM (SELECT DISTINCT * FROM path)")
def outcome_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural order of paths: entry 2 before entry 10."""
    return R.in_order(paths(spark, sf_dir).select("document_id", "field_path").distinct())


@query("compared_paths", f"""
WITH {PATHS}
SELECT document_id, field_path, CASE WHEN i % 3 <> 0 THEN 'items[' || i + document_id % 2 || '].' || string_split(field_path, '.')[2] END AS compared_path FROM (SELECT DISTINCT * FROM path)
""")
def compared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that pair off with another index are compared there."""
    rows = paths(spark, sf_dir).distinct()
    pairs = rows.where("i % 3 <> 0").select("document_id", F.lit("items").alias("group_path"), F.col("i").cast("int").alias("expected_index"), (F.col("i") + F.col("document_id") % 2).cast("int").alias("predicted_index")).distinct()
    return R.compared_paths(rows.select("document_id", "field_path"), pairs)


@query("value_paths", "SELECT doc_id AS document_id, 'quality' AS field_path FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1")
def value_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    both = F.array(F.struct(F.lit("quality").alias("field_path"), F.lit("value").alias("expectation")), F.struct(F.lit("toxic").alias("field_path"), F.when(F.col("toxic") == 1, "value").otherwise("absent").alias("expectation")))
    return R.value_paths(rows.select(F.col("doc_id").alias("document_id"), F.explode(both).alias("_l")).select("document_id", "_l.*"))


@query("field_table", f"""
WITH {SCORED.format(m=7)}
SELECT field_path, count(*) FILTER (WHERE kind = 'correct')::BIGINT AS correct, count(*) FILTER (WHERE kind IN ('incorrect', 'spurious'))::BIGINT AS wrong, count(*) FILTER (WHERE kind = 'missing')::BIGINT AS missing,
  min(document_id) FILTER (WHERE kind <> 'correct') AS first_off, max(document_id) FILTER (WHERE kind <> 'correct') AS last_off FROM scored GROUP BY field_path
""")  # fmt: skip
def field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.field_table(outcomes(spark, sf_dir))
