"""Queries on whole evaluation reports: from labels and predictions to every score, and from two reports to what moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators import scorecards as S
from folio.plans.evaluation import COUNTS, SCORED, sides
from folio.plans.tables import table


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What processing recorded of each document that it took."""
    k, n, text = F.col("doc_id"), F.col("n_chars"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, sf_dir, "documents").where("doc_id % 19 <> 0").select(
        k.alias("document_id"), (k % 17 == 0).alias("failed"), F.when(k % 17 != 0, n % 3).alias("exact"), F.when(k % 17 != 0, n % 2).alias("fuzzy"), F.when(k % 17 != 0, k % 2).alias("ungrounded"),
        F.when(k % 17 != 0, F.when(n % 4 == 0, "invalid").when(n % 4 == 1, "incomplete").otherwise("valid")).alias("verdict"), F.lit("doc@1").alias("schema_identity"), F.lit("h1").alias("schema_hash"),
        text("v", k % 3).alias("parser_version"), F.when(k % 2 == 0, "").otherwise(text("p", k % 4)).alias("prompt_hash"), F.col("lang").alias("model_id"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("source") <= "src1", "restricted").otherwise("public")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), tier.alias("tier"), (F.col("n_chars") % 4 + 1).alias("declared"), F.lit("doc@1").alias("schema_identity"), F.lit("h1").alias("schema_hash"))


def made(spark: SparkSession, sf_dir: str, m: int, include_restricted: bool) -> DataFrame:
    labels, predictions, _ = sides(spark, sf_dir, m)
    return S.report(gold(spark, sf_dir), labels, predictions, states(spark, sf_dir), "g1", include_restricted)


def report_sql(m: int, inside: str, p: str = "") -> str:
    """The report's rows as table {p}report."""
    metrics = {
        "field_accuracy": ("correct_value + correct_absence", "v + a"), "coverage": ("correct_value + incorrect", "v"), "missing_rate": ("missing", "v"), "incorrect_rate": ("incorrect", "v"),
        "grounding_rate": ("exact + fuzzy", "exact + fuzzy + ungrounded"), "spurious_rate": ("spurious", "a"), "unevaluated_rate": ("unevaluated_value + unevaluated_absence", "v + a"), "mislocation_rate": ("0", "0"),
    }
    scored = SCORED.format(m=m)
    for name in ("label", "prediction", "state", "scored"):
        scored = scored.replace(f"{name} AS (", f"{p}{name} AS (").replace(f"FROM {name} ", f"FROM {p}{name} ").replace(f"JOIN {name} ", f"JOIN {p}{name} ")
    each = " UNION ALL ".join(f"SELECT section, key, '{n}' AS name, ({a})::BIGINT AS numerator, ({b})::BIGINT AS denominator FROM {p}r" for n, (a, b) in metrics.items())
    counts = " UNION ALL ".join(f"SELECT 'count', NULL, '{n}', {n}, NULL, NULL, NULL FROM {p}per WHERE section = 'micro'" for n in S.TALLIES)
    seen = " UNION ALL ".join(f"SELECT 'provenance', NULL, '{n}', NULL, NULL, NULL, string_agg(DISTINCT {n}, ',' ORDER BY {n}) FILTER (WHERE {n} <> '') FROM {p}d WHERE inside HAVING count(*) FILTER (WHERE {n} <> '') > 0" for n in S.PROVENANCE)
    return f"""{scored},
{p}d AS (
  SELECT doc_id AS document_id, CASE WHEN source <= 'src1' THEN 'restricted' ELSE 'public' END AS tier, n_chars % 4 + 1 AS declared, {inside} AS inside, doc_id % 19 <> 0 AS had, had AND doc_id % 17 <> 0 AS good, CASE WHEN good THEN n_chars % 3 END AS exact,
    CASE WHEN good THEN n_chars % 2 END AS fuzzy, CASE WHEN good THEN doc_id % 2 END AS ungrounded, CASE WHEN good THEN CASE n_chars % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'incomplete' ELSE 'valid' END END AS verdict,
    CASE WHEN had THEN 'v' || doc_id % 3 END AS parser_version, CASE WHEN had THEN 'h1' END AS schema_hash, CASE WHEN had AND doc_id % 2 = 1 THEN 'p' || doc_id % 4 END AS prompt_hash, CASE WHEN had THEN lang END AS model_id FROM documents),
{p}o AS (SELECT s.* FROM {p}scored s JOIN {p}d USING (document_id) WHERE inside),
{p}per AS (
  SELECT 'micro' AS section, NULL::VARCHAR AS key, {COUNTS} FROM {p}o UNION ALL SELECT 'path', field_path, {COUNTS} FROM {p}o GROUP BY field_path
  UNION ALL SELECT 'document', document_id::VARCHAR, {COUNTS} FROM {p}d LEFT JOIN {p}o USING (document_id) WHERE inside GROUP BY document_id),
{p}g AS (SELECT 'micro' AS section, NULL::VARCHAR AS key, sum(exact) AS exact, sum(fuzzy) AS fuzzy, sum(ungrounded) AS ungrounded FROM {p}d WHERE inside UNION ALL SELECT 'document', document_id::VARCHAR, exact, fuzzy, ungrounded FROM {p}d WHERE inside),
{p}r AS (
  SELECT e.*, correct_value + incorrect + missing + unevaluated_value AS v, correct_absence + spurious + unevaluated_absence AS a, coalesce(exact, 0) AS exact, coalesce(fuzzy, 0) AS fuzzy, coalesce(ungrounded, 0) AS ungrounded
  FROM {p}per e LEFT JOIN {p}g g ON e.section = g.section AND e.key IS NOT DISTINCT FROM g.key),
{p}m AS (SELECT *, numerator::DOUBLE / nullif(denominator, 0) AS value, NULL::VARCHAR AS said FROM ({each})),
{p}s AS (SELECT count(*) FILTER (WHERE inside) AS i, count(*) AS n, coalesce(sum(declared) FILTER (WHERE inside), 0) AS li, sum(declared) AS ln, string_agg(DISTINCT tier, ',' ORDER BY tier) FILTER (WHERE NOT inside) AS t FROM {p}d),
{p}report AS (
  SELECT section, key, name, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator, value::DOUBLE AS value, said FROM (
  SELECT * FROM {p}m UNION ALL SELECT 'macro', NULL, name, count(value), count(*), sum(value::DECIMAL(20,18))::DOUBLE / nullif(count(value), 0), NULL FROM {p}m WHERE section = 'document' GROUP BY name UNION ALL {counts}
  UNION ALL SELECT 'tier', tier, 'documents', count(*) FILTER (WHERE inside), count(*), NULL, NULL FROM {p}d GROUP BY tier UNION ALL SELECT 'tier', tier, 'labels', coalesce(sum(declared) FILTER (WHERE inside), 0), sum(declared), NULL, NULL FROM {p}d GROUP BY tier
  UNION ALL SELECT 'verdict', verdict, 'documents', count(*), NULL, NULL, NULL FROM {p}d WHERE inside AND verdict IS NOT NULL GROUP BY verdict
  UNION ALL SELECT 'partial', NULL, 'documents', i, n, i::DOUBLE / n, NULL FROM {p}s WHERE i < n UNION ALL SELECT 'partial', NULL, 'labels', li, ln, li::DOUBLE / ln, NULL FROM {p}s WHERE i < n UNION ALL SELECT 'partial', NULL, 'tiers', NULL, NULL, NULL, t FROM {p}s WHERE i < n
  UNION ALL {seen} UNION ALL SELECT 'fact', NULL, unnest(['golden_set_id', 'metric_version', 'partial', 'schema_hash', 'schema_identity']), NULL, NULL, NULL, unnest(['g1', '{S.METRIC_VERSION}', CASE WHEN i < n THEN 'true' ELSE 'false' END, 'h1', 'doc@1']) FROM {p}s))"""


PUBLIC = "NOT source <= 'src1'"


@query("whole_report", f"WITH {report_sql(7, PUBLIC)} SELECT * FROM report")
def whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the public tier: each document, each path, the whole, and what is left out."""
    return made(spark, sf_dir, 7, False)


@query("report_changes", f"""
WITH {report_sql(7, 'true', 'b_')}, {report_sql(6, 'true', 'c_')}
SELECT b.section, b.key, b.name, b.value AS before, c.value AS after, c.value - b.value AS delta,
  CASE WHEN b.value IS NULL AND c.value IS NULL THEN 'unchanged' WHEN b.value IS NULL THEN 'became_defined' WHEN c.value IS NULL THEN 'became_undefined' WHEN b.value = c.value THEN 'unchanged'
    WHEN (c.value > b.value) = (b.name IN ('field_accuracy', 'coverage', 'grounding_rate')) THEN 'improved' ELSE 'regressed' END AS judgement, b.said AS said_before, c.said AS said_after
FROM b_report b JOIN c_report c ON b.section = c.section AND b.name = c.name AND b.key IS NOT DISTINCT FROM c.key WHERE b.section IN ('micro', 'document', 'path') OR (b.section = 'macro' AND b.name <> '')
""")
def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of every level before and after the predictor changed."""
    return S.changes(made(spark, sf_dir, 7, True), made(spark, sf_dir, 6, True))


@query("report_reconciles", f"WITH {report_sql(7, PUBLIC)} SELECT name, numerator, denominator, true AS reconciled FROM report WHERE section = 'micro' AND name NOT IN ('grounding_rate', 'mislocation_rate')")
def report_reconciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and paths add up to the whole in every metric that both know."""
    return S.reconciles(made(spark, sf_dir, 7, False))
