"""Queries on constraints, rules, verdicts and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions import pattern
from folio.operators import routing as R
from folio.operators import validation as V
from folio.plans.tables import table

MONEY = "decimal(18,6)"

#: An order states the sum of its lines: missing (key % 7 = 0), exact, off by one, or within tolerance (key % 3).
TOTALS = """sums AS (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,6)) AS summed FROM lineitem GROUP BY l_orderkey),
rule AS (
  SELECT o_orderkey AS document_id, coalesce(summed, 0) AS summed,
    CASE WHEN o_orderkey % 7 <> 0 THEN coalesce(summed, 0) + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.005 END END AS total
  FROM orders LEFT JOIN sums ON l_orderkey = o_orderkey),
summed AS (
  SELECT document_id, summed::DOUBLE AS summed, total::DOUBLE AS total,
    CASE WHEN total IS NULL THEN 'not_evaluated' WHEN abs(summed - total) <= 0.01 THEN 'passed' ELSE 'failed' END AS outcome,
    CASE WHEN total IS NULL THEN 'operand_absent' WHEN abs(summed - total) > 0.01 THEN 'sum_mismatch' END AS reason
  FROM rule)"""


def summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_extendedprice").cast(MONEY).alias("amount"))
    key, off = F.col("document_id"), F.when(F.col("document_id") % 3 == 0, 0).when(F.col("document_id") % 3 == 1, 1).otherwise(0.005)
    stated = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id")).join(amounts.groupBy("document_id").agg(F.sum("amount").alias("_s")), "document_id", "left")
    stated = stated.select("document_id", F.when(key % 7 != 0, F.coalesce("_s", F.lit(0).cast(MONEY)) + off.cast(MONEY)).cast("decimal(28,6)").alias("total"))
    return V.sum_equals(stated, amounts, "0.01")


@query("sum_equals", f"WITH {TOTALS} SELECT * FROM summed")
def sum_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do each order's lines add up to its stated total?"""
    return summed(spark, sf_dir).withColumns({"summed": F.col("summed").cast("double"), "total": F.col("total").cast("double")})


PRODUCT = """product AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_tax, CASE WHEN l_partkey % 11 <> 0 THEN round(l_quantity::DECIMAL(18,4) * l_tax::DECIMAL(18,4), 1) + (CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END) END AS stated,
    l_quantity::DECIMAL(18,4) * l_tax::DECIMAL(18,4) AS p
  FROM lineitem)"""


def stated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("l_quantity").cast("decimal(18,4)"), F.col("l_tax").cast("decimal(18,4)")
    stated = F.when(F.col("l_partkey") % 11 != 0, F.round(q * t, 1) + F.when(F.col("l_partkey") % 4 == 0, 1).otherwise(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("quantity"), t.alias("rate"), stated.alias("stated"))


@query("product_equals", f"""
WITH {PRODUCT}
SELECT l_orderkey, l_linenumber, CASE WHEN stated IS NULL THEN 'not_evaluated' WHEN abs(p - stated) <= 0.05 THEN 'passed' ELSE 'failed' END AS outcome,
  CASE WHEN stated IS NULL THEN 'operand_absent' WHEN abs(p - stated) > 0.05 THEN 'product_mismatch' END AS reason
FROM product
""")  # fmt: skip
def product_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.product_equals(stated_products(spark, sf_dir), "quantity", "rate", "stated", "0.05").select("l_orderkey", "l_linenumber", "outcome", "reason")


@query("comparison", """
SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate, CASE WHEN o_orderdate IS NULL THEN 'not_evaluated' WHEN l_shipdate > o_orderdate THEN 'passed' ELSE 'failed' END AS outcome,
  CASE WHEN o_orderdate IS NULL THEN 'operand_absent' WHEN l_shipdate <= o_orderdate THEN 'comparison_failed' END AS reason
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
""")
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each line ship after its order?"""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return V.comparison(rows.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate"), "l_shipdate", "gt", "o_orderdate")


@query("conditional_presence", """
SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' AND max(l_orderkey) IS NULL THEN 'failed' ELSE 'passed' END AS outcome,
  CASE WHEN o_orderstatus = 'F' AND max(l_orderkey) IS NULL THEN 'companion_missing' END AS reason
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus
""")
def conditional_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished order must have lines."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("_line")).distinct()
    orders = table(spark, sf_dir, "orders").withColumn("_done", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")))
    rows = orders.join(lines, F.col("_line") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("document_id"), "_done", "_line")
    return V.conditional_presence(rows, "_done", "_line").select("document_id", "outcome", "reason")


#: Constraint, table, key, field, declared value and the same test in SQL.
CONSTRAINTS = (
    ("enum", "orders", "o_orderkey", "o_orderstatus", ("F", "O"), "o_orderstatus IN ('F', 'O')"),
    ("const", "lineitem", "l_orderkey", "l_linestatus", "O", "l_linestatus = 'O'"),
    ("pattern", "orders", "o_orderkey", "o_orderpriority", "[1-3]-[A-Z]+", "regexp_full_match(o_orderpriority, '[1-3]-[A-Z]+')"),
    ("minimum", "part", "p_partkey", "p_retailprice", 1000.0, "p_retailprice >= 1000"),
    ("maximum", "lineitem", "l_orderkey", "l_quantity", 40.0, "l_quantity <= 40"),
    ("multiple_of", "lineitem", "l_orderkey", "l_quantity", 5, "l_quantity::DECIMAL(18,6) % 5 = 0"),
    ("min_length", "documents", "doc_id", "text", 100, "length(text) >= 100"),
    ("max_length", "documents", "doc_id", "text", 5000, "length(text) <= 5000"),
)


#: Patterns that both engines read alike, on whole texts: some that a matcher with backtracking might never finish.
PATTERNS = (
    ("sentences", "documents", "doc_id", "text", r"([A-Z][^.\n]*\.[ \n]*)+"),
    ("words", "documents", "doc_id", "text", r"(([a-zA-Z]+[,.]?)+[ \n]?)+"),
    ("priority", "orders", "o_orderkey", "o_orderpriority", r"^([1-3]-[A-Z]+|4-NOT (SPECIFIED|KNOWN)|[5-9]-L.{2})$"),
    ("property", "events", "event_id", "props", r'\{"k": ([0-4][0-9]{0,2}|[5-9]+)\}'),
    ("turn", "conversations", "conv_id", "text", r"(.|\n){0,200}[^a-z]"),
)


@query("pattern_matches", " UNION ALL ".join(f"SELECT '{name}' AS pattern, {k}::BIGINT AS row_key, regexp_full_match({f}, '{p}') AS fits FROM {t} WHERE {f} IS NOT NULL" for name, t, k, f, p in PATTERNS))
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared patterns held against whole columns."""

    def one(name, source, row_key, field, declared):
        rows = table(spark, sf_dir, source).where(F.col(field).isNotNull())
        return rows.select(F.lit(name).alias("pattern"), F.col(row_key).cast("long").alias("row_key"), pattern.matches(F.col(field), declared).alias("fits"))

    out = one(*PATTERNS[0])
    for p in PATTERNS[1:]:
        out = out.unionByName(one(*p))
    return out


@query("constraints_all", " UNION ALL ".join(f"SELECT '{key}' AS key, {k}::BIGINT AS row_key, CASE WHEN {test} THEN 'passed' ELSE 'failed' END AS outcome, CASE WHEN NOT ({test}) THEN '{key}' END AS reason FROM {t} WHERE {f} IS NOT NULL" for key, t, k, f, _, test in CONSTRAINTS))
def constraints_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight constraints, each over a whole column."""

    def one(key, name, row_key, field, declared, _):
        rows = V.constraint(table(spark, sf_dir, name), key, declared, field)
        return rows.select(F.lit(key).alias("key"), F.col(row_key).cast("long").alias("row_key"), "outcome", "reason")

    return reduce(DataFrame.unionByName, (one(*c) for c in CONSTRAINTS))


@query("required_checks", """
SELECT o_orderkey, CASE WHEN count(l_orderkey) > 0 THEN 'passed' ELSE 'failed' END AS outcome, CASE WHEN count(l_orderkey) = 0 THEN 'required_value_missing' END AS reason
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def required_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return V.required(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey")


CHECKS = f"""{TOTALS},
checks AS (
  SELECT document_id, 'rule:lines_add_up' AS check_id, 'total' AS field_path, 'rule' AS kind, outcome, reason, 'error' AS severity FROM summed
  UNION ALL SELECT o_orderkey, 'required:lines', 'lines', 'required', CASE WHEN s.l_orderkey IS NOT NULL THEN 'passed' ELSE 'failed' END, CASE WHEN s.l_orderkey IS NULL THEN 'required_value_missing' END, 'warning'
  FROM orders LEFT JOIN sums s ON s.l_orderkey = o_orderkey)"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = summed(spark, sf_dir).select("document_id", F.lit("rule:lines_add_up").alias("check_id"), F.lit("total").alias("field_path"), F.lit("rule").alias("kind"), "outcome", "reason", F.lit("error").alias("severity"))
    lines = required_checks(spark, sf_dir)
    need = lines.select(F.col("o_orderkey").alias("document_id"), F.lit("required:lines").alias("check_id"), F.lit("lines").alias("field_path"), F.lit("required").alias("kind"), "outcome", "reason", F.lit("warning").alias("severity"))
    return rule.unionByName(need)


VERDICTS = f"""{CHECKS},
verdicts AS (
  SELECT document_id, count(*)::BIGINT AS declared, count(*) FILTER (WHERE outcome = 'passed')::BIGINT AS passed, count(*) FILTER (WHERE outcome = 'failed')::BIGINT AS failed,
    count(*) FILTER (WHERE outcome = 'not_evaluated')::BIGINT AS not_evaluated, count(*) FILTER (WHERE outcome = 'failed' AND severity = 'error')::BIGINT AS errors,
    count(*) FILTER (WHERE outcome = 'failed' AND severity = 'warning')::BIGINT AS warnings,
    CASE WHEN count(*) FILTER (WHERE outcome = 'failed' AND severity = 'error') > 0 THEN 'invalid' WHEN count(*) FILTER (WHERE outcome = 'not_evaluated') > 0 THEN 'incomplete' ELSE 'valid' END AS verdict
  FROM checks GROUP BY document_id)"""


@query("validation_verdict", f"WITH {VERDICTS} SELECT * FROM verdicts")
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.verdict(checks(spark, sf_dir))


@query("findings", f"WITH {CHECKS} SELECT * FROM checks WHERE outcome <> 'passed'")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(checks(spark, sf_dir))


@query("routing_decision", f"""
WITH {VERDICTS},
reason AS (
  SELECT document_id, ':validation:' || verdict AS r FROM verdicts WHERE verdict = 'incomplete'
  UNION ALL SELECT document_id, field_path || ':validation:error' FROM checks WHERE outcome = 'failed' AND severity = 'error')
SELECT v.document_id, CASE WHEN count(r) > 0 THEN 'review' ELSE 'automatic' END AS outcome, coalesce(string_agg(r, ',' ORDER BY r), '') AS reasons
FROM verdicts v LEFT JOIN reason USING (document_id) GROUP BY v.document_id
""")
def routing_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a result go to a person? Incomplete ones do, and those with an error."""
    own = checks(spark, sf_dir)
    policy = R.Policy(version="1", review_verdicts=("incomplete",))
    none = spark.createDataFrame([], "document_id long, field_path string, status string, score double")
    return R.decide(V.verdict(own), V.findings(own), none, policy).select("document_id", "outcome", F.array_join("reasons", ",").alias("reasons"))
