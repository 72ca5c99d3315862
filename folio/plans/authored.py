"""Queries on declared schemas as they are authored: a schema for each part, of which many have an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.plans.tables import table
from folio.sources import authored as A


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name, size, of = F.concat(F.lit("part"), k.cast("string")), F.col("p_size").cast("string"), lambda n: k % 8 == n
    lit = F.lit
    content = F.concat(
        lit('{"name":"'), F.when(of(7), "shared").otherwise(name), lit('","version":'), F.when(of(3), "0").otherwise("1"), F.when(of(2), ',"owner":"x"').otherwise(""),
        lit(',"fields":[{"name":"size","type":"'), F.when(of(4), "money").otherwise("integer"), lit('","constraints":{"maximum":'), F.when(of(5), '"many"').otherwise(size), lit('}},{"name":"price","type":"decimal","required":true},'),
        lit('{"name":"rows","cardinality":"repeating_group","fields":[{"name":"amount","type":"decimal"}]}],"rules":[{"id":"total","kind":"sum_equals","operands":["rows.'), F.when(of(6), "total").otherwise("amount"), lit('","price"]}]'),
        F.when(of(1), "").otherwise("}"),
    )
    given = table(spark, sf_dir, "part")
    files = given.select(F.concat(lit("schemas/"), name, lit(".json")).alias("path"), content.alias("content"))
    prompts = given.where("p_partkey % 13 <> 0").select(F.concat(lit("schemas/prompts/"), name, lit(".md")).alias("path"), F.when(k % 11 == 0, " \n").otherwise(F.col("p_name")).alias("content"))
    return A.with_prompts(A.parsed(files), prompts)


REFUSED = """part_ AS (SELECT p_partkey AS k, p_partkey % 8 AS n, p_size, 'schemas/part' || p_partkey || '.json' AS path, CASE WHEN p_partkey % 8 = 7 THEN 'shared@1' WHEN p_partkey % 8 NOT IN (1, 3) THEN 'part' || p_partkey || '@1' END AS identity FROM part),
refused AS (
  SELECT path, ['', 'owner', 'version', 'fields.0.type', 'size', 'total'][n] AS at, ['not_json', 'unknown_key', 'too_small', 'unknown_word', 'constraint_value', 'unknown_operand'][n] AS problem FROM part_ WHERE n BETWEEN 1 AND 6
  UNION ALL SELECT path, identity, 'repeated_identity' FROM part_ WHERE n = 7 AND (SELECT count(*) FROM part_ WHERE n = 7) > 1
  UNION ALL SELECT path, identity, CASE WHEN k % 13 = 0 THEN 'no_prompt' ELSE 'empty_prompt' END FROM part_ WHERE identity IS NOT NULL AND (k % 13 = 0 OR k % 11 = 0))"""


@query("authoring_refusals", f"WITH {REFUSED} SELECT * FROM refused")
def authoring_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every authoring error of every file."""
    return A.refusals(schemas(spark, sf_dir))


@query("authored_fields", f"""
WITH {REFUSED}, good AS (SELECT * FROM part_ WHERE path NOT IN (SELECT path FROM refused)),
f AS (SELECT unnest([0, 1, 2, 3]) AS ordinal, unnest(['size', 'price', 'rows', 'rows.amount']) AS path, unnest(['size', 'price', 'rows', 'amount']) AS name, unnest(['int', 'decimal', 'group', 'decimal']) AS type, unnest(['one', 'one', 'many', 'one']) AS cardinality)
SELECT identity AS schema_identity, f.*, f.path = 'price' AS required, '' AS description, CASE WHEN f.path = 'size' THEN '{{"maximum": ' || p_size || '}}' ELSE '{{}}' END AS constraints, CASE WHEN f.path = 'rows.amount' THEN 'rows' END AS group_path FROM good, f
""")
def authored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the schemas without an error."""
    return A.field_table(A.accepted(schemas(spark, sf_dir)))
