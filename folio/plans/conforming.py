"""Queries on payloads and schema registries: orders as payloads, some of which are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions.canonical import prompt_hash_of
from folio.functions.text import estimated_tokens
from folio.operators import conforming as C
from folio.operators import trees as T
from folio.plans.tables import table

SCHEMA = {
    "name": "order",
    "version": 1,
    "fields": [
        {"name": "number", "type": "int"},
        {"name": "status", "type": "string"},
        {"name": "total", "type": "decimal"},
        {"name": "paid", "type": "boolean"},
        {"name": "placed", "type": "date"},
        {"name": "buyer", "fields": [{"name": "id", "type": "int"}, {"name": "weight", "type": "number"}]},
        {"name": "marks", "cardinality": "many", "fields": [{"name": "rank", "type": "int"}, {"name": "word", "type": "string"}]},
    ],
}

#: What each payload says, and what is wrong with it. Ordinals are places in declared order.
FIELDS = """f AS (
  SELECT o_orderkey AS document_id, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice::DECIMAL(18,2)::VARCHAR AS t, o_orderdate::DATE::VARCHAR AS d FROM orders),
field AS (
  SELECT document_id, 0 AS ordinal, 'number' AS field_path, CASE WHEN k % 10 <> 0 THEN k::VARCHAR END AS value, CASE WHEN k % 10 = 0 THEN 'wrong_type' END AS problem FROM f WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 1, 'status', CASE WHEN k % 13 <> 0 AND k % 4 <> 0 THEN s END, CASE WHEN k % 13 = 0 THEN 'missing_field' END FROM f WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 2, 'total', CASE WHEN k % 11 <> 0 THEN t END, CASE WHEN k % 11 = 0 THEN 'wrong_type' END FROM f WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 3, 'paid', CASE WHEN k % 23 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END END, CASE WHEN k % 23 = 0 THEN 'wrong_type' END FROM f WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 4, 'placed', CASE WHEN k % 29 <> 0 THEN d END, CASE WHEN k % 29 = 0 THEN 'wrong_type' END FROM f WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 5, 'buyer', NULL, CASE WHEN k % 19 = 0 THEN 'scalar_for_group' ELSE 'wrong_shape' END FROM f WHERE k % 97 <> 0 AND (k % 19 = 0 OR k % 31 = 0)
  UNION ALL SELECT document_id, 6, 'buyer.id', c::VARCHAR, NULL FROM f WHERE k % 97 <> 0 AND k % 19 <> 0 AND k % 31 <> 0
  UNION ALL SELECT document_id, 7, 'buyer.weight', CASE WHEN k % 2 = 0 THEN '1.5' ELSE '2' END, NULL FROM f WHERE k % 97 <> 0 AND k % 19 <> 0 AND k % 31 <> 0
  UNION ALL SELECT document_id, 9, 'marks[' || i || '].rank', i::VARCHAR, NULL FROM f, unnest(range(k % 3)) AS u(i) WHERE k % 97 <> 0
  UNION ALL SELECT document_id, 10, 'marks[' || i || '].word', CASE WHEN i = 0 THEN s END, NULL FROM f, unnest(range(k % 3)) AS u(i) WHERE k % 97 <> 0
  UNION ALL SELECT document_id, -1, '', NULL, 'not_an_object' FROM f WHERE k % 97 = 0)"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads as text."""
    k, text = F.col("o_orderkey"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    triple = lambda v, claimed="null": F.concat(F.lit('{"value":'), v, F.lit(f',"claimed_text":{claimed},"confidence":0.5}}'))
    key = lambda n, v: F.concat(F.lit(f'"{n}":'), v)
    when = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    number = k.cast("string")
    buyer = F.concat(F.lit("{"), key("id", triple(F.col("o_custkey").cast("string"))), F.lit(","), key("weight", triple(when(2, F.lit("1.5"), F.lit("2")))), F.lit("}"))
    mark = lambda i: F.concat(F.lit("{"), key("rank", triple(i.cast("string"))), F.lit(","), key("word", triple(F.when(i == 0, text(F.col("o_orderstatus"))).otherwise(F.lit("null")), '"w"')), F.lit("}"))
    marks = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), k % 3 - 1), mark))
    parts: list[Column] = [
        key("number", triple(when(10, text(number), number))),
        F.when(k % 13 != 0, key("status", triple(when(4, F.lit("null"), text(F.col("o_orderstatus")))))),
        key("total", triple(when(11, F.lit("12.5"), text(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))))),
        key("paid", triple(when(23, F.lit("1"), when(2, F.lit("true"), F.lit("false"))))),
        key("placed", triple(text(when(29, F.lit("2026-1-1"), F.date_format("o_orderdate", "yyyy-MM-dd"))))),
        key("buyer", when(19, triple(F.lit("1")), when(31, F.lit("[]"), buyer))),
        key("marks", F.concat(F.lit("["), F.array_join(marks, ","), F.lit("]"))),
        F.when(k % 37 == 0, key("remark", F.lit('"more"'))),
    ]
    whole = when(97, F.lit("[1]"), F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")))
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), whole.alias("payload"))


@query("conformed_fields", f"WITH {FIELDS} SELECT document_id, field_path, value, value IS NOT NULL AS present, problem FROM field")
def conformed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every declared field of every payload, read strictly in its type."""
    return C.conformed(payloads(spark, sf_dir), SCHEMA).select("document_id", "field_path", "value", "present", "problem")


@query("conform_refusals", f"WITH {FIELDS} SELECT document_id, field_path, problem FROM field WHERE problem IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ordinal, field_path) = 1")
def conform_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.refusals(C.conformed(payloads(spark, sf_dir), SCHEMA))


@query("value_presence", f"WITH {FIELDS} SELECT document_id, count(value)::BIGINT AS present, (count(*) - count(value))::BIGINT AS absent FROM field GROUP BY document_id")
def value_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.presence(C.conformed(payloads(spark, sf_dir), SCHEMA))


TREE = """
SELECT document_id, '{"number":{"value":' || k || ',"claimed_text":null},"status":{"value":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '"' || s || '"' END || ',"claimed_text":null},"total":{"value":"' || t
  || '","claimed_text":null},"paid":{"value":' || (k % 2 = 0)::VARCHAR || ',"claimed_text":null},"placed":{"value":"' || d || '","claimed_text":null},"buyer":{"id":{"value":' || c || ',"claimed_text":null},"weight":{"value":'
  || CASE WHEN k % 2 = 0 THEN '1.5' ELSE '2' END || ',"claimed_text":null}},"marks":[' || coalesce(array_to_string(list_transform(range(k % 3), lambda i: '{"rank":{"value":' || i || ',"claimed_text":null},"word":{"value":'
  || CASE WHEN i = 0 THEN '"' || s || '"' ELSE 'null' END || ',"claimed_text":"w"}}'), ','), '') || ']}' AS tree
FROM f WHERE k % 97 <> 0 AND k % 10 <> 0 AND k % 13 <> 0 AND k % 11 <> 0 AND k % 23 <> 0 AND k % 29 <> 0 AND k % 19 <> 0 AND k % 31 <> 0
"""


@query("payload_trees", f"WITH {FIELDS} {TREE}")
def payload_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of each sound payload as a tree again."""
    return T.rebuilt(C.conformed(payloads(spark, sf_dir), SCHEMA), SCHEMA)


@query("retyped_values", f"""
WITH {FIELDS}
SELECT field_path, count(value) AS present, sum(CASE WHEN field_path = 'total' THEN value::DECIMAL(38,18) END)::DECIMAL(38,2) AS total, max(CASE WHEN field_path = 'placed' THEN value::DATE END) AS latest,
  sum(CASE WHEN field_path IN ('number', 'buyer.id') THEN value::BIGINT END)::BIGINT AS whole, count(*) FILTER (WHERE field_path = 'paid' AND value = 'true') AS yes
FROM field WHERE problem IS NULL GROUP BY field_path
""")
def retyped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by path in their types again: sums of decimals and numbers, the latest date, how many are true."""
    rows = T.retyped(C.conformed(payloads(spark, sf_dir), SCHEMA).where("problem IS NULL"))
    total = F.sum("as_decimal").cast("decimal(38,2)")
    ids = F.col("field_path").isin("number", "buyer.id")
    sums = F.count("value").alias("present"), total.alias("total"), F.max("as_date").alias("latest"), F.sum(F.when(ids, F.col("as_int"))).alias("whole"), F.count_if("as_boolean").alias("yes")
    return rows.groupBy("field_path").agg(*sums)


@query("discarded_keys", "SELECT o_orderkey AS document_id, 'remark' AS key FROM orders WHERE o_orderkey % 37 = 0 AND o_orderkey % 97 <> 0")
def discarded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.discarded(payloads(spark, sf_dir), SCHEMA)


@query("value_at", f"WITH {FIELDS} SELECT document_id, value FROM field WHERE field_path = 'marks[1].rank'")
def value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.at_path(C.conformed(payloads(spark, sf_dir), SCHEMA), "marks[1].rank")


REGISTRY = "files(schema_identity, prompt) AS (VALUES ('order@1', 'f1'), ('order@2', 'f2'), ('note@1', 'n1')), console(schema_identity, prompt, valid) AS (VALUES ('order@2', 'c2', true), ('note@1', 'x', false), ('memo@3', 'm3', true))"
MERGED = f"""{REGISTRY},
merged AS (
  SELECT coalesce(f.schema_identity, c.schema_identity) AS schema_identity, coalesce(c.prompt, f.prompt) AS prompt, CASE WHEN c.prompt IS NOT NULL THEN 'console' ELSE 'file' END AS source,
    c.prompt IS NOT NULL AND f.prompt IS NOT NULL AS shadowed
  FROM files f FULL JOIN (SELECT * FROM console WHERE valid) c USING (schema_identity))"""


def registries(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files = spark.createDataFrame([("order@1", "f1"), ("order@2", "f2"), ("note@1", "n1")], "schema_identity string, prompt string")
    return files, spark.createDataFrame([("order@2", "c2", True), ("note@1", "x", False), ("memo@3", "m3", True)], "schema_identity string, prompt string, valid boolean")


#: Schemas of the documents: one a language and version, declared in files and on the console.
REGISTRIES = """
files AS (SELECT lang || '@' || doc_id % 4 AS schema_identity, 'f' || min(doc_id) AS prompt FROM documents WHERE lang IS NOT NULL GROUP BY 1),
console AS (SELECT lang || '@' || doc_id % 7 AS schema_identity, 'c' || max(doc_id) AS prompt, min(doc_id) % 3 <> 0 AS valid FROM documents WHERE lang IS NOT NULL AND doc_id % 5 = 0 GROUP BY 1)"""
TABLE_MERGED = f"{REGISTRIES},{MERGED[len(REGISTRY) + 1:]}"


def identity(versions: int) -> Column:
    return F.concat("lang", F.lit("@"), (F.col("doc_id") % versions).cast("string"))


def table_registries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL")
    files = rows.groupBy(identity(4).alias("schema_identity")).agg(F.concat(F.lit("f"), F.min("doc_id").cast("string")).alias("prompt"))
    mine = rows.where("doc_id % 5 = 0").groupBy(identity(7).alias("schema_identity"))
    return files, mine.agg(F.concat(F.lit("c"), F.max("doc_id").cast("string")).alias("prompt"), (F.min("doc_id") % 3 != 0).alias("valid"))


@query("merged_registry", f"WITH {TABLE_MERGED} SELECT * FROM merged")
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merged_registry(*table_registries(spark, sf_dir))


@query("schema_resolution", f"""
WITH {MERGED},
asked AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'order@1' WHEN 1 THEN 'order@2' WHEN 2 THEN 'note@1' WHEN 3 THEN 'memo@3' WHEN 4 THEN 'order' ELSE 'order@9' END AS schema_identity FROM documents)
SELECT doc_id, schema_identity, prompt, source, shadowed, CASE WHEN doc_id % 6 = 4 THEN 'bad_identity' WHEN doc_id % 6 = 5 THEN 'unknown_schema' END AS refusal FROM asked LEFT JOIN merged USING (schema_identity)
""")
def schema_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(n) for n in ("order@1", "order@2", "note@1", "memo@3", "order", "order@9")))
    asked = table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("schema_identity"))
    return C.resolved(asked, C.merged_registry(*registries(spark)))


@query("next_versions", f"WITH {REGISTRIES} SELECT string_split(schema_identity, '@')[1] AS name, (max(string_split(schema_identity, '@')[2]::INT) + 1)::INT AS next_version FROM console GROUP BY 1")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_version(table_registries(spark, sf_dir)[1])


@query("prompt_hashes", """
SELECT doc_id, 'sha256:' || sha256('{"prompt":' || to_json(nfc_normalize(coalesce(text, ''))) || '}') AS prompt_hash FROM documents
""")
def prompt_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a prompt: the hash of its canonical form."""
    return table(spark, sf_dir, "documents").select("doc_id", prompt_hash_of(F.coalesce("text", F.lit(""))).alias("prompt_hash"))


@query("model_requests", """
SELECT doc_id AS document_id, length('Read this.' || chr(10) || chr(10) || coalesce(text, ''))::INT AS request_size, CASE WHEN floor(length(coalesce(text, '')) / 1.20::DOUBLE * 1.15::DOUBLE)::INT + 1 > 2000 THEN 'input_budget' END AS refusal FROM documents
""")
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), text.alias("text"), estimated_tokens(text).alias("tokens"))
    return C.requested(rows, "Read this.", 2000).select("document_id", F.length("request").alias("request_size"), "refusal")
