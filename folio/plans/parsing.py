"""Queries on decisions before parsing, checks of parsers' output, pages of slices and merged parts, and the artifact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions.text import content_id
from folio.operators import documents as D
from folio.operators import parsing as P
from folio.operators import whole as W
from folio.plans.documents import CONVERSATION_WORDS, PAGE, TILES, docs
from folio.plans.tables import table

PARSERS = (("native", ["application/pdf"], ["text", "tables"], True, 1, "2"), ("cloud", ["application/pdf", "image/png"], ["text", "tables", "recognition"], True, 2, "5"), ("local", ["image/png", "image/jpeg"], ["text", "recognition"], False, 3, "1"))
KINDS = ("application/pdf", "image/png", "image/jpeg")
ASKED = """asked AS (
  SELECT doc_id AS document_id, 'sha256:' || sha256(coalesce(text, '')) AS blob_id, ['application/pdf', 'image/png', 'image/jpeg'][doc_id % 3 + 1] AS media_type, doc_id % 2 = 0 AS tables, doc_id % 5 <> 0 AS usable,
    ['native', 'cloud', 'local', 'none'][doc_id % 4 + 1] AS parser_id
  FROM documents)"""


def parsers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PARSERS), "parser_id string, media_types array<string>, supplies array<string>, available boolean, priority int, parser_version string")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda names: F.try_element_at(F.array(*(F.lit(n) for n in names)), (k % len(names) + 1).cast("int"))
    needs = F.when(k % 2 == 0, F.array(F.lit("text"), F.lit("tables"))).otherwise(F.array(F.lit("text")))
    return table(spark, sf_dir, "documents").select(k.alias("document_id"), content_id(F.coalesce("text", F.lit(""))).alias("blob_id"), pick(KINDS).alias("media_type"), needs.alias("needs"), (k % 5 != 0).alias("usable"), pick(("native", "cloud", "local", "none")).alias("parser_id"))


@query("page_count_refusals", f"WITH {TILES} SELECT document_id, CASE WHEN count(*) > 3 THEN 'page_limit' END AS refusal FROM tile GROUP BY document_id")
def page_count_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = D.tiles(docs(spark, sf_dir), PAGE).groupBy("document_id").agg(F.count("*").alias("pages"))
    return pages.select("document_id", P.page_refusal(F.col("pages"), 3).alias("refusal"))


@query("named_parsers", f"""
WITH {ASKED}
SELECT document_id, parser_id, CASE WHEN parser_id = 'none' THEN 'unknown_parser'
  WHEN NOT CASE parser_id WHEN 'native' THEN media_type = 'application/pdf' WHEN 'cloud' THEN media_type <> 'image/jpeg' ELSE media_type <> 'application/pdf' END THEN 'media_type'
  WHEN parser_id = 'local' AND tables THEN 'missing:tables' WHEN parser_id = 'local' THEN 'unavailable' END AS refusal FROM asked
""")
def named_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.named(asked(spark, sf_dir), parsers(spark))


@query("parse_plan", f"""
WITH {ASKED},
p AS (SELECT *, CASE WHEN media_type = 'application/pdf' AND usable THEN 'native' WHEN media_type <> 'image/jpeg' THEN 'cloud' END AS chosen FROM asked)
SELECT document_id, CASE WHEN usable THEN 'native' ELSE 'recognition' END AS route, chosen AS parser_id,
  CASE WHEN chosen IS NOT NULL THEN 'sha256:' || sha256('{{"blob_id":"' || blob_id || '","options_hash":"o1","parser_id":"' || chosen || '","parser_version":"' || CASE chosen WHEN 'native' THEN '2' ELSE '5' END || '","v":"1"}}') END AS planned_id,
  CASE WHEN chosen IS NULL THEN 'no_parser' END AS refusal FROM p
""")
def parse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, parser and document id, all known before anything is parsed."""
    return P.planned(asked(spark, sf_dir).drop("parser_id"), parsers(spark), "o1")


@query("text_layer_records", f"""
WITH {ASKED}, l AS (SELECT *, document_id % 4 AS pages, document_id % 3 AS bearing, CASE document_id % 7 WHEN 0 THEN 'native' WHEN 1 THEN 'recognition' END AS forced, media_type <> 'application/pdf' AS other FROM asked)
SELECT document_id, CASE WHEN other THEN 1 ELSE pages END AS pages, CASE WHEN other THEN 0 ELSE bearing END AS bearing, CASE WHEN other THEN false WHEN forced IS NOT NULL THEN forced = 'native' ELSE usable END AS usable,
  CASE WHEN NOT other AND forced IS NOT NULL THEN usable END AS rule_verdict, CASE WHEN other THEN 'not_a_pdf' END AS rule_not_run, CASE WHEN NOT other AND pages = 0 THEN 'corrupt' END AS refusal FROM l
""")
def text_layer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("document_id")
    rows = asked(spark, sf_dir).select("document_id", "media_type", (k % 4).alias("pages"), (k % 3).alias("bearing"), "usable")
    return P.layer_record(rows, F.when(k % 7 == 0, "native").when(k % 7 == 1, "recognition"))


@query("geometry_gaps", """
WITH t AS (SELECT l_orderkey AS document_id, count(*) FILTER (WHERE l_orderkey % 3 = 0 OR l_linenumber < 3) AS w, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT document_id FROM t WHERE w <> CASE WHEN document_id % 2 = 0 THEN n ELSE 0 END
""")
def geometry_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as tokens: geometry for all tokens where it is declared, else for none."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), ((F.col("l_orderkey") % 3 == 0) | (F.col("l_linenumber") < 3)).alias("has_geometry"))
    return P.geometry_gaps(rows, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 2 == 0).alias("geometry")))


@query("output_problems", """
SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'token_order' WHEN doc_id % 7 = 0 THEN 'undeclared:tables' WHEN doc_id % 5 = 0 THEN 'not_produced:geometry' WHEN doc_id % 13 = 0 THEN 'wrong_document'
  WHEN doc_id % 17 = 0 THEN 'wrong_version' END AS problem FROM documents
""")
def output_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id"), lambda *names: F.array(*(F.lit(n) for n in names))
    produced = F.when(k % 7 == 0, text("text", "tables", "geometry")).when(k % 5 == 0, text("text")).otherwise(text("text", "geometry"))
    same = {"blob_id": F.lit("b"), "parser_id": F.lit("p"), "parser_version": F.lit("1"), "text_layer": F.lit("usable")}
    out = {**same, "blob_id": F.when(k % 13 == 0, "c").otherwise("b"), "parser_version": F.when(k % 17 == 0, "2").otherwise("1")}
    rows = table(spark, sf_dir, "documents").select(k.alias("document_id"), *(c.alias(n) for n, c in same.items()), *(c.alias(f"out_{n}") for n, c in out.items()), F.when(k % 11 == 0, 1).otherwise(0).alias("misplaced"), text("text", "geometry").alias("declared"), produced.alias("produced"))
    return P.output_problem(rows)


@query("original_places", f"""
WITH {TILES}, part AS (SELECT document_id, page_index AS part, span_start + page_index * 10 AS origin_start, span_end + page_index * 10 AS origin_end, span_start AS a, span_end AS b FROM tile), place AS (SELECT doc_id AS document_id, 1500 AS s, 4500 AS e FROM documents)
SELECT document_id, s AS place_start, e AS place_end, part, origin_start + greatest(s, a) - a AS origin_start, origin_start + least(e, b) - a AS origin_end FROM part JOIN place USING (document_id) WHERE s < b AND e > a AND a < b
""")
def original_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as parts that lay ten characters apart in the source."""
    gap = F.col("page_index") * 10
    parts = D.tiles(docs(spark, sf_dir), PAGE).select("document_id", F.col("page_index").alias("part"), (F.col("span_start") + gap).alias("origin_start"), (F.col("span_end") + gap).alias("origin_end"))
    return P.original_places(parts, docs(spark, sf_dir).select("document_id", F.lit(1500).alias("place_start"), F.lit(4500).alias("place_end")))


@query("sliced_pages", f"WITH {TILES} SELECT document_id, page_index, greatest(span_start, 1000) - 1000 AS span_start, least(span_end, 5000) - 1000 AS span_end FROM tile WHERE span_start < 5000 AND span_end > 1000 AND span_start < span_end")
def sliced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return P.sliced_pages(D.tiles(rows, PAGE), rows.select("document_id", F.lit(1000).alias("cut_start"), F.lit(5000).alias("cut_end")))


@query("merged_pages", """
WITH t AS (SELECT conv_id AS document_id, turn AS part, turn // 2 AS page_index, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT document_id, page_index, min(b - n)::BIGINT AS span_start, max(b)::BIGINT AS span_end FROM t GROUP BY ALL
""")
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parts, two of them a page."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("part"), "text")
    pages = turns.select("document_id", "part", F.floor(F.col("part") / 2).alias("page_index"), F.lit(0).alias("span_start"), F.length("text").alias("span_end"))
    return P.merged_pages(pages, D.merged(turns))


WHOLE = f"""{CONVERSATION_WORDS},
turn AS (
  SELECT conv_id, turn, text, conv_id * 1000 + turn AS id, coalesce(sum(length(text)) OVER before, 0)::BIGINT AS source_at, coalesce(sum(CASE WHEN turn % 2 = 0 THEN length(text) END) OVER before, 0)::BIGINT AS merged_at
  FROM conversations WINDOW before AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
size AS (SELECT conv_id, sum(length(text))::BIGINT AS n FROM turn WHERE turn % 2 = 0 GROUP BY conv_id),
piece AS (SELECT conv_id, turn, i, string_split(text, ' ')[i] AS word, length(array_to_string(string_split(text, ' ')[1:i - 1], ' ')) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS a FROM turn, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i))"""


def turn_documents(spark: SparkSession, sf_dir: str) -> W.Whole:
    """Every turn as a document: its words are tokens, itself a block, every third a table with its first word as a cell; its source is the conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("document_id"))
    size, zero = F.length("text").cast("long"), F.lit(0).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    origin = rows.withColumn("origin_start", F.coalesce(F.sum(size).over(before), zero)).select("document_id", F.lit(0).alias("piece"), "origin_start", (F.col("origin_start") + size).alias("origin_end"))
    words = rows.select("document_id", F.posexplode(F.split("text", " ")).alias("ord", "word"))
    upto = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("span_end", F.sum(F.length("word") + 1).over(upto) - 1).withColumn("span_start", F.col("span_end") - F.length("word"))
    whole = rows.select("document_id", F.lit("b").alias("block"), zero.alias("span_start"), size.alias("span_end"))
    tables = rows.where("turn % 3 = 0").select("document_id", F.lit("t").alias("table"), zero.alias("span_start"), size.alias("span_end"))
    first = F.length(F.substring_index("text", " ", 1)).cast("long")
    cells = rows.where("turn % 3 = 0").select("document_id", F.lit("t").alias("table"), F.lit(0).alias("row"), F.lit(0).alias("col"), zero.alias("span_start"), first.alias("span_end"))
    pages = rows.select("document_id", F.floor(F.col("turn") / 4).alias("page_index"), zero.alias("span_start"), size.alias("span_end"))
    return W.Whole(rows.select("document_id", "text"), pages, words, whole, tables, cells, origin)


def slice_of_merge(spark: SparkSession, sf_dir: str) -> W.Whole:
    """Each conversation's even turns joined, and of that all but ten characters at either end."""
    turns = turn_documents(spark, sf_dir)
    key = F.floor(F.col("document_id") / 1000)
    parts = turns.texts.where("document_id % 1000 % 2 = 0").select(key.alias("merged_id"), (F.col("document_id") % 1000).alias("part"), "document_id")
    sources = turns.texts.select("document_id", key.alias("blob_id"), F.lit("p").alias("parser_id"), F.lit("1").alias("parser_version"))
    joined = W.merged(turns, parts, sources)
    cuts = joined.texts.where(F.length("text") > 20).select("document_id", (-F.col("document_id") - 1).alias("slice_id"), F.lit(10).cast("long").alias("cut_start"), (F.length("text") - 10).cast("long").alias("cut_end"))
    return W.sliced(joined, cuts)


@query("slice_of_merge", f"""
WITH {WHOLE}
SELECT -conv_id - 1 AS document_id, merged_at + a - 10 AS span_start, merged_at + a + length(word) - 10 AS span_end, source_at + a AS origin_start, source_at + a + length(word) AS origin_end
FROM piece JOIN turn USING (conv_id, turn) JOIN size USING (conv_id) WHERE turn % 2 = 0 AND word <> '' AND n > 20 AND merged_at + a >= 10 AND merged_at + a + length(word) <= n - 10
""")  # fmt: skip
def slice_of_merge_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of slices of merges, each with its place in the first source."""
    cut = slice_of_merge(spark, sf_dir)
    return W.in_source(cut, cut.tokens.select("document_id", "span_start", "span_end")).select("document_id", "span_start", "span_end", "origin_start", "origin_end")


@query("slice_of_merge_parts", f"""
WITH {WHOLE},
even AS (SELECT *, merged_at AS a, merged_at + length(text) AS b FROM turn JOIN size USING (conv_id) WHERE turn % 2 = 0 AND n > 20),
page AS (SELECT conv_id, n, turn // 4 AS page_index, min(a) AS a, max(b) AS b FROM even GROUP BY ALL),
kept AS (SELECT * FROM even WHERE a >= 10 AND b <= n - 10)
SELECT -conv_id - 1 AS document_id, 'page' AS kind, page_index::VARCHAR AS name, greatest(a, 10) - 10 AS span_start, least(b, n - 10) - 10 AS span_end FROM page WHERE a < n - 10 AND b > 10 AND a < b
UNION ALL SELECT -conv_id - 1, 'block', turn || '/b', a - 10, b - 10 FROM kept
UNION ALL SELECT -conv_id - 1, 'table', turn || '/t', a - 10, b - 10 FROM kept WHERE turn % 3 = 0
UNION ALL SELECT -conv_id - 1, 'cell', turn || '/t', a - 10, a - 10 + length(string_split(text, ' ')[1]) FROM kept WHERE turn % 3 = 0
UNION ALL SELECT -conv_id - 1, 'origin', NULL, source_at + greatest(10 - a, 0), source_at + length(text) - greatest(b - (n - 10), 0) FROM even WHERE a < n - 10 AND b > 10 AND a < b
""")  # fmt: skip
def slice_of_merge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, blocks, tables, cells and origins of slices of merges."""
    cut = slice_of_merge(spark, sf_dir)
    one = lambda df, kind, name, a="span_start", b="span_end": df.select("document_id", F.lit(kind).alias("kind"), name.cast("string").alias("name"), F.col(a).cast("long").alias("span_start"), F.col(b).cast("long").alias("span_end"))
    out = one(cut.pages, "page", F.col("page_index")).unionByName(one(cut.blocks, "block", F.col("block"))).unionByName(one(cut.tables, "table", F.col("table")))
    return out.unionByName(one(cut.cells, "cell", F.col("table"))).unionByName(one(cut.origin, "origin", F.lit(None), "origin_start", "origin_end"))


@query("located_boxes", """
SELECT l_orderkey AS document_id, CASE WHEN l_orderkey % 2 = 0 THEN string_agg(l_linenumber, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) END AS boxes, CASE WHEN l_orderkey % 2 <> 0 THEN 'no_geometry' END AS refusal FROM lineitem GROUP BY l_orderkey
""")
def located_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a span's tokens in order; a document without geometry is refused, not answered with none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(0).alias("span_start"), F.lit(9).alias("span_end"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"), F.col("l_linenumber").cast("string").alias("box"))
    found = P.located(lines, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 2 == 0).alias("geometry")))
    return found.select("document_id", F.array_join("boxes", ",").alias("boxes"), "refusal")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, payload = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        k.cast("string").alias("artifact_id"), payload.alias("payload"), content_id(F.when(k % 9 == 0, "odd").otherwise(payload)).alias("content_id"), (k % 2 + 1).alias("format_version"), F.when(k % 3 == 0, "parse").otherwise("extract").alias("stage"),
        F.concat(F.lit("t"), (k % 4).cast("string")).alias("tenant_id"),
    )


@query("artifacts_got", "SELECT doc_id::VARCHAR AS artifact_id, doc_id % 2 = 0 AND doc_id % 9 <> 0 AS found, doc_id % 2 = 0 AND doc_id % 9 = 0 AS damaged FROM documents")
def artifacts_got(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of format version 1; a payload that isn't what its content id says is damaged."""
    rows = store(spark, sf_dir)
    return P.got(rows.select("artifact_id"), rows, 1).select("artifact_id", F.col("payload").isNotNull().alias("found"), "damaged")


@query("artifacts_left", """
SELECT 'cleared' AS step, count(*) FILTER (WHERE doc_id % 3 <> 0)::BIGINT AS artifacts FROM documents UNION ALL SELECT 'deleted', count(*) FILTER (WHERE doc_id % 5 <> 0)::BIGINT FROM documents UNION ALL SELECT 'tenant', count(*) FILTER (WHERE doc_id % 4 <> 1)::BIGINT FROM documents
""")
def artifacts_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after clearing a stage, deleting ids, and deleting a tenant."""
    rows = store(spark, sf_dir)
    left = {"cleared": P.cleared(rows, "parse"), "deleted": P.deleted(rows, rows.where("artifact_id % 5 = 0")), "tenant": P.prefix_deleted(rows, "t1", "t0")}
    counts = [df.agg(F.count("*").alias("artifacts")).select(F.lit(n).alias("step"), "artifacts") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("blobs_added", "SELECT DISTINCT 'sha256:' || sha256(coalesce(text, '')) AS blob_id FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)")
def blobs_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", content_id(F.coalesce("text", F.lit(""))).alias("blob_id"))
    return P.blobs_added(rows.where("doc_id % 2 = 0"), rows).select("blob_id")


@query("namespaces", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN '' ELSE 't/' || user_id % 5 END AS folder FROM (SELECT DISTINCT user_id FROM events)")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id").distinct()
    return rows.select("user_id", P.namespace((F.col("user_id") % 5).cast("string"), "0").alias("folder"))
