"""Queries on grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators import documents as D
from folio.operators import grounding as G
from folio.operators.lineage import checkpoint
from folio.plans.documents import HITS, PAGE, TILES, docs, hits
from folio.plans.tables import table


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on all documents that hold a passage: the passage, one with a wrong character, or a text that stands nowhere."""
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("_b"))
    found = hits(spark, sf_dir).select("document_id", "needle_id").distinct().join(needles, "needle_id")
    wrong = F.concat(F.substring("_b", 1, 12), F.lit("#"), F.expr("substring(_b, 14)"))
    claim = F.when(F.col("needle_id") % 3 == 0, F.col("_b")).when(F.col("needle_id") % 3 == 1, wrong).otherwise("no such text stands anywhere")
    return checkpoint(found.select("document_id", field("needle_id").alias("field_path"), claim.alias("claim")))


def field(needle_id: str) -> Column:
    return F.concat(F.lit("field"), F.col(needle_id).cast("string"))


@query("ground_claims")
def ground_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages located in all texts as they stand. No SQL: DuckDB's edit distance counts bytes."""
    out = G.ground(docs(spark, sf_dir), claims(spark, sf_dir), folding=False)
    return out.select("document_id", "field_path", "status", "span_start", "span_end", "score", "truncated")


@query("grounding_counts")
def grounding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts(ground_claims(spark, sf_dir))


@query("ground_passages")
def ground_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages located in the folded views of all texts, with the next best places."""
    return G.ground(docs(spark, sf_dir), claims(spark, sf_dir))


@query("passage_counts")
def passage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.counts(ground_passages(spark, sf_dir))


def boxed_tokens(rows: DataFrame) -> DataFrame:
    """The words of each text as tokens with boxes: lines of 100 characters on pages of PAGE; a word is 6 wide a character and 12 high."""
    words = rows.select("document_id", F.posexplode(F.split("text", "[ \n]")).alias("ord", "word"))
    by = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("span_end", F.sum(F.length("word") + 1).over(by) - 1).withColumn("span_start", F.col("span_end") - F.length("word")).where("word <> ''")
    x, y = F.col("span_start") % 100 * 6, F.floor(F.col("span_start") % PAGE / 100) * 12
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 6 * F.length("word")).alias("x1"), (y + 12).alias("y1"))
    return words.select("document_id", "ord", F.floor(F.col("span_start") / PAGE).alias("page_index"), "span_start", "span_end", box.alias("box"))


def placed_outcomes(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes with pages and boxes; every other document has no geometry."""
    met = rows.join(outcomes.select("document_id").distinct(), "document_id", "left_semi")
    capable = met.select("document_id", (F.col("document_id") % 2 == 0).alias("geometry"))
    return G.with_boxes(G.with_pages(outcomes, D.tiles(met, PAGE), PAGE), boxed_tokens(met), capable)


@query("grounding_outcomes")
def grounding_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole outcome of each claim: status, span, score, alternatives, pages, boxes. DuckDB's edit distance counts bytes, so no SQL."""
    rows = docs(spark, sf_dir)
    out = checkpoint(G.ground(rows, claims(spark, sf_dir)))
    return placed_outcomes(rows, out)


@query("exact_outcomes", f"""
WITH {TILES}, {HITS},
place AS (SELECT *, row_number() OVER (PARTITION BY document_id, needle_id ORDER BY span_start) AS r FROM hit),
best AS (
  SELECT document_id, needle_id, min(span_start) AS span_start, min(span_end) AS span_end,
    coalesce(string_agg(span_start || '-' || span_end, ',' ORDER BY r) FILTER (WHERE r BETWEEN 2 AND 6), '') AS alternatives
  FROM place GROUP BY ALL),
split AS (SELECT doc_id AS document_id, string_split_regex(text, '[ \n]') AS w FROM documents),
word AS (SELECT document_id, i AS ord, w[i] AS word, sum(length(w[i]) + 1) OVER (PARTITION BY document_id ORDER BY i) - 1 AS b FROM split, unnest(range(1, len(w) + 1)) AS u(i)),
token AS (SELECT document_id, ord, length(word) AS n, b - length(word) AS a, b FROM word WHERE word <> ''),
box AS (
  SELECT p.document_id, p.needle_id, string_agg(a // {PAGE} || ':' || a % 100 * 6 || ':' || a % {PAGE} // 100 * 12 || ':' || (a % 100 * 6 + 6 * n) || ':' || (a % {PAGE} // 100 * 12 + 12), ' ' ORDER BY ord) AS boxes
  FROM best p JOIN token t ON t.document_id = p.document_id AND a < span_end AND b > span_start WHERE p.document_id % 2 = 0 GROUP BY ALL),
page AS (
  SELECT p.document_id, p.needle_id, string_agg(t.page_index, ',' ORDER BY t.page_index) AS pages
  FROM best p JOIN tile t ON t.document_id = p.document_id AND t.span_start < p.span_end AND t.span_end > p.span_start GROUP BY ALL)
SELECT document_id, 'field' || needle_id AS field_path, 'exact' AS status, span_start::INT AS span_start, span_end::INT AS span_end, 1.0::DOUBLE AS score, alternatives, pages, boxes
FROM best LEFT JOIN page USING (document_id, needle_id) LEFT JOIN box USING (document_id, needle_id)
""")  # fmt: skip
def exact_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage located where it stands word for word, in all documents: alternatives, pages and boxes."""
    rows = docs(spark, sf_dir)
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("claim"))
    asked = checkpoint(hits(spark, sf_dir).select("document_id", "needle_id").distinct().join(needles, "needle_id").select("document_id", field("needle_id").alias("field_path"), "claim"))
    out = placed_outcomes(rows, checkpoint(G.ground(rows, asked, folding=False)))
    spans = F.transform("alternatives", lambda a: F.concat_ws("-", a["span_start"], a["span_end"]))
    boxes = F.transform("geometry", lambda g: F.concat_ws(":", g["page_index"], g["box"]["x0"], g["box"]["y0"], g["box"]["x1"], g["box"]["y1"]))
    return out.select(
        "document_id", "field_path", "status", "span_start", "span_end", "score",
        F.array_join(spans, ",").alias("alternatives"), F.array_join("pages", ",").alias("pages"), F.array_join(boxes, " ").alias("boxes"),
    )


@query("folded_views")
def folded_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's view: its size and how many parts of the text it changes. Composition has no SQL form."""
    view = docs(spark, sf_dir).select("document_id", G.fold("text").alias("_v"))
    return view.select("document_id", F.length("_v.view").alias("view_size"), F.size("_v.parts").alias("changes"))


@query("exclusive_entries")
def exclusive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that claim their first word: equal words take one place after another. A fold, not SQL."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("entry"), "text")
    whole = turns.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "text"))), lambda x: x["text"]), "\n").alias("text"))
    asked = turns.select("document_id", F.concat(F.lit("turns["), F.col("entry").cast("string"), F.lit("].word")).alias("field_path"), F.regexp_extract("text", r"\w+", 0).alias("claim"))
    views = G.viewed(whole)
    places = G.sourced(G.exact(views, G.folded_claims(asked)), views)
    entry = F.regexp_extract("field_path", r"\[(\d+)\]", 1).cast("int")
    return G.exclusive(places.select("document_id", F.lit("turns[].word").alias("slot"), entry.alias("entry"), "span_start", "span_end", "score"))
