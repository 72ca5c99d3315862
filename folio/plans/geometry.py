"""Queries on spans, boxes, pages and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions import geometry as G
from folio.operators.documents import overlaps
from folio.plans.tables import table


@query("span_algebra", """
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_linenumber - 2 AS a, l_linenumber - 3 + l_suppkey % 5 AS b, l_partkey % 7 AS c, l_partkey % 7 + l_suppkey % 3 AS d, l_partkey % 4 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a < 0 THEN 'negative' WHEN b < a THEN 'reversed' END AS problem, p >= a AND p < b AS holds_place, c >= a AND d <= b AS holds_span,
  a < d AND b > c AND a < b AND c < d AS overlapping, CASE WHEN a - p >= 0 THEN (a - p)::BIGINT END AS moved_start, CASE WHEN a - p >= 0 THEN (b - p)::BIGINT END AS moved_end, b <= 5 AS within
FROM s
""")  # fmt: skip
def span_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n, p, s = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    a, b, c, at = n - 2, n - 3 + s % 5, p % 7, p % 4
    d = c + s % 3
    moved = G.shifted(a, b, -at)
    return rows.select(
        "l_orderkey", "l_linenumber", G.span_problem(a, b).alias("problem"), G.contains(a, b, at).alias("holds_place"), G.contains_span(a, b, c, d).alias("holds_span"),
        overlaps(a, b, c, d).alias("overlapping"), moved["start"].alias("moved_start"), moved["end"].alias("moved_end"), G.contains_span(F.lit(-9), F.lit(5), a, b).alias("within"),
    )


@query("box_algebra", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: abs(v::DOUBLE) * 4) AS e FROM embeddings),
b AS (SELECT vec_id, e[1] AS ax0, e[2] AS ay0, e[3] AS ax1, e[4] AS ay1, e[5] AS bx0, e[6] AS by0, e[7] AS bx1, e[8] AS by1 FROM e)
SELECT vec_id, CASE WHEN greatest(ax0, ay0, ax1, ay1) > 1 THEN 'outside_page' WHEN ax1 < ax0 OR ay1 < ay0 THEN 'reversed' END AS problem,
  (ax1 - ax0) * (ay1 - ay0) AS area, (greatest(ax1, bx1) - least(ax0, bx0)) * (greatest(ay1, by1) - least(ay0, by0)) AS union_area, ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1 AS meeting,
  CASE WHEN vec_id % 9 = 0 THEN 'page_index' WHEN greatest(ax0, ay0, ax1, ay1) > 1 THEN 'outside_page' WHEN ax1 < ax0 OR ay1 < ay0 THEN 'reversed' END AS placed_problem,
  CASE WHEN greatest(ax0, ay0, ax1, ay1) <= 1.01 + 1e-9 THEN (least(greatest(ax0, ax1), 1.0) - least(ax0, ax1, 1.0)) * (least(greatest(ay0, ay1), 1.0) - least(ay0, ay1, 1.0)) END AS page_area
FROM b
""")  # fmt: skip
def box_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.abs(F.element_at("embedding", i + 1).cast("double")) * 4 for i in range(8)]
    a, b = G.box(*e[:4]), G.box(*e[4:])
    page = G.page_box(*(x * 8 for x in e[:4]), F.lit(8.0), F.lit(8.0))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", G.box_problem(a).alias("problem"), G.area(a).alias("area"), G.area(G.union(a, b)).alias("union_area"), G.meet(a, b).alias("meeting"),
        G.placed_problem(F.when(F.col("vec_id") % 9 == 0, -1).otherwise(1), a).alias("placed_problem"), G.area(page).alias("page_area"),
    )


@query("token_checks", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 3 THEN 'missing' WHEN l_linenumber > l_suppkey % 7 + 3 THEN 'reversed' WHEN l_discount > 0.09 THEN 'confidence' END AS problem,
  CASE WHEN l_partkey % 5 * 90 > 270 THEN 'rotation' END AS page_problem, CASE WHEN l_partkey % 5 IN (1, 3) THEN 7.0 ELSE l_quantity END AS shown_width
FROM lineitem
""")  # fmt: skip
def token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, turn = table(spark, sf_dir, "lineitem"), (F.col("l_partkey") % 5 * 90).cast("int")
    start = F.when(F.col("l_quantity") >= 3, F.col("l_linenumber"))
    confidence = F.when(F.col("l_discount") > 0.09, F.col("l_discount") + 1).otherwise(F.col("l_discount"))
    problem = G.token_problem(start, F.col("l_suppkey") % 7 + 3, confidence)
    return rows.select("l_orderkey", "l_linenumber", problem.alias("problem"), G.turn_problem(turn).alias("page_problem"), G.shown_size(F.col("l_quantity"), F.lit(7.0), turn)["width"].alias("shown_width"))
