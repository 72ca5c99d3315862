"""Queries on recognition services' answers: each document's words as the three services would give them, some answers wrong.

Ten words are a line and five lines a page of 1000 x 100, whose words stand 100 apart. An answer's kind is doc_id % 17.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.plans.tables import table
from folio.sources import ocr

#: Words with their places: k (document), kind, i, page, line, place, start, word.
WORDS = r"""texts AS (SELECT doc_id AS k, doc_id % 17 AS kind, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
flat AS (SELECT k, kind, unnest(range(len(words))) AS i, unnest(words) AS word FROM texts),
w AS (SELECT k, kind, i, i // 50 AS page, (i % 50) // 10 AS line, i % 10 AS place, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM flat),
n AS (SELECT k, kind, len(words) AS n, list_sum([length(x) + 1 FOR x IN words])::BIGINT - 1 AS chars FROM texts)"""


#: Words of a line, and of a page.
LINE_WORDS, PAGE_WORDS = 10, 50


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words as a list: document_id, kind, _w. A payload is made within its row, so no word is shuffled."""
    listed = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 17).alias("kind"), listed.alias("_w"))


def cut(n: Column, size: int, make: Callable[[Column], Column]) -> Column:
    """What is made of the places 0, size, 2 * size ... before n, or null if there is none."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), make))


def starts(lengths: pa.ListArray) -> pa.ListArray:
    """Where each word begins in its text, words standing a space apart."""
    each, ends = lengths.flatten().to_numpy() + 1, lengths.offsets.to_numpy().astype(np.int32)
    ends = ends - ends[0]
    before = np.concatenate(([0], np.cumsum(each, dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))).astype(np.int32)))


def span(start: Column, length: Column) -> Column:
    return F.struct(start.cast("int").alias("offset"), length.cast("int").alias("length"))


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, n = F.col("kind"), F.size("_w")

    @F.arrow_udf("array<int>")
    def begun(lengths: pa.Array) -> pa.Array:
        return starts(lengths)

    docs = words(spark, sf_dir)
    docs = docs.withColumn("_s", begun(F.transform("_w", lambda w: F.length(w))))

    # Kind 3: every word begins where the text does. Kind 5: every word stands a page's width to the right.
    def start(i: Column) -> Column:
        return F.when(kind == 3, 0).otherwise(F.get("_s", i))

    def word(text: Column, i: Column, at: Column) -> Column:
        x, y = i % LINE_WORDS * 100.0, F.floor(i / LINE_WORDS) * 20.0
        x = F.when(kind == 5, x + 1100).otherwise(x)
        return F.struct(text.alias("content"), F.array(x, y, x + 90, y, x + 90, y + 10, x, y + 10).alias("polygon"), F.lit(0.5).alias("confidence"), span(start(at + i), F.length(text)).alias("span"))

    def line_span(at: Column, end: Column) -> Column:
        return span(start(at), start(end - 1) + F.length(F.get("_w", end - 1)) - start(at))

    def line(at: Column) -> Column:
        end = F.least(at + LINE_WORDS, n)
        return F.struct(F.array_join(F.slice("_w", at + 1, F.lit(LINE_WORDS)), " ").alias("content"), F.array(line_span(at, end)).alias("spans"))

    def page(at: Column) -> Column:
        return F.struct(
            (at / PAGE_WORDS * 2 + 1).cast("int").alias("pageNumber"), F.lit(1000.0).alias("width"), F.lit(100.0).alias("height"), F.transform(F.slice("_w", at + 1, F.lit(PAGE_WORDS)), lambda w, i: word(w, i, at)).alias("words"),
            cut(F.least(n - at, F.lit(PAGE_WORDS)), LINE_WORDS, lambda i: line(at + i)).alias("lines"), F.array(line_span(at, F.least(at + LINE_WORDS, n))).alias("spans"),
        )

    # Each document has a table on its last page, a wide cell over a row of two. Kinds 8, 9, 10: it, or its second cell, has no span, or its page isn't there.
    place = F.array(span(F.lit(0), F.lit(1)))
    none = F.filter(place, lambda _: F.lit(False))
    cell = lambda r, c, wide, spans: F.struct(F.lit(r).alias("rowIndex"), F.lit(c).alias("columnIndex"), F.lit(wide).alias("columnSpan"), F.concat(F.lit("c"), F.col("document_id").cast("string")).alias("content"), spans.alias("spans"))
    cells = F.array(cell(0, 0, 2, place), cell(1, 0, None, F.when(kind == 9, none).otherwise(place)), cell(1, 1, None, place))
    region = F.struct(F.when(kind == 10, 2).otherwise(F.floor((n - 1) / PAGE_WORDS) * 2 + 1).alias("pageNumber"))
    tables = F.when(n > 0, F.array(F.struct(F.array(region).alias("boundingRegions"), F.when(kind == 8, none).otherwise(place).alias("spans"), cells.alias("cells"))))
    # Kind 7: the text without its pages.
    content = F.when(n > 0, F.array_join("_w", " "))
    return docs.select("document_id", F.to_json(F.struct(content.alias("content"), F.when(kind != 7, cut(n, PAGE_WORDS, page)).alias("pages"), F.when(kind != 7, tables).alias("tables"))).alias("payload"))


BAD_LAYOUT = "kind IN (3, 5, 7, 8, 9, 10)"


@query("layout_words", f"""
WITH {WORDS} SELECT w.k AS document_id, page::INT AS page_index, line::INT AS line, (i % 50)::INT AS ord, word, place * 100.0::DOUBLE / 1000 AS x0, line * 20.0::DOUBLE / 100 AS y0, (place * 100.0::DOUBLE + 90) / 1000 AS x1, (line * 20.0::DOUBLE + 10) / 100 AS y1, 0.5::DOUBLE AS confidence, start::INT AS span_start
FROM w JOIN n USING (k) WHERE NOT (w.{BAD_LAYOUT}) OR (w.kind = 3 AND n.n = 1)""")
def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of layout analyses that are taken, with lines, boxes and places."""
    return ocr.layout_tokens(layouts(spark, sf_dir), whole=True)


@query("layout_page_spans", f"""
WITH {WORDS} SELECT k AS document_id, page::INT AS page_index, start::INT AS span_start, coalesce(lead(start) OVER (PARTITION BY k ORDER BY i), chars)::INT AS span_end, 1000.0::DOUBLE AS width, 100.0::DOUBLE AS height
FROM w JOIN n USING (k, kind) WHERE i % 50 = 0 AND (NOT ({BAD_LAYOUT}) OR (kind = 3 AND n = 1))""")
def layout_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of layout analyses: each ends where the next begins."""
    return ocr.layout_pages(layouts(spark, sf_dir), whole=True)


@query("layout_table_cells", f"""
WITH {WORDS} SELECT k AS document_id, 0 AS "table", ((n - 1) // 50)::INT AS page_index, r AS "row", c AS col, 1 AS row_span, s AS col_span, 'c' || k AS content, NULL::VARCHAR AS refusal
FROM n, (VALUES (0, 0, 2), (1, 0, 1), (1, 1, 1)) AS g(r, c, s) WHERE n > 0 AND (NOT ({BAD_LAYOUT}) OR (kind = 3 AND n = 1))""")
def layout_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of layout analyses' tables, on the page that the table's region names."""
    return ocr.layout_cells(layouts(spark, sf_dir), whole=True)


@query("layout_refusals", f"""
WITH {WORDS} SELECT k AS document_id, CASE kind WHEN 3 THEN 'invalid_order' WHEN 5 THEN 'outside_page' WHEN 7 THEN 'empty_result' WHEN 8 THEN 'table_without_span' WHEN 9 THEN 'cell_without_span' ELSE 'table_page' END AS reason
FROM n WHERE n > 0 AND {BAD_LAYOUT} AND NOT (kind = 3 AND n = 1)""")
def layout_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout analyses that are refused, and why."""
    return ocr.layout_refusals(layouts(spark, sf_dir))


#: Words of a paragraph: two lines.
PARAGRAPH_WORDS = 20


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines a paragraph; the first ends by a break, the second with its paragraph. Odd documents have boxes in shares."""
    kind, n = F.col("kind"), F.size("_w")
    # A zero coordinate is left out, as the service does.
    some = lambda c: F.when(c != 0, c)
    odd = F.col("document_id") % 2 == 1

    def word(text: Column, i: Column) -> Column:
        x, y = i % LINE_WORDS * 100.0, F.floor(i / LINE_WORDS) * 20.0
        x = F.when(kind == 5, x + 1100).otherwise(x)
        corners = lambda sx, sy: F.array(F.struct(some(x / sx).alias("x"), some(y / sy).alias("y")), F.struct(((x + 90) / sx).alias("x"), ((y + 10) / sy).alias("y")))
        box = F.struct(F.when(~odd & (kind != 6), corners(1.0, 1.0)).alias("vertices"), F.when(odd & (kind != 6), corners(1000.0, 100.0)).alias("normalizedVertices"))
        end = F.when(i % PARAGRAPH_WORDS == LINE_WORDS - 1, F.lit("EOL_SURE_SPACE")).otherwise(F.lit("SPACE"))
        last = F.struct(F.struct(end.alias("type")).alias("detectedBreak"))
        symbols = F.transform(F.split(text, ""), lambda c, k: F.struct(c.alias("text"), F.when(k == F.length(text) - 1, last).alias("property")))
        return F.struct(F.lit(0.25).alias("confidence"), box.alias("boundingBox"), symbols.alias("symbols"))

    def block(at: Column, i: Column) -> Column:
        """The block of a page's words from i on; the page begins at word `at`."""
        own = F.slice("_w", at + i + 1, F.least(F.lit(PARAGRAPH_WORDS), PAGE_WORDS - i))
        return F.struct(F.array(F.struct(F.transform(own, lambda w, k: word(w, i + k)).alias("words"))).alias("paragraphs"))

    def page(at: Column) -> Column:
        return F.struct(F.lit(1000.0).alias("width"), F.lit(100.0).alias("height"), cut(F.least(n - at, F.lit(PAGE_WORDS)), PARAGRAPH_WORDS, lambda i: block(at, i)).alias("blocks"))

    code = F.when(kind == 9, 16).when(kind == 10, 8).when(kind == 11, 3).when(kind == 12, 2)
    answer = F.struct(F.struct(cut(n, PAGE_WORDS, page).alias("pages")).alias("fullTextAnnotation"), F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit("refused").alias("message"))).alias("error"))
    return words(spark, sf_dir).select("document_id", F.to_json(answer).alias("payload"))


@query("annotated_words", f"""
WITH {WORDS} SELECT k AS document_id, page::INT AS page_index, line::BIGINT AS line, (i % 50)::INT AS ord, word, place * 100.0::DOUBLE / 1000 AS x0, line * 20.0::DOUBLE / 100 AS y0, (place * 100.0::DOUBLE + 90) / 1000 AS x1, (line * 20.0::DOUBLE + 10) / 100 AS y1, 0.25::DOUBLE AS confidence
FROM w WHERE kind NOT IN (5, 6, 9, 10, 11, 12)""")
def annotated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of text annotations: symbols joined, lines ended by breaks and paragraphs, boxes in units or shares."""
    return ocr.vision_tokens(annotations(spark, sf_dir), whole=True)


@query("annotation_refusals", f"""
WITH {WORDS} SELECT k AS document_id, CASE WHEN kind = 9 THEN 'auth' WHEN kind = 10 THEN 'rate_limit' WHEN kind = 11 THEN 'corrupt' WHEN kind = 12 THEN 'service' WHEN n = 0 THEN 'empty_result' WHEN kind = 6 THEN 'word_without_box' ELSE 'outside_page' END AS reason
FROM n WHERE n = 0 OR kind IN (5, 6, 9, 10, 11, 12)""")
def annotation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text annotations that are refused, and why."""
    return ocr.vision_refusals(annotations(spark, sf_dir))


#: Words by one space: up to fifty are a page, up to ten a line.
PAGE, LINE = (rf"(?:[^ ]++ ){{0,{n - 1}}}[^ ]++" for n in (50, 10))


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's lines. Documents of kind 1 have sideways pages, whose sizes are given as they lay; those of kind 2 have an angle that is no quarter turn."""
    kind = F.col("kind")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 17).alias("kind"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).alias("_text"))
    of = docs.select("document_id", "kind", F.regexp_extract_all("_text", F.lit(PAGE), F.lit(0)).alias("_pages"))

    def line(text: Column, i: Column) -> Column:
        y = i * 20.0 + F.when(kind == 5, 200.0).otherwise(0.0)
        return F.struct(text.alias("text"), F.array(F.lit(0.0), y, F.size(F.split(text, " ")) * 100.0, y + 10).alias("box"))

    of = of.withColumn("lists", F.transform("_pages", lambda p: F.transform(F.regexp_extract_all(p, F.lit(LINE), F.lit(0)), line)))
    angle = F.when(kind == 1, 90).when(kind == 2, 45).when(kind == 4, 180)

    def page(lines: Column) -> Column:
        boxes = F.transform(lines, lambda a: a["box"])
        return F.struct(F.struct(
            F.transform(lines, lambda a: a["text"]).alias("rec_texts"), F.when(kind == 6, F.slice(boxes, 1, F.size(boxes) - 1)).otherwise(boxes).alias("rec_boxes"), F.transform(lines, lambda a: F.lit(0.75)).alias("rec_scores"),
            F.when(angle.isNotNull(), F.struct(angle.alias("angle"))).alias("doc_preprocessor_res"),
        ).alias("prunedResult"))

    pages = of.withColumn("pages", F.transform("lists", page))
    size = F.struct(F.when(kind == 1, 100.0).otherwise(1000.0).alias("width"), F.when(kind == 1, 1000.0).otherwise(100.0).alias("height"))
    sizes = F.transform("pages", lambda p: size)
    # Kind 0: one page says its size as an image does. Kind 8: a size more than pages. Kind 9: the service failed.
    image = (kind == 0) & (F.size("pages") == 1)
    info = F.struct(F.when(image, "image").otherwise("pdf").alias("type"), F.when(image, 1000.0).alias("width"), F.when(image, 100.0).alias("height"), F.when(kind == 8, F.concat(sizes, F.array(size))).when(~image, sizes).alias("pages"))
    return pages.select("document_id", F.to_json(F.struct(F.when(kind == 9, 500).otherwise(0).alias("errorCode"), F.struct(info.alias("dataInfo"), F.col("pages").alias("ocrResults")).alias("result"))).alias("payload"))


@query("recognised_lines", f"""
WITH {WORDS} SELECT k AS document_id, page::INT AS page_index, line::INT AS line, 0 AS ord, string_agg(word, ' ' ORDER BY i) AS word, 0.0::DOUBLE AS x0, line * 20.0::DOUBLE / 100 AS y0, count(*) * 100.0::DOUBLE / 1000 AS x1, (line * 20.0::DOUBLE + 10) / 100 AS y1, 0.75::DOUBLE AS confidence, CASE kind WHEN 1 THEN 270 WHEN 4 THEN 180 ELSE 0 END AS viewer_angle
FROM w WHERE kind NOT IN (5, 6, 8, 9) GROUP BY k, kind, page, line""")
def recognised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token for each recognised line, on pages turned upright."""
    return ocr.line_tokens(recognised(spark, sf_dir))


@query("recognition_refusals", f"""
WITH {WORDS} SELECT k AS document_id, CASE WHEN kind = 9 THEN 'service' WHEN n = 0 THEN 'empty_result' WHEN kind = 8 THEN 'page_count' WHEN kind = 6 THEN 'uneven_page' ELSE 'outside_page' END AS reason
FROM n WHERE n = 0 OR kind IN (5, 6, 8, 9)""")
def recognition_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines that are refused, and why."""
    return ocr.line_refusals(recognised(spark, sf_dir))
