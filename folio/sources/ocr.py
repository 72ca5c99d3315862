"""Recognition results as tokens: document_id, page_index, line, ord, word, x0, y0, x1, y1, confidence.

Each reader takes rows (document_id, payload), the payload being a service's JSON, and gives tokens with boxes as shares of
the page, and refusals (document_id, reason).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T

LAYOUT = """pages array<struct<pageNumber:int,angle:double,width:double,height:double,words:array<struct<content:string,polygon:array<double>,confidence:double,span:struct<offset:int,length:int>>>,
  lines:array<struct<content:string,spans:array<struct<offset:int,length:int>>>>,spans:array<struct<offset:int,length:int>>>>, content string,
  tables array<struct<rowCount:int,columnCount:int,boundingRegions:array<struct<pageNumber:int>>,spans:array<struct<offset:int,length:int>>,cells:array<struct<rowIndex:int,columnIndex:int,rowSpan:int,columnSpan:int,content:string,spans:array<struct<offset:int,length:int>>>>>>"""
VISION = """fullTextAnnotation struct<pages:array<struct<width:double,height:double,blocks:array<struct<paragraphs:array<struct<words:array<struct<confidence:double,
  boundingBox:struct<vertices:array<struct<x:double,y:double>>,normalizedVertices:array<struct<x:double,y:double>>>,symbols:array<struct<text:string,property:struct<detectedBreak:struct<type:string>>>>>>>>>>>>>, error struct<code:int,message:string>"""
LINES = """errorCode int, result struct<dataInfo:struct<type:string,width:double,height:double,pages:array<struct<width:double,height:double>>>,ocrResults:array<struct<prunedResult:struct<rec_texts:array<string>,rec_boxes:array<array<double>>,
  rec_scores:array<double>,doc_preprocessor_res:struct<angle:int>>>>>"""
#: Breaks that end a line, and the service's codes.
LINE_ENDS = ("EOL_SURE_SPACE", "LINE_BREAK")
CODES = {3: "corrupt", 9: "corrupt", 7: "auth", 16: "auth", 8: "rate_limit"}


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Payloads parsed once: a generated row stands between the parser and its readers, or Spark would write the parser into each of their conditions."""
    return rows.select("document_id", F.explode(F.array(F.from_json("payload", f"struct<{fields(schema)}>"))).alias("_r"))


def fields(schema: str) -> str:
    """A list of columns as the fields of a struct: the first blank of each becomes a colon."""
    out, depth, name = [], 0, True
    for c in " ".join(schema.split()):
        depth += (c == "<") - (c == ">")
        if depth == 0 and c == ",":
            name = True
        elif depth == 0 and c == " " and name and out and out[-1] != ",":
            out.append(":")
            name = False
            continue
        if c != " ":
            out.append(c)
    return "".join(out)


def shares(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> dict[str, Column]:
    """Sorted corners as shares of the page; one too far outside is null."""
    return {"x0": T.normalized(F.least(x0, x1), width), "y0": T.normalized(F.least(y0, y1), height), "x1": T.normalized(F.greatest(x0, x1), width), "y1": T.normalized(F.greatest(y0, y1), height)}


def outside(numbers: Column, width: Column, height: Column) -> Column:
    """Whether corners given as x, y, x, y, ... are none, or one is missing or too far outside the page. A box is outside when a corner is."""
    far = F.filter(numbers, lambda v, i: F.coalesce(T.beyond(v / F.when(i % 2 == 0, width).otherwise(height)), F.lit(True)))
    return (F.coalesce(F.size(numbers), F.lit(0)) < 2) | (F.size(far) > 0)


def polygon_box(polygon: Column, width: Column, height: Column) -> dict[str, Column]:
    """The box around a polygon given as x, y, x, y, ..., in shares of the page."""
    xs, ys = F.filter(polygon, lambda _, i: i % 2 == 0), F.filter(polygon, lambda _, i: i % 2 == 1)
    return shares(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width, height)


def some(items: Column | str, holds: Callable[[Column], Column]) -> Column:
    """Whether an item is so; of no list none is."""
    return F.coalesce(F.exists(items, lambda x: F.coalesce(holds(x), F.lit(False))), F.lit(False))


def layout_reason() -> Column:
    """Why a layout analysis is refused whole, the first that holds, or null: no pages for its text; words that overlap or go back;
    boxes outside their page; a table or cell without a place in the text; a table on a page that wasn't given.
    """
    r = F.col("_r")
    words = F.flatten(F.filter(F.transform(r["pages"], lambda p: p["words"]), lambda w: w.isNotNull()))
    at = F.struct(F.lit(0).alias("end"), F.lit(False).alias("back"))
    step = lambda a, w: F.struct((w["span"]["offset"] + w["span"]["length"]).alias("end"), (a["back"] | (w["span"]["offset"] < a["end"])).alias("back"))
    back = F.coalesce(F.aggregate(words, at, step)["back"], F.lit(False))
    beyond = some(r["pages"], lambda p: some(p["words"], lambda w: outside(w["polygon"], p["width"], p["height"])))
    unplaced = lambda x: F.coalesce(F.size(x["spans"]), F.lit(0)) < 1
    numbers = F.transform(r["pages"], lambda p: p["pageNumber"])
    astray = some(r["tables"], lambda t: ~F.coalesce(F.array_contains(numbers, F.get(t["boundingRegions"], F.lit(0))["pageNumber"]), F.lit(False)))
    none = (F.coalesce(F.size(r["pages"]), F.lit(0)) < 1) & (F.coalesce(F.length(r["content"]), F.lit(0)) > 0)
    return (
        F.when(r.isNull(), "not_json").when(none, "empty_result").when(back, "invalid_order").when(beyond, "outside_page")
        .when(some(r["tables"], unplaced), "table_without_span").when(some(r["tables"], lambda t: some(t["cells"], unplaced)), "cell_without_span").when(astray, "table_page")
    )


def layout_refusals(rows: DataFrame) -> DataFrame:
    """Refused layout analyses: document_id, reason."""
    return parsed(rows, LAYOUT).select("document_id", layout_reason().alias("reason")).where("reason IS NOT NULL")


def _layouts(rows: DataFrame, whole: bool) -> DataFrame:
    got = parsed(rows, LAYOUT)
    return got.where(layout_reason().isNull()) if whole else got


def layout_tokens(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Words of a layout analysis; a word's line is the one whose span holds it. With `whole`, a refused answer gives none."""
    # Of a page only what each of its words needs goes along, or every word would carry all.
    page = _layouts(rows, whole).select("document_id", F.posexplode("_r.pages").alias("page_index", "_p"))
    page = page.select("document_id", "page_index", F.col("_p.lines").alias("_lines"), F.col("_p.width").alias("_width"), F.col("_p.height").alias("_height"), F.col("_p.words").alias("_words"))
    word = page.select("document_id", "page_index", "_lines", "_width", "_height", F.posexplode("_words").alias("ord", "_w"))
    line = F.array_position(F.transform("_lines", lambda x: F.exists(x["spans"], lambda s: (s["offset"] <= F.col("_w.span.offset")) & (F.col("_w.span.offset") < s["offset"] + s["length"]))), True) - 1
    box = polygon_box(F.col("_w.polygon"), F.col("_width"), F.col("_height"))
    return word.select("document_id", "page_index", F.greatest(F.coalesce(line, F.lit(0)), F.lit(0)).alias("line"), "ord", F.col("_w.content").alias("word"), *(c.alias(n) for n, c in box.items()), F.col("_w.confidence").alias("confidence"), F.col("_w.span.offset").alias("span_start"))


def layout_pages(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Page spans of a layout analysis: a page ends where the next begins, the last with the text."""
    page = _layouts(rows, whole).select("document_id", F.length("_r.content").alias("_n"), F.posexplode("_r.pages").alias("page_index", "_p"))
    start = page.withColumn("span_start", F.get("_p.spans", F.lit(0))["offset"])
    after = F.lead("span_start").over(Window.partitionBy("document_id").orderBy("page_index"))
    return start.select("document_id", "page_index", "span_start", F.coalesce(after, F.col("_n")).alias("span_end"), F.col("_p.width").alias("width"), F.col("_p.height").alias("height"))


def layout_cells(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Table cells: document_id, table, page_index (of the table's first region), row, col, row_span, col_span, content, refusal (a cell without a place in the text)."""
    tables = _layouts(rows, whole).select("document_id", F.transform("_r.pages", lambda p: p["pageNumber"]).alias("_numbers"), F.posexplode("_r.tables").alias("table", "_t"))
    place = F.array_position("_numbers", F.get("_t.boundingRegions", F.lit(0))["pageNumber"])
    cells = tables.select("document_id", "table", F.when(place > 0, (place - 1).cast("int")).alias("page_index"), F.explode("_t.cells").alias("_c"))
    lost = F.coalesce(F.size("_c.spans"), F.lit(0)) < 1
    return cells.select("document_id", "table", "page_index", F.col("_c.rowIndex").alias("row"), F.col("_c.columnIndex").alias("col"), F.coalesce("_c.rowSpan", F.lit(1)).alias("row_span"), F.coalesce("_c.columnSpan", F.lit(1)).alias("col_span"), F.col("_c.content").alias("content"), F.when(lost, "cell_without_span").alias("refusal"))


def clashes(cells: DataFrame) -> DataFrame:
    """Grid places that more than one cell of a table covers."""
    at = cells.select("document_id", "table", F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("row"), "col", "col_span")
    at = at.select("document_id", "table", "row", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("col"))
    return at.groupBy("document_id", "table", "row", "col").count().where("count > 1").drop("count")


def vision_outside(word: Column, page: Column) -> Column:
    """The same of a word's corners."""
    flat = lambda corners: F.flatten(F.transform(corners, lambda v: F.array(F.coalesce(v["x"], F.lit(0.0)), F.coalesce(v["y"], F.lit(0.0)))))
    box = word["boundingBox"]
    plain = F.coalesce(F.size(box["vertices"]), F.lit(0)) > 0
    return F.when(plain, outside(flat(box["vertices"]), page["width"], page["height"])).otherwise(outside(flat(box["normalizedVertices"]), F.lit(1.0), F.lit(1.0)))


def vision_box(word: Column, width: Column, height: Column) -> dict[str, Column]:
    """A word's box: its corners in the page's units or, without them, in shares; a coordinate that is left out is zero."""
    box = word["boundingBox"]
    plain = F.coalesce(F.size(box["vertices"]), F.lit(0)) > 0
    corners = F.when(plain, box["vertices"]).otherwise(box["normalizedVertices"])
    along = lambda c: F.transform(corners, lambda v: F.coalesce(v[c], F.lit(0.0)))
    unit = lambda n: F.when(plain, n).otherwise(F.lit(1.0))
    return shares(F.array_min(along("x")), F.array_min(along("y")), F.array_max(along("x")), F.array_max(along("y")), unit(width), unit(height))


def vision_tokens(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Words of a text annotation: a line ends with a word that breaks it and with its paragraph. With `whole`, a refused answer gives none."""
    got = parsed(rows, VISION)
    page = (got.where(vision_reason().isNull()) if whole else got).select("document_id", F.posexplode("_r.fullTextAnnotation.pages").alias("page_index", "_p"))
    flat = lambda lists: F.flatten(F.filter(lists, lambda x: x.isNotNull()))

    def ended(words: Column) -> Column:
        """A paragraph's words, each with whether its line ends there."""
        breaks = lambda w: F.coalesce(F.get(w["symbols"], F.size(w["symbols"]) - 1)["property"]["detectedBreak"]["type"].isin(*LINE_ENDS), F.lit(False))
        return F.transform(words, lambda w, i: F.struct(w.alias("w"), (breaks(w) | (i == F.size(words) - 1)).alias("ends")))

    # A page's words stand in one list that is cut where lines end, so a page is walked once and nothing is shuffled. Generated rows keep lists from being made again.
    listed = flat(F.transform("_p.blocks", lambda b: flat(F.transform(b["paragraphs"], lambda g: ended(g["words"])))))
    page = page.select("document_id", "page_index", F.explode(F.array(F.struct("_p.width", "_p.height", listed.alias("words")))).alias("_x")).select("document_id", "page_index", "_x.*")
    stops = F.filter(F.transform("words", lambda x, i: F.when(x["ends"], i)), lambda i: i.isNotNull())
    page = page.select("document_id", "page_index", F.explode(F.array(F.struct("width", "height", "words", stops.alias("stops")))).alias("_x")).select("document_id", "page_index", "_x.*")
    begin = lambda k: F.coalesce(F.get("stops", k - 1) + 1, F.lit(0))
    lines = F.transform("stops", lambda stop, k: F.struct(begin(k).alias("first"), F.slice("words", begin(k) + 1, stop - begin(k) + 1).alias("words")))
    line = page.select("document_id", "page_index", "width", "height", F.posexplode(lines).alias("line", "_l"))
    word = line.select("document_id", "page_index", "width", "height", "line", F.col("_l.first").alias("_first"), F.posexplode(F.transform("_l.words", lambda x: x["w"])).alias("_i", "_w"))
    box = vision_box(F.col("_w"), F.col("width"), F.col("height"))
    text = F.array_join(F.transform("_w.symbols", lambda s: s["text"]), "")
    return word.select("document_id", "page_index", F.col("line").cast("long").alias("line"), (F.col("_first") + F.col("_i")).alias("ord"), text.alias("word"), *(c.alias(n) for n, c in box.items()), F.col("_w.confidence").alias("confidence"))


def vision_reason() -> Column:
    """Why a text annotation is refused whole, the first that holds, or null: what the service says; no word; a word without a box, or with one outside its page."""
    code = F.col("_r.error.code")
    said = F.lit("service")
    for number, name in CODES.items():
        said = F.when(code == number, name).otherwise(said)
    pages = F.col("_r.fullTextAnnotation.pages")
    word = lambda holds: some(pages, lambda p: some(p["blocks"], lambda b: some(b["paragraphs"], lambda g: some(g["words"], lambda w: holds(w, p)))))
    corners = lambda w: F.greatest(*(F.coalesce(F.size(w["boundingBox"][x]), F.lit(0)) for x in ("vertices", "normalizedVertices")))
    return (
        F.when(F.col("_r").isNull(), "not_json").when(F.coalesce(code, F.lit(0)) != 0, said).when(~word(lambda w, p: F.lit(True)), "empty_result")
        .when(word(lambda w, p: corners(w) < 1), "word_without_box").when(word(vision_outside), "outside_page")
    )


def vision_refusals(rows: DataFrame) -> DataFrame:
    """Refused text annotations: document_id, reason."""
    return parsed(rows, VISION).select("document_id", vision_reason().alias("reason")).where("reason IS NOT NULL")


def uneven(page: Column) -> Column:
    """Whether a page's texts, boxes and scores differ in number."""
    n = [F.coalesce(F.size(page["prunedResult"][x]), F.lit(0)) for x in ("rec_texts", "rec_boxes", "rec_scores")]
    return (n[0] != n[1]) | (n[0] != n[2])


def page_sizes() -> Column:
    """A size for each page; an image has one page and says its size at the top."""
    info = F.col("_r.result.dataInfo")
    return F.when(info["type"] == "image", F.array(F.struct(info["width"].alias("width"), info["height"].alias("height")))).otherwise(info["pages"])


def upright(size: Column, angle: Column) -> tuple[Column, Column]:
    """Width and height of the page that boxes are measured on: it was turned upright before."""
    turned = F.coalesce(angle.isin(90, 270), F.lit(False))
    return F.when(turned, size["height"]).otherwise(size["width"]), F.when(turned, size["width"]).otherwise(size["height"])


def line_reason() -> Column:
    """Why recognised lines are refused whole, the first that holds, or null."""
    r, sizes = F.col("_r.result"), page_sizes()
    pages = F.coalesce(F.size(r["ocrResults"]), F.lit(0))

    def beyond(page: Column) -> Column:
        o = page["o"]["prunedResult"]
        width, height = upright(page["s"], o["doc_preprocessor_res"]["angle"])
        return some(o["rec_boxes"], lambda b: (F.size(b) < 4) | outside(b, width, height))

    both = F.arrays_zip(r["ocrResults"].alias("o"), sizes.alias("s"))
    return (
        F.when(F.col("_r").isNull(), "not_json").when(F.coalesce(F.col("_r.errorCode"), F.lit(0)) != 0, "service").when(pages < 1, "empty_result")
        .when(pages != F.coalesce(F.size(sizes), F.lit(0)), "page_count").when(some(r["ocrResults"], uneven), "uneven_page")
        .when(~some(r["ocrResults"], lambda p: F.size(p["prunedResult"]["rec_texts"]) > 0), "empty_result").when(some(both, beyond), "outside_page")
    )


def line_refusals(rows: DataFrame) -> DataFrame:
    """Why recognised lines are refused: document_id, reason. An answer is taken whole or not at all."""
    return parsed(rows, LINES).select("document_id", line_reason().alias("reason")).where("reason IS NOT NULL")


def line_tokens(rows: DataFrame) -> DataFrame:
    """One token for each recognised line, and the angle by which a viewer turns the page back; none of a refused answer."""
    both = F.arrays_zip(F.col("_r.result.ocrResults").alias("o"), page_sizes().alias("s"))
    page = parsed(rows, LINES).where(line_reason().isNull()).select("document_id", F.posexplode(both).alias("page_index", "_p"))
    page = page.select("document_id", "page_index", F.col("_p.o.prunedResult").alias("_o"), F.coalesce("_p.o.prunedResult.doc_preprocessor_res.angle", F.lit(0)).alias("angle"), F.col("_p.s").alias("_s"))
    width, height = upright(F.col("_s"), F.col("angle"))
    line = page.select("document_id", "page_index", "angle", width.alias("width"), height.alias("height"), F.posexplode(F.arrays_zip("_o.rec_texts", "_o.rec_boxes", "_o.rec_scores")).alias("line", "_l"))
    b = F.col("_l.rec_boxes")
    box = shares(b[0], b[1], b[2], b[3], F.col("width"), F.col("height"))
    return line.select("document_id", "page_index", "line", F.lit(0).alias("ord"), F.col("_l.rec_texts").alias("word"), *(c.alias(n) for n, c in box.items()), F.col("_l.rec_scores").alias("confidence"), T.quarter_turn(F.col("angle")).alias("viewer_angle"))
