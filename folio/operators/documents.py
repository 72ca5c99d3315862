"""Documents as tables: tokens, pages and spans by document.

tokens(document_id, ord, page_index, line, word), pages(document_id, page_index, span_start, span_end), spans are
half-open ranges of code points.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import text as T


def tiles(docs: DataFrame, size: int) -> DataFrame:
    """Pages of `size` code points that tile each text; an empty text has one empty page."""
    last = F.greatest(F.ceil(F.length("text") / size) - 1, F.lit(0))
    start = F.col("page_index") * size
    pages = docs.select("document_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("page_index"))
    end = F.least(start + size, F.length("text").cast("long"))
    return pages.select("document_id", "page_index", start.alias("span_start"), end.alias("span_end"), F.substring(F.col("text"), (start + 1).cast("int"), F.lit(size)).alias("text"))


def built(words: DataFrame) -> DataFrame:
    """Token spans in the text that joins words by a space and ends lines with a line end.

    words(document_id, line, ord, word): empty words and lines without words are dropped.
    """
    by = Window.partitionBy("document_id").orderBy("line", "ord")
    rows = words.where("word <> ''").withColumn("_size", F.length("word") + 1)
    end = F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("document_id", "line", "ord", "word", (end - F.col("_size")).alias("span_start"), (end - 1).alias("span_end"))


def built_text(tokens: DataFrame) -> DataFrame:
    """The text of `built` tokens by document."""
    lines = tokens.groupBy("document_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("_l"))
    return lines.groupBy("document_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "_l"))), lambda x: x["_l"]), "\n"), F.lit("\n")).alias("text"))


def violations(tokens: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tokens out of bounds, out of order or overlapping the one before: document_id, span_start, reason."""
    by = Window.partitionBy("document_id").orderBy("ord")
    rows = tokens.join(lengths, "document_id").withColumn("_before", F.lag("span_end").over(by))
    reason = F.when((F.col("span_start") < 0) | (F.col("span_end") > F.col("length")) | (F.col("span_end") < F.col("span_start")), "bounds").when(F.col("span_start") < F.col("_before"), "order")
    return rows.select("document_id", "span_start", reason.alias("reason")).where("reason IS NOT NULL")


def tiling(pages: DataFrame, lengths: DataFrame) -> DataFrame:
    """Whether each document's pages ascend without gap and cover the text: document_id, pages, tiled."""
    by = Window.partitionBy("document_id").orderBy("page_index")
    rows = pages.withColumn("_ok", F.col("span_start") == F.coalesce(F.lag("span_end").over(by), F.lit(0)))
    sums = rows.groupBy("document_id").agg(F.count("*").alias("pages"), F.bool_and("_ok").alias("_ok"), F.max("span_end").alias("_end"), F.count_distinct("page_index").alias("_n"))
    return sums.join(lengths, "document_id").select("document_id", "pages", (F.col("_ok") & (F.col("_end") == F.col("length")) & (F.col("_n") == F.col("pages"))).alias("tiled"))


#: Characters of needles that a task looks for at once.
BLOCK = 1_000_000


def find(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """Every place of every needle in every text, a needle's next one behind the end of the last: document_id, needle_id, span_start, span_end.

    Needles are taken in blocks of some BLOCK characters, whatever their alphabet and size; a block is one pass over the texts, in which
    an automaton tells the needles that each text holds. Only these pairs are joined to the needles. Empty needles stand nowhere.
    """
    asked = needles.where("needle <> ''").select("needle_id", "needle")
    total = asked.agg(F.sum(F.length("needle").cast("long"))).first()[0] or 0
    many = -(-total // BLOCK)
    out = docs.sparkSession.createDataFrame([], f"document_id {docs.schema['document_id'].dataType.simpleString()}, needle_id {needles.schema['needle_id'].dataType.simpleString()}, span_start int, span_end int")
    for block in range(many):
        own = asked.where(F.pmod(F.xxhash64("needle"), F.lit(many)) == block).groupBy("needle").agg(F.collect_list("needle_id").alias("ids"))
        words = sorted(r[0] for r in own.select("needle").collect())
        if words:
            met = found(docs, words).join(own, "needle").select("document_id", F.explode("ids").alias("needle_id"), "span_start", "span_end")
            out = out.unionByName(met)
    return out


def found(docs: DataFrame, words: list[str]) -> DataFrame:
    """(document_id, needle, span_start, span_end) of the words in the texts."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            rows, starts, names = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                behind: dict[str, int] = {}
                for last, w in automaton.iter(text or ""):
                    at = last + 1 - len(w)
                    if at >= behind.get(w, 0):
                        behind[w] = last + 1
                        rows.append(i)
                        starts.append(at)
                        names.append(w)
            ids = batch.column("document_id").take(pa.array(rows, pa.int64()))
            ends = [a + len(w) for a, w in zip(starts, names, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["document_id", "needle", "span_start", "span_end"])

    schema = f"document_id {docs.schema['document_id'].dataType.simpleString()}, needle string, span_start int, span_end int"
    return docs.select("document_id", "text").mapInArrow(run, schema)


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether spans [a, b) and [c, d) share a place; an empty span shares none."""
    return (a < d) & (b > c) & (a < b) & (c < d)


def pages_for(spans: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """`spans` with the sorted indices of the pages they touch.

    Pages are at least `size` long but the last, so a span's pages are met through the `size` wide cells they share.
    """
    cells = lambda a, b: F.sequence(F.floor(a / size), F.greatest(F.floor((b - 1) / size), F.floor(a / size)))
    left = spans.withColumn("_cell", F.explode(cells(F.col("span_start"), F.col("span_end"))))
    right = pages.select("document_id", "page_index", F.col("span_start").alias("_a"), F.col("span_end").alias("_b")).withColumn("_cell", F.explode(cells(F.col("_a"), F.col("_b"))))
    met = left.join(right, ["document_id", "_cell"]).where(overlaps(F.col("span_start"), F.col("span_end"), F.col("_a"), F.col("_b")))
    return met.groupBy(*spans.columns).agg(F.array_sort(F.collect_set("page_index")).alias("pages"))


def sliced(tokens: DataFrame, start: int, end: int) -> DataFrame:
    """The tokens that lie wholly within [start, end), moved to begin at it; partly covered and empty ones drop."""
    inside = tokens.where((F.col("span_start") >= start) & (F.col("span_end") <= end) & (F.col("span_start") < F.col("span_end")))
    return inside.withColumns({"span_start": F.col("span_start") - start, "span_end": F.col("span_end") - start})


def merged(parts: DataFrame) -> DataFrame:
    """Where each part of a document begins in the text that joins them: document_id, part, offset, length."""
    by = Window.partitionBy("document_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("document_id", "part", F.coalesce(F.sum(F.length("text")).over(by), F.lit(0)).alias("offset"), F.length("text").alias("length"))


def token_at(spans: DataFrame, places: DataFrame) -> DataFrame:
    """The token that covers each place, or null: an as-of join by the last token that begins before it."""
    events = spans.select("document_id", F.col("span_start").alias("_at"), F.struct("span_start", "span_end").alias("_t"), F.lit(None).cast("long").alias("place"))
    events = events.unionByName(places.select("document_id", F.col("place").cast("long").alias("_at"), F.lit(None).cast(events.schema["_t"].dataType).alias("_t"), F.col("place").cast("long").alias("place")))
    by = Window.partitionBy("document_id").orderBy("_at", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_t", F.last("_t", ignorenulls=True).over(by)).where("place IS NOT NULL")
    covers = F.col("place") < F.col("_t.span_end")
    return rows.select("document_id", "place", F.when(covers, F.col("_t.span_start")).alias("span_start"), F.when(covers, F.col("_t.span_end")).alias("span_end"))


def text_layer(pages: DataFrame, least: int = 100, share: float = 0.5) -> DataFrame:
    """document_id, pages, bearing (pages with enough meaningful characters), usable."""
    sums = pages.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum((T.meaningful_length(F.col("text")) >= least).cast("long")).alias("bearing"))
    return sums.withColumn("usable", (F.col("bearing") >= F.col("pages") * share) & (F.col("bearing") > 0))


def parser_for(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """The parser of each document: the first available one that takes its type and supplies what it needs.

    registry(parser_id, media_types, supplies, available, priority) is a short list; docs(document_id, media_type, needs).
    An unusable text layer is a need like any other.
    """
    takers = registry.where("available").select("parser_id", "supplies", "priority", F.explode("media_types").alias("media_type"))
    met = docs.join(F.broadcast(takers), "media_type", "left").withColumn("_fits", F.size(F.array_except("needs", F.coalesce("supplies", F.array().cast("array<string>")))) == 0)
    best = F.min(F.when(F.col("parser_id").isNotNull() & F.col("_fits"), F.struct("priority", "parser_id")))
    return met.groupBy("document_id").agg(best["parser_id"].alias("parser_id")).withColumn("refusal", F.when(F.col("parser_id").isNull(), "no_parser"))


def grouped_chars(chars: DataFrame) -> DataFrame:
    """Words of characters in order: document_id, line, ord, word.

    chars(document_id, at, char): white space and control characters end a word, a line end ends the line, and U+FFFE is a
    hyphen that ends both.
    """
    by = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    soft = F.col("char") == "￾"
    gap = F.col("char").rlike(rf"\A[\p{{Cc}}{T.SPACE}]\z")
    rows = chars.select("document_id", "at", F.when(soft, "-").otherwise(F.col("char")).alias("char"), gap.alias("_gap"), (F.col("char").isin("\n") | soft).cast("int").alias("_line"), (gap | soft).cast("int").alias("_word"))
    rows = rows.withColumns({"line": F.coalesce(F.sum("_line").over(by), F.lit(0)), "_w": F.coalesce(F.sum("_word").over(by), F.lit(0))}).where("NOT _gap")
    words = rows.groupBy("document_id", "line", "_w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "char"))), lambda x: x["char"]), "").alias("word"))
    return words.select("document_id", "line", (F.row_number().over(Window.partitionBy("document_id", "line").orderBy("_w")) - 1).alias("ord"), "word")


def tokens_in(spans: DataFrame, tokens: DataFrame, width: int = 256) -> DataFrame:
    """The tokens that each span touches: the spans' columns, ord, token_start, token_end.

    A range join by cells of `width` code points: a span and a token meet in the cells that both touch, and count in the
    first of them.
    """
    cells = lambda a, b: F.sequence(F.floor(a / width), F.greatest(F.floor((b - 1) / width), F.floor(a / width)))
    left = spans.withColumn("_cell", F.explode(cells(F.col("span_start"), F.col("span_end"))))
    right = tokens.select("document_id", "ord", F.col("span_start").alias("token_start"), F.col("span_end").alias("token_end")).withColumn("_cell", F.explode(cells(F.col("token_start"), F.col("token_end"))))
    met = left.join(right, ["document_id", "_cell"]).where(overlaps(F.col("span_start"), F.col("span_end"), F.col("token_start"), F.col("token_end")))
    return met.where(F.col("_cell") == F.floor(F.greatest("span_start", "token_start") / width)).drop("_cell")


def page_references(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """Tokens whose page is missing or doesn't hold them: document_id, span_start, reason."""
    own = pages.select("document_id", "page_index", F.col("span_start").alias("_a"), F.col("span_end").alias("_b"))
    rows = tokens.join(own, ["document_id", "page_index"], "left")
    reason = F.when(F.col("_a").isNull(), "no_page").when((F.col("span_start") < F.col("_a")) | (F.col("span_end") > F.col("_b")), "outside_page")
    return rows.select("document_id", "span_start", reason.alias("reason")).where("reason IS NOT NULL")


def origins(parts: DataFrame) -> DataFrame:
    """Documents whose parts are out of order or overlap in the source: parts(document_id, part, origin_start, origin_end)."""
    before = F.lag("origin_end").over(Window.partitionBy("document_id").orderBy("part"))
    return parts.withColumn("_b", before).where(F.col("origin_start") < F.col("_b")).select("document_id").distinct()
