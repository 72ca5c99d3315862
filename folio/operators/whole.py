"""Whole documents as tables, cut and joined: texts, pages, tokens, blocks, tables, cells and origins at once.

A document's origin is a list of pieces of its source; laid end to end they are its text. That is a map from places to
source places, piece by piece: a slice keeps the part of the map that it covers, a merge lays maps end to end, so maps of slices of
merges of slices still lead to the first source. All spans are half-open.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.documents import overlaps
from folio.operators.parsing import original_places

PARTS = ("texts", "pages", "tokens", "blocks", "tables", "cells", "origin")


@dataclass
class Whole:
    """texts(document_id, text), pages(document_id, page_index, span_start, span_end, …), tokens(document_id, ord, span_start, span_end, …),
    blocks(document_id, block, span_start, span_end, …), tables(document_id, table, span_start, span_end, …), cells(document_id, table, row, col,
    span_start, span_end, …), origin(document_id, piece, origin_start, origin_end). Other columns are carried along; `table` and `block` are strings.
    """

    texts: DataFrame
    pages: DataFrame
    tokens: DataFrame
    blocks: DataFrame
    tables: DataFrame
    cells: DataFrame
    origin: DataFrame


def moved(rows: DataFrame, by: Column) -> DataFrame:
    return rows.withColumns({c: (F.col(c) + by).cast(rows.schema[c].dataType) for c in ("span_start", "span_end")})


def renamed(rows: DataFrame, key: str, *extra: str) -> DataFrame:
    """The rows as those of the document `key` names."""
    return rows.drop("document_id", *extra).withColumnRenamed(key, "document_id")


def cut_problems(whole: Whole, cuts: DataFrame) -> DataFrame:
    """Cuts that don't fit their document: slice_id, reason."""
    size = F.length("text")
    met = cuts.join(whole.texts, "document_id", "left")
    reason = F.when(F.col("text").isNull(), "unknown_document").when((F.col("cut_start") < 0) | (F.col("cut_end") > size) | (F.col("cut_start") > F.col("cut_end")), "bounds")
    return met.select("slice_id", reason.alias("reason")).where("reason IS NOT NULL")


def sliced(whole: Whole, cuts: DataFrame) -> Whole:
    """Slices as documents of their own: cuts(document_id, slice_id, cut_start, cut_end), those that fit.

    Pages are clipped and keep their number; tokens, blocks and tables stay if they are wholly inside, cells with their table; empty tokens go.
    """
    cuts = cuts.join(cut_problems(whole, cuts).select("slice_id"), "slice_id", "left_anti").select("document_id", "slice_id", "cut_start", "cut_end")
    extra = ("cut_start", "cut_end")
    start, end, a, b = F.col("cut_start"), F.col("cut_end"), F.col("span_start"), F.col("span_end")
    inside = (a >= start) & (b <= end)

    def kept(rows: DataFrame, where: Column) -> DataFrame:
        return rows.join(cuts, "document_id").where(where)

    texts = kept(whole.texts, F.lit(True)).withColumn("text", F.expr("substring(text, int(cut_start) + 1, int(cut_end - cut_start))"))
    pages = kept(whole.pages, overlaps(a, b, start, end))
    clipped = {c: (f(c, d) - start).cast(pages.schema[c].dataType) for c, d, f in (("span_start", "cut_start", F.greatest), ("span_end", "cut_end", F.least))}
    tables = kept(whole.tables, inside)
    cells = whole.cells.join(tables.select("document_id", "slice_id", "table", "cut_start"), ["document_id", "table"])
    places = cuts.select("document_id", start.alias("place_start"), end.alias("place_end")).distinct()
    pieces = original_places(whole.origin.withColumnRenamed("piece", "part"), places).withColumnRenamed("part", "piece")
    pieces = pieces.join(cuts.withColumnsRenamed({"cut_start": "place_start", "cut_end": "place_end"}), ["document_id", "place_start", "place_end"])
    return Whole(
        renamed(texts, "slice_id", *extra),
        renamed(pages.withColumns(clipped), "slice_id", *extra),
        renamed(moved(kept(whole.tokens, inside & (a < b)), -start), "slice_id", *extra),
        renamed(moved(kept(whole.blocks, inside), -start), "slice_id", *extra),
        renamed(moved(tables, -start), "slice_id", *extra),
        renamed(moved(cells, -start), "slice_id", *extra),
        pieces.select(F.col("slice_id").alias("document_id"), "piece", "origin_start", "origin_end"),
    )


def merge_problems(whole: Whole, parts: DataFrame, sources: DataFrame) -> DataFrame:
    """Why parts can't be joined: merged_id, reason. parts(merged_id, part, document_id) in order, sources(document_id, blob_id, parser_id, parser_version)."""
    known = parts.join(sources, "document_id", "left")
    source = F.struct("blob_id", "parser_id", "parser_version")
    mixed = known.groupBy("merged_id").agg(F.count_distinct(source).alias("_n"), F.bool_or(F.col("blob_id").isNull()).alias("_unknown"))
    by = Window.partitionBy("merged_id").orderBy("part", "piece")
    pieces = parts.join(whole.origin, "document_id").withColumns({"_a": F.lag("origin_start").over(by), "_b": F.lag("origin_end").over(by)})
    wrong = pieces.where(F.col("origin_start") < F.col("_b"))
    why = F.when(F.col("origin_end") > F.col("_a"), "overlapping_parts").otherwise("unordered_parts")
    first = wrong.groupBy("merged_id").agg(F.min(F.struct("part", "piece", why.alias("reason")))["reason"].alias("_order"))
    met = mixed.join(first, "merged_id", "left")
    reason = F.when(F.col("_unknown"), "unknown_part").when(F.col("_n") > 1, "mismatched_source").otherwise(F.col("_order"))
    return met.select("merged_id", reason.alias("reason")).where("reason IS NOT NULL")


def merged(whole: Whole, parts: DataFrame, sources: DataFrame) -> Whole:
    """Parts joined to one document each: parts(merged_id, part, document_id); those with a problem are left out.

    Spans move by the texts before; pages of one number become one, tables and blocks are named by part.
    """
    parts = parts.join(merge_problems(whole, parts, sources).select("merged_id"), "merged_id", "left_anti").select("merged_id", "part", "document_id")
    before = Window.partitionBy("merged_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    texts = parts.join(whole.texts, "document_id")
    offsets = texts.select("document_id", "merged_id", "part", F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0)).alias("_offset"))
    joined = texts.groupBy("merged_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))

    def shifted(rows: DataFrame) -> DataFrame:
        return moved(rows.join(offsets, "document_id"), F.col("_offset"))

    def named(rows: DataFrame, name: str) -> DataFrame:
        return renamed(shifted(rows).withColumn(name, F.concat(F.col("part").cast("string"), F.lit("/"), F.col(name))), "merged_id", "part", "_offset")

    pages = shifted(whole.pages)
    first = lambda c: F.min_by(c, "part").alias(c)
    own = [c for c in whole.pages.columns if c not in ("document_id", "page_index", "span_start", "span_end")]
    pages = pages.groupBy("merged_id", "page_index").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), *(first(c) for c in own))
    in_order = lambda *by: F.row_number().over(Window.partitionBy("merged_id").orderBy("part", *by)) - 1
    tokens = shifted(whole.tokens).withColumn("ord", in_order("ord"))
    pieces = parts.join(whole.origin, "document_id").withColumn("piece", in_order("piece"))
    return Whole(
        joined.withColumnRenamed("merged_id", "document_id"),
        pages.withColumnRenamed("merged_id", "document_id"),
        renamed(tokens, "merged_id", "part", "_offset"),
        named(whole.blocks, "block"),
        named(whole.tables, "table"),
        named(whole.cells, "table"),
        pieces.select(F.col("merged_id").alias("document_id"), "piece", "origin_start", "origin_end"),
    )


def in_source(whole: Whole, rows: DataFrame) -> DataFrame:
    """`rows` (document_id, span_start, span_end, …), one for each piece of the source that a span stands for: origin_start, origin_end."""
    places = rows.select("document_id", F.col("span_start").alias("place_start"), F.col("span_end").alias("place_end")).distinct()
    met = original_places(whole.origin.withColumnRenamed("piece", "part"), places).drop("part")
    return rows.join(met.withColumnsRenamed({"place_start": "span_start", "place_end": "span_end"}), ["document_id", "span_start", "span_end"])
