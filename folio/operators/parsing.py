"""Parsing: decisions before a parser runs, and checks of what it gave.

documents(document_id, blob_id, parser_id, parser_version, ...), parsers(parser_id, media_types, supplies, available,
priority); needs and supplies are arrays of capability names. A registry of parsers is a short list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.documents import overlaps
from folio.operators.identity import document_id


def page_refusal(pages: Column, most: int) -> Column:
    """Why a document is refused for its number of pages, or null."""
    return F.when(pages < 1, "no_pages").when(pages > most, "page_limit")


def missing(needs: Column, supplies: Column) -> Column:
    """The needs that a parser doesn't supply, sorted."""
    return F.array_sort(F.array_except(needs, supplies))


def named(docs: DataFrame, parsers: DataFrame) -> DataFrame:
    """The parser that each document names (parser_id), or why it can't be used: no other takes its place."""
    rows = docs.join(F.broadcast(parsers.select("parser_id", "media_types", "supplies", "available")), "parser_id", "left")
    lacking = F.when(F.col("supplies").isNotNull(), missing(F.col("needs"), F.col("supplies")))
    refusal = (
        F.when(F.col("available").isNull(), "unknown_parser")
        .when(~F.array_contains("media_types", F.col("media_type")), "media_type")
        .when(F.size(lacking) > 0, F.concat(F.lit("missing:"), F.array_join(lacking, "+")))
        .when(~F.col("available"), "unavailable")
    )
    return rows.select("document_id", "parser_id", refusal.alias("refusal"))


def layer_record(layers: DataFrame, forced: Column) -> DataFrame:
    """The text layer's record when a route may be forced (native, recognition, or null): the evidence stays, with the rule's own verdict.

    layers(document_id, media_type, pages, bearing, usable): what isn't a PDF has no layer, and the rule isn't run.
    """
    other = F.col("media_type") != "application/pdf"
    usable = F.when(other, F.lit(False)).when(forced == "native", F.lit(True)).when(forced == "recognition", F.lit(False)).otherwise(F.col("usable"))
    return layers.select(
        "document_id", F.when(other, 1).otherwise(F.col("pages")).alias("pages"), F.when(other, 0).otherwise(F.col("bearing")).alias("bearing"), usable.alias("usable"),
        F.when(~other & forced.isNotNull(), F.col("usable")).alias("rule_verdict"), F.when(other, "not_a_pdf").alias("rule_not_run"), F.when(~other & (F.col("pages") == 0), "corrupt").alias("refusal"),
    )


def planned(docs: DataFrame, parsers: DataFrame, options_hash: str) -> DataFrame:
    """All decisions before parsing: the route, the parser and the id that the document will have; or the refusal.

    docs(document_id, blob_id, media_type, needs, usable): an unusable text layer needs a parser that supplies recognition.
    """
    needs = F.when(F.col("usable"), F.col("needs")).otherwise(F.array_union("needs", F.array(F.lit("recognition"))))
    takers = parsers.where("available").select("parser_id", "parser_version", "supplies", "priority", F.explode("media_types").alias("media_type"))
    met = docs.withColumn("_n", needs).join(F.broadcast(takers), "media_type", "left")
    fits = F.col("parser_id").isNotNull() & (F.size(missing(F.col("_n"), F.coalesce("supplies", F.array().cast("array<string>")))) == 0)
    best = met.groupBy("document_id", "blob_id", "usable").agg(F.min(F.when(fits, F.struct("priority", "parser_id", "parser_version"))).alias("_b"))
    chosen = best.select("document_id", F.when(F.col("usable"), "native").otherwise("recognition").alias("route"), F.col("_b.parser_id").alias("parser_id"), "blob_id", F.col("_b.parser_version").alias("_v"))
    planned_id = F.when(F.col("parser_id").isNotNull(), document_id(F.col("blob_id"), F.col("parser_id"), F.col("_v"), options_hash))
    return chosen.select("document_id", "route", "parser_id", planned_id.alias("planned_id"), F.when(F.col("parser_id").isNull(), "no_parser").alias("refusal"))


def geometry_gaps(tokens: DataFrame, declared: DataFrame) -> DataFrame:
    """Documents whose tokens don't all keep to what is declared: all have geometry, or none has. declared(document_id, geometry)."""
    rows = tokens.groupBy("document_id").agg(F.count_if("has_geometry").alias("_with"), F.count("*").alias("_all")).join(declared, "document_id")
    want = F.when(F.col("geometry"), F.col("_all")).otherwise(0)
    return rows.where(F.col("_with") != want).select("document_id")


def output_problem(given: DataFrame) -> DataFrame:
    """The first problem of each parser's output, or null: document_id, problem.

    given has what was asked (blob_id, parser_id, parser_version, text_layer) and what came back (out_ the same), the
    number of misplaced tokens, and declared and produced capabilities as arrays.
    """
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"out_{c}"))
    false_claims = F.array_sort(F.array_except("declared", "produced"))
    undeclared = F.array_sort(F.array_except("produced", "declared"))
    problem = (
        F.when(F.col("misplaced") > 0, "token_order")
        .when(F.size(undeclared) > 0, F.concat(F.lit("undeclared:"), F.array_join(undeclared, "+")))
        .when(F.size(false_claims) > 0, F.concat(F.lit("not_produced:"), F.array_join(false_claims, "+")))
        .when(other("blob_id"), "wrong_document").when(other("parser_id"), "wrong_parser").when(other("parser_version"), "wrong_version").when(other("text_layer"), "wrong_text_layer")
    )
    return given.select("document_id", problem.alias("problem"))


def original_places(parts: DataFrame, places: DataFrame) -> DataFrame:
    """Where a place in a document stood in its source: (document_id, place_start, place_end, part, origin_start, origin_end).

    parts(document_id, part, origin_start, origin_end) in order, joined without gaps; places(document_id, place_start, place_end).
    """
    by = Window.partitionBy("document_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("origin_end") - F.col("origin_start")
    rows = parts.withColumn("_b", F.sum(size).over(by)).withColumn("_a", F.col("_b") - size)
    met = places.join(rows, "document_id").where(overlaps(F.col("place_start"), F.col("place_end"), F.col("_a"), F.col("_b")))
    low, high = F.greatest("place_start", "_a"), F.least("place_end", "_b")
    return met.select("document_id", "place_start", "place_end", "part", (F.col("origin_start") + low - F.col("_a")).alias("origin_start"), (F.col("origin_start") + high - F.col("_a")).alias("origin_end"))


def sliced_pages(pages: DataFrame, cuts: DataFrame) -> DataFrame:
    """Pages of slices: clipped to the cut and moved to begin at it. cuts(document_id, cut_start, cut_end)."""
    met = pages.join(cuts, "document_id").where(overlaps(F.col("span_start"), F.col("span_end"), F.col("cut_start"), F.col("cut_end")))
    return met.select("document_id", "page_index", (F.greatest("span_start", "cut_start") - F.col("cut_start")).alias("span_start"), (F.least("span_end", "cut_end") - F.col("cut_start")).alias("span_end"))


def merged_pages(parts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Pages of parts joined to one document: moved by the part's offset, parts of one page made one.

    parts(document_id, part, page_index, span_start, span_end), offsets(document_id, part, offset).
    """
    rows = parts.join(offsets.select("document_id", "part", "offset"), ["document_id", "part"])
    moved = lambda c: F.col(c) + F.col("offset")
    return rows.groupBy("document_id", "page_index").agg(F.min(moved("span_start")).alias("span_start"), F.max(moved("span_end")).alias("span_end"))


def located(touched: DataFrame, capable: DataFrame) -> DataFrame:
    """The boxes of each span in token order, or the refusal of a document without geometry.

    touched(document_id, span_start, span_end, ord, box) are the tokens that spans touch; capable(document_id, geometry).
    """
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("ord", "box"))), lambda t: t["box"])
    rows = touched.groupBy("document_id", "span_start", "span_end").agg(boxes.alias("_b")).join(capable, "document_id")
    return rows.select("document_id", "span_start", "span_end", F.when(F.col("geometry"), F.col("_b")).alias("boxes"), F.when(~F.col("geometry"), "no_geometry").alias("refusal"))


# The artifact store


def got(asked: DataFrame, store: DataFrame, version: int) -> DataFrame:
    """Artifacts by id: artifact_id, payload where there is one of this format version, damaged where it isn't what its content id says."""
    rows = asked.join(store.where(F.col("format_version") == version).select("artifact_id", "payload", "content_id"), "artifact_id", "left")
    sound = F.concat(F.lit("sha256:"), F.sha2("payload", 256)) == F.col("content_id")
    return rows.select("artifact_id", F.when(sound, F.col("payload")).alias("payload"), F.coalesce(~sound, F.lit(False)).alias("damaged"))


def cleared(store: DataFrame, stage: str | None = None) -> DataFrame:
    """The store without a stage's artifacts, or without any."""
    return store.where(F.col("stage") != stage) if stage else store.limit(0)


def deleted(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("artifact_id").distinct(), "artifact_id", "left_anti")


def namespace(tenant: Column, default: str) -> Column:
    """A tenant's folder in a store: the root is the default tenant's."""
    return F.when(tenant == default, "").otherwise(F.concat(F.lit("t/"), tenant))


def prefix_deleted(store: DataFrame, tenant: str, default: str, allow_root: bool = False) -> DataFrame:
    """The store without a tenant's artifacts; the root namespace is refused unless allowed."""
    if tenant == default and not allow_root:
        raise ValueError("the root namespace is not deleted")
    return store.where(~F.col("tenant_id").eqNullSafe(tenant))


def blobs_added(store: DataFrame, new: DataFrame) -> DataFrame:
    """The blobs that the store lacks, each content once."""
    return new.dropDuplicates(["blob_id"]).join(store.select("blob_id"), "blob_id", "left_anti")
