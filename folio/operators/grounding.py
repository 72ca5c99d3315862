"""Grounding: where claimed values stand in texts, exactly or within an edit distance.

claims(document_id, field_path, claim) are located in docs(document_id, text). `ground` folds both to views first and
gives spans in the text; `exact` takes texts as they are. A claim's best place is that of highest similarity,
then least start, then least length.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from folio.functions import nearest
from folio.functions import text as T
from folio.operators import documents as D

THRESHOLD = 0.9
BUDGET = 1500
RUNNERS_UP = 5


#: What a view may change: soft hyphens, a hyphen before white space, white space, characters beyond ASCII.
CHANGED = re.compile(r"\xad|-\s+|\s+|[^\x00-\x7F\s\xad]+")


def folded(source: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The view of a text, and its transformed parts as (view start, view length, source start, source length).

    Soft hyphens go; a hyphen at a line break goes with the break between two lower-case letters, else only the break
    goes; runs of white space become one space; a character and its combining marks are composed to compatible form.
    """
    out, parts, size, done = [], [], 0, 0
    for start, end, text in changes(source):
        out += (source[done:start], text)
        size += start - done
        parts.append((size, len(text), start, end - start))
        size += len(text)
        done = end
    return "".join(out) + source[done:], parts


def changes(source: str):
    """(start, end, text) of each piece of the source that its view has otherwise."""
    for m in CHANGED.finditer(source):
        a, b = m.span()
        first = source[a]
        if first == "\xad":
            yield a, b, ""
        elif first == "-":
            if "\n" in m.group() and a and b < len(source):
                joins = source[a - 1].islower() and source[b].islower()
                yield a, b, "" if joins else "-"
            elif m.group() != "- ":
                yield a + 1, b, " "
        elif first.isspace():
            if m.group() != " ":
                yield a, b, " "
        else:
            # Marks compose with the ASCII character before them.
            if a and unicodedata.combining(first) and source[a - 1] != "\xad" and not source[a - 1].isspace():
                a -= 1
            if unicodedata.is_normalized("NFKC", source[a:b]):
                continue
            while a < b:
                after = a + 1
                while after < b and unicodedata.combining(source[after]):
                    after += 1
                text = unicodedata.normalize("NFKC", source[a:after])
                if text != source[a:after]:
                    yield a, after, text
                a = after


VIEW = "view string, parts array<struct<view:int,view_size:int,source:int,source_size:int>>"


def fold(text: Column | str) -> Column:
    """A text's view and its transformed parts; composition has no built-in function."""
    names = ("view", "view_size", "source", "source_size")

    def views(texts: pd.Series) -> pd.DataFrame:
        got = [folded(t or "") for t in texts]
        return pd.DataFrame({"view": [g[0] for g in got], "parts": [[dict(zip(names, p, strict=True)) for p in g[1]] for g in got]})

    return F.pandas_udf(views, VIEW)(text)


def source_place(parts: Column, place: Column, end: bool) -> Column:
    """The place in the source of a place in the view; within a transformed part, that part's start or end."""
    start = F.struct(F.lit(0).alias("shift"), F.lit(None).cast("int").alias("at"))

    def step(s: Column, p: Column) -> Column:
        stop = p["view"] + p["view_size"]
        behind = (stop <= place) if end else (stop <= place) & ~((p["view_size"] == 0) & (stop == place))
        inside = (p["view"] < place) & (place < stop)
        at = F.when(inside, p["source"] + p["source_size"] if end else p["source"]).otherwise(s["at"])
        return F.struct(F.when(behind, p["source"] + p["source_size"] - stop).otherwise(s["shift"]).cast("int").alias("shift"), at.cast("int").alias("at"))

    found = F.aggregate(parts, start, step)
    return F.coalesce(found["at"], place + found["shift"])


def viewed(docs: DataFrame) -> DataFrame:
    """Documents with their views as text, and the views' transformed parts as _parts."""
    return docs.select("document_id", fold("text").alias("_v")).select("document_id", F.col("_v.view").alias("text"), F.col("_v.parts").alias("_parts"))


def folded_claims(claims: DataFrame) -> DataFrame:
    """Claims in the form of the views; a missing one becomes empty."""
    return claims.withColumn("claim", fold("claim")["view"])


def sourced(places: DataFrame, views: DataFrame) -> DataFrame:
    """Places in views as places in the texts."""
    met = places.join(views.select("document_id", "_parts"), "document_id")
    at = {"span_start": source_place(F.col("_parts"), F.col("span_start"), False), "span_end": source_place(F.col("_parts"), F.col("span_end"), True)}
    return met.withColumns(at).drop("_parts")


def exact(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """document_id, field_path, span_start, span_end, score 1 of every place where a claim stands word for word."""
    met = docs.join(claims.where("trim(claim) <> ''"), "document_id")
    at = met.select("document_id", "field_path", F.length("claim").alias("_n"), F.explode(T.find_starts(F.col("text"), F.col("claim"))).alias("span_start"))
    return at.select("document_id", "field_path", "span_start", (F.col("span_start") + F.col("_n")).alias("span_end"), F.lit(1.0).alias("score"))


#: Claims of one document that are looked for at once.
PACK = 256
PLACE = "struct<span_start:int,span_end:int,score:double>"


def packed(claims: DataFrame) -> DataFrame:
    """(document_id, _pack, _claims): equal claims once with their number, in packs of some PACK claims of a document."""
    once = claims.groupBy("document_id", "field_path", "claim").agg(F.count("*").alias("n"))
    packs = once.groupBy("document_id").agg(F.ceil(F.count("*") / PACK).alias("_packs"))
    # Claims without a document have no count; they are dealt all the same.
    pack = F.pmod(F.xxhash64("field_path", "claim"), F.coalesce("_packs", F.lit(PACK))).alias("_pack")
    return once.join(packs, "document_id", "left").groupBy("document_id", pack).agg(F.collect_list(F.struct("field_path", "claim", "n")).alias("_claims"))


def ground(docs: DataFrame, claims: DataFrame, threshold: float = THRESHOLD, budget: int = BUDGET, folding: bool = True, runners_up: int = RUNNERS_UP) -> DataFrame:
    """One row a claim: status (exact, fuzzy, ungrounded), span_start, span_end, score, alternatives, truncated.

    Exact places come first: only a claim without one is looked for within its edits. Alternatives are the next best places, up
    to `runners_up`, each with its score. Truncated: the budget of starts cut the search, so a better place may stand further on. Without
    folding, texts and claims are compared as they are. A claim that is missing or blank, or whose document is, is ungrounded.
    Claims meet their document by one join; a document with very many is dealt to several tasks.
    """
    types = {f.name: f.dataType.simpleString() for f in claims.schema}
    schema = f"document_id {types['document_id']}, field_path {types['field_path']}, status string, places array<{PLACE}>, truncated boolean, n long"
    key = claims.where("document_id IS NOT NULL").select("document_id").distinct()
    asked = packed(claims.select("document_id", F.col("field_path"), F.col("claim").cast("string").alias("claim")))
    texts = docs.join(key, "document_id", "left_semi").select("document_id", F.coalesce("text", F.lit("")).alias("text"))
    met = asked.join(texts, "document_id", "left")
    # Few bytes but much work: a number of partitions that isn't coalesced.
    met = met.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "document_id", "_pack")

    def run(batches):
        for batch in batches:
            rows = {"row": [], "field_path": [], "status": [], "places": [], "truncated": [], "n": []}
            for i, (text, own) in enumerate(zip(batch.column("text").to_pylist(), batch.column("_claims").to_pylist(), strict=True)):
                view, parts = folded(text or "") if folding else (text or "", [])
                source = nearest.Places(parts).source
                wanted = [folded(c["claim"] or "")[0] if folding else c["claim"] or "" for c in own]
                for c, (places, cut) in zip(own, nearest.located(view, wanted, threshold, budget, runners_up + 1), strict=True):
                    rows["row"].append(i)
                    rows["field_path"].append(c["field_path"])
                    rows["status"].append("ungrounded" if not places else "exact" if places[0][0] == 1 else "fuzzy")
                    rows["places"].append([{"span_start": source(a, False), "span_end": source(b, True), "score": score} for score, a, b in places])
                    rows["truncated"].append(cut)
                    rows["n"].append(c["n"])
            ids = batch.column("document_id").take(pa.array(rows.pop("row"), pa.int64()))
            kind = pa.list_(pa.struct([("span_start", pa.int32()), ("span_end", pa.int32()), ("score", pa.float64())]))
            columns = [pa.array(rows["field_path"], names[1].type), pa.array(rows["status"], pa.string()), pa.array(rows["places"], kind), pa.array(rows["truncated"], pa.bool_()), pa.array(rows["n"], pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["document_id", "field_path", "status", "places", "truncated", "n"])

    names = to_arrow_schema(claims.select("document_id", "field_path").schema)
    out = met.select("document_id", "text", "_claims").mapInArrow(run, schema).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    first = F.get("places", F.lit(0))
    return out.select("document_id", "field_path", "status", first["span_start"].alias("span_start"), first["span_end"].alias("span_end"), first["score"].alias("score"), F.slice("places", 2, runners_up).alias("alternatives"), "truncated")


def with_pages(outcomes: DataFrame, pages: DataFrame, size: int) -> DataFrame:
    """Outcomes with the pages of their span in order; an ungrounded one has none."""
    spans = outcomes.where("span_start IS NOT NULL").select("document_id", "span_start", "span_end").distinct()
    met = D.pages_for(spans, pages.join(spans.select("document_id").distinct(), "document_id", "left_semi"), size)
    return outcomes.join(met, ["document_id", "span_start", "span_end"], "left")


def with_boxes(outcomes: DataFrame, tokens: DataFrame, capable: DataFrame) -> DataFrame:
    """Outcomes with `geometry`: page and box of each token that the span touches, in order; null where the parser gave none.

    tokens(document_id, ord, page_index, span_start, span_end, box), capable(document_id, geometry). Spans and tokens meet by cells of the text.
    """
    key = ["document_id", "span_start", "span_end"]
    able = capable.where("geometry").select("document_id")
    spans = outcomes.where("span_start IS NOT NULL").select(*key).distinct().join(able, "document_id", "left_semi")
    own = tokens.where("box IS NOT NULL").join(spans.select("document_id").distinct(), "document_id", "left_semi")
    own = own.withColumn("ord", F.struct("ord", "page_index", "box"))
    met = D.tokens_in(spans, own).groupBy(*key).agg(F.array_sort(F.collect_list("ord")).alias("_t"))
    met = spans.join(met, key, "left").select(*key, F.coalesce(F.transform("_t", lambda t: F.struct(t["page_index"].alias("page_index"), t["box"].alias("box"))), F.array()).alias("geometry"))
    return outcomes.join(met, key, "left")


def exclusive(places: DataFrame) -> DataFrame:
    """Give entries of one repeated field places of their own, in entry order: each takes its best place that no earlier one took.

    places(document_id, slot, entry, span_start, span_end, score). The fold goes through one document's entries of one
    field, of which each brings a few places.
    """
    order = F.struct((-F.col("score")).alias("a"), F.col("span_start").alias("b"), (F.col("span_end") - F.col("span_start")).alias("n"))
    entries = places.groupBy("document_id", "slot", "entry").agg(F.array_sort(F.collect_list(order)).alias("_p"))
    slots = entries.groupBy("document_id", "slot").agg(F.array_sort(F.collect_list(F.struct("entry", "_p"))).alias("_e"))
    start = F.array().cast("array<struct<entry:int,span_start:int,span_end:int>>")

    def take(taken: Column, e: Column) -> Column:
        free = F.filter(e["_p"], lambda p: ~F.exists(taken, lambda t: (t["span_start"] == p["b"]) & (t["span_end"] == p["b"] + p["n"])))
        first = F.get(free, F.lit(0))
        one = F.struct(e["entry"].cast("int").alias("entry"), first["b"].cast("int").alias("span_start"), (first["b"] + first["n"]).cast("int").alias("span_end"))
        return F.concat(taken, F.array(one))

    return slots.select("document_id", "slot", F.explode(F.aggregate("_e", start, take)).alias("_t")).select("document_id", "slot", "_t.*")


def counts(outcomes: DataFrame) -> DataFrame:
    """How many claims are exact, fuzzy and ungrounded, how many searches were cut, and the share that is grounded (null without claims)."""
    n = lambda s: F.count_if(F.col("status") == s)
    sums = outcomes.agg(n("exact").alias("exact"), n("fuzzy").alias("fuzzy"), n("ungrounded").alias("ungrounded"), F.count_if("truncated").alias("truncated"))
    return sums.withColumn("grounding_rate", F.try_divide((F.col("exact") + F.col("fuzzy")).cast("double"), (F.col("exact") + F.col("fuzzy") + F.col("ungrounded")).cast("double")))
