"""Expressions over spans, boxes and pages. A problem is a text, or null where nothing is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import normalized

CORNERS = ("x0", "y0", "x1", "y1")
TURNS = (0, 90, 180, 270)


def span_problem(start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), "missing").when(start < 0, "negative").when(end < start, "reversed")


def contains(start: Column, end: Column, place: Column) -> Column:
    return (place >= start) & (place < end)


def contains_span(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Equal ends count as contained."""
    return (other_start >= start) & (other_end <= end)


def shifted(start: Column, end: Column, by: Column) -> Column:
    """The span moved, or null if it would begin before 0."""
    return F.when(start + by >= 0, F.struct((start + by).alias("start"), (end + by).alias("end")))


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_problem(b: Column) -> Column:
    """A box's corners are numbers from 0 to 1, the first not beyond the second."""
    odd = [b[c].isNull() | F.isnan(b[c]) for c in CORNERS]
    out = [(b[c] < 0) | (b[c] > 1) for c in CORNERS]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], "not_a_number").when(out[0] | out[1] | out[2] | out[3], "outside_page").when((b["x1"] < b["x0"]) | (b["y1"] < b["y0"]), "reversed")


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def union(a: Column, b: Column) -> Column:
    """The least box around both."""
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def meet(a: Column, b: Column) -> Column:
    """Whether two boxes share more than an edge."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def placed_problem(page_index: Column, b: Column) -> Column:
    """A place on a page: its index isn't negative, its box is sound."""
    return F.when(page_index.isNull() | (page_index < 0), "page_index").otherwise(box_problem(b))


def token_problem(start: Column, end: Column, confidence: Column) -> Column:
    """A token's span is sound, and its source's confidence, where given, is from 0 to 1."""
    return F.coalesce(span_problem(start, end), F.when(F.isnan(confidence) | (confidence < 0) | (confidence > 1), "confidence"))


def turn_problem(rotation: Column) -> Column:
    return F.when(~rotation.isin(*TURNS), "rotation")


def shown_size(width: Column, height: Column, rotation: Column) -> Column:
    """A page's size as shown: sides swap at a quarter turn."""
    swap = rotation.isin(90, 270)
    return F.struct(F.when(swap, height).otherwise(width).alias("width"), F.when(swap, width).otherwise(height).alias("height"))


def page_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in shares of the page, its corners put in order; null if it lies beyond the page by more than the tolerance."""
    shares = [normalized(F.least(x0, x1), width), normalized(F.least(y0, y1), height), normalized(F.greatest(x0, x1), width), normalized(F.greatest(y0, y1), height)]
    whole = shares[0].isNotNull() & shares[1].isNotNull() & shares[2].isNotNull() & shares[3].isNotNull()
    return F.when(whole, box(*shares))
