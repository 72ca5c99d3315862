"""Slices of merges of slices against a plain version, refusals, and trees that come back as the payloads they were."""

import json
import random

from pyspark.sql import functions as F

from folio.operators import conforming as C
from folio.operators import trees as T
from folio.operators import whole as W
from folio.plans.conforming import SCHEMA as ORDER

SOURCES = "document_id long, blob_id string, parser_id string, parser_version string"


def whole(spark, docs):
    """docs: document_id, text, pages, tokens, tables (name, a, b, cells), origin, as lists of spans."""
    make = lambda rows, schema: spark.createDataFrame(rows, f"document_id long, {schema}")
    each = lambda k: [(d["id"], *x) for d in docs for x in d[k]]
    span = "span_start long, span_end long"
    return W.Whole(
        make([(d["id"], d["text"]) for d in docs], "text string"), make(each("pages"), f"page_index int, {span}, width double"), make(each("tokens"), f"ord int, {span}"), make(each("blocks"), f"block string, {span}"),
        make(each("tables"), f"table string, {span}"), make(each("cells"), f"table string, row int, col int, {span}"), make(each("origin"), "piece int, origin_start long, origin_end long"),
    )


def document(dice, id_, source, at):
    n = dice.randint(30, 60)
    cuts = sorted(dice.sample(range(1, n), 6))
    spans = list(zip([0, *cuts], [*cuts, n], strict=True))
    return {
        "id": id_, "text": source[at : at + n], "pages": [(7, 0, cuts[2], 1.0), (8, cuts[2], n, 2.0)], "tokens": [(i, a, b) for i, (a, b) in enumerate(spans)] + [(99, 5, 5)], "blocks": [("x", spans[0][0], spans[1][1]), ("y", 9, 9)],
        "tables": [("t", cuts[0], cuts[3])], "cells": [("t", 0, 0, cuts[0], cuts[1]), ("t", 0, 1, cuts[1], cuts[3])], "origin": [(0, at, at + n)],
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select("document_id", *columns).collect()), key=repr)


def test_slices_of_merges_of_slices_lead_to_the_source(spark):
    dice = random.Random(9)
    source = "".join(chr(97 + i % 26) for i in range(5)) + "".join(dice.choice("abcdefgh é漢") for _ in range(2000))
    docs, at = [], 0
    for i in range(8):
        docs.append(document(dice, i, source, at))
        at += 80
    first = whole(spark, docs)
    cuts = [(d["id"], 100 + d["id"], 3, len(d["text"]) - 4) for d in docs] + [(0, 200, 0, 10**6), (77, 201, 0, 1), (1, 202, -1, 3), (1, 203, 5, 4)]
    cuts = spark.createDataFrame(cuts, "document_id long, slice_id long, cut_start long, cut_end long")
    assert {r.slice_id: r.reason for r in W.cut_problems(first, cuts).collect()} == {200: "bounds", 201: "unknown_document", 202: "bounds", 203: "bounds"}
    sliced = W.sliced(first, cuts)
    parts = spark.createDataFrame([(1000 + i % 2, i, 100 + i) for i in range(8)], "merged_id long, part int, document_id long")
    sources = spark.createDataFrame([(100 + i, "b", "p", "1") for i in range(8)], SOURCES)
    joined = W.merged(sliced, parts, sources)
    again = W.sliced(joined, spark.createDataFrame([(1000 + i, 5000 + i, 7, 111) for i in range(2)], "document_id long, slice_id long, cut_start long, cut_end long"))
    for i in range(2):
        mine = [d for d in docs if d["id"] % 2 == i]
        text, sources_, tokens, tables, cells, pages = "", [], [], [], [], {}
        for d in mine:
            off = len(text)
            a0, b0 = 3, len(d["text"]) - 4
            text += d["text"][a0:b0]
            sources_ += list(range(80 * d["id"] + a0, 80 * d["id"] + b0))
            into = lambda a, b, a0=a0, off=off: (a - a0 + off, b - a0 + off)
            tokens += [into(a, b) for _, a, b in d["tokens"] if a >= a0 and b <= b0 and a < b]
            tables += [(f"{d['id']}/t", *into(a, b)) for _, a, b in d["tables"] if a >= a0 and b <= b0]
            cells += [(f"{d['id']}/t", r, c, *into(a, b)) for (_, r, c, a, b) in d["cells"] if d["tables"][0][1] >= a0 and d["tables"][0][2] <= b0]
            for p, a, b, _ in d["pages"]:
                a, b = max(a, a0), min(b, b0)
                if a < b:
                    a, b = into(a, b)
                    low, high = pages.get(p, (a, b))
                    pages[p] = (min(a, low), max(b, high))
        key = 1000 + i
        assert [r[1] for r in rows(joined.texts, "text") if r[0] == key] == [text]
        got = [r for r in rows(joined.tokens, "span_start", "span_end") if r[0] == key]
        assert got == sorted([(key, *t) for t in tokens], key=repr)
        assert [r for r in rows(joined.cells, "table", "row", "col", "span_start", "span_end") if r[0] == key] == sorted([(key, *c) for c in cells], key=repr)
        assert [r for r in rows(joined.pages, "page_index", "span_start", "span_end", "width") if r[0] == key] == sorted([(key, p, *s, p - 6.0) for p, s in pages.items()], key=repr)
        key = 5000 + i
        inside = [(a - 7, b - 7) for a, b in tokens if a >= 7 and b <= 111]
        assert [r[1:] for r in rows(again.tokens, "span_start", "span_end") if r[0] == key] == sorted(inside, key=repr)
        kept = [t for t in tables if t[1] >= 7 and t[2] <= 111]
        assert [r[1] for r in rows(again.tables, "table") if r[0] == key] == sorted(t[0] for t in kept)
        where = [r for r in rows(W.in_source(again, again.tokens), "span_start", "span_end", "origin_start", "origin_end") if r[0] == key]
        assert where == sorted([(key, a, b, sources_[a + 7], sources_[b + 6] + 1) for a, b in inside], key=repr)
        pieces = sorted(r[1:] for r in rows(again.origin, "piece", "origin_start", "origin_end") if r[0] == key)
        assert [x for _, a, b in pieces for x in range(a, b)] == sources_[7:111]
        assert all(source[o : o + 1] == text[7 + j] for j, o in enumerate(sources_[7:111]))


def test_parts_that_cannot_be_joined_are_told(spark):
    dice = random.Random(3)
    docs = [document(dice, i, "x" * 400, at) for i, at in enumerate((0, 20, 100, 200))]
    parts = [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 0), (3, 0, 0), (3, 1, 9), (4, 0, 0), (4, 1, 3), (5, 0, 0), (5, 1, 2)]
    parts = spark.createDataFrame(parts, "merged_id long, part int, document_id long")
    sources = spark.createDataFrame([(0, "b", "p", "1"), (1, "b", "p", "1"), (2, "b", "p", "1"), (3, "b", "p", "2")], SOURCES)
    got = {r.merged_id: r.reason for r in W.merge_problems(whole(spark, docs), parts, sources).collect()}
    assert got == {1: "overlapping_parts", 2: "unordered_parts", 3: "unknown_part", 4: "mismatched_source"}


DEEP = {
    "name": "x",
    "version": 1,
    "fields": [
        {"name": "a", "type": "string"},
        {"name": "g", "fields": [{"name": "d", "type": "decimal"}, {"name": "h", "fields": [{"name": "n", "type": "number"}, {"name": "many", "cardinality": "many", "fields": [{"name": "t", "type": "datetime"}, {"name": "in", "fields": [{"name": "b", "type": "boolean"}]}]}]}]},
        {"name": "rows", "cardinality": "many", "fields": [{"name": "i", "type": "int"}]},
    ],
}


def test_trees_come_back(spark):
    dice = random.Random(2)
    one = lambda v: {"value": None if dice.random() < 0.2 else v, "claimed_text": dice.choice([None, "as \"said\"\n\\ é漢", ""])}
    payloads = [
        {
            "a": one(dice.choice(["", "x\"y\n", "漢\\", "1.0"])),
            "g": {"d": one("10.50"), "h": {"n": one(2.5), "many": [{"t": one("2026-01-02T03:04:05"), "in": {"b": one(True)}} for _ in range(dice.randint(0, 12))]}},
            "rows": [{"i": one(i)} for i in range(dice.choice([0, 1, 11]))],
        }
        for _ in range(30)
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(99, '{"a": 1}')], "document_id int, payload string")
    fields = C.conformed(df, DEEP)
    got = {r.document_id: json.loads(r.tree) for r in T.rebuilt(fields, DEEP).collect()}
    assert got == dict(enumerate(payloads))
    assert [list(t) for t in got.values()] == [["a", "g", "rows"]] * 30
    # And the trees are payloads themselves, of the same values.
    trees = T.rebuilt(fields, DEEP).select("document_id", F.col("tree").alias("payload"))
    key = lambda f: sorted((tuple(r) for r in f.where("document_id < 99").select("document_id", "field_path", "value", "claimed_text", "present").collect()), key=repr)
    assert key(C.conformed(trees, DEEP)) == key(fields)


def test_values_have_their_types_again(spark):
    payload = {"number": {"value": 5, "claimed_text": None}, "total": {"value": "0.10", "claimed_text": None}, "placed": {"value": "2026-03-01", "claimed_text": None}, "paid": {"value": True, "claimed_text": None}}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, json.dumps(payload | {"total": {"value": "0.20", "claimed_text": "x"}}))], "document_id int, payload string")
    rows_ = T.retyped(C.conformed(df, ORDER).where("problem IS NULL"))
    assert str(rows_.agg(F.sum("as_decimal")).first()[0].normalize()) == "0.3"
    r = rows_.where("field_path = 'placed'").first()
    assert str(r.as_date) == "2026-03-01" and r.as_int is None and r.as_decimal is None
    assert rows_.where("field_path = 'paid'").first().as_boolean is True and rows_.where("field_path = 'number'").first().as_int == 5


def test_payloads_are_read_in_bounded_work(spark):
    """A place's value is taken once, whatever is asked of it: the plan has some calls a declared field, not hundreds."""
    df = spark.createDataFrame([(1, "{}")], "document_id int, payload string")
    plan = C.conformed(df, ORDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    plan = plan[plan.index("== Physical Plan") :]
    assert 0 < plan.count("variant_get") < 100, plan.count("variant_get")


def test_trees_are_dealt_once(spark):
    df = spark.createDataFrame([(1, "{}")], "document_id int, payload string")
    plan = T.rebuilt(C.conformed(df, DEEP), DEEP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_odd_payloads_are_refused_where_they_are_wrong(spark):
    one = '{"value":1,"claimed_text":null}'
    cases = {
        '\n {"number":%s}' % one: ("number", None), '{"number":{"value":1}}': ("number", "missing_key"), '{"number":[1]}': ("number", "wrong_shape"), '{"number":{"value":1,"claimed_text":3}}': ("number", "wrong_shape"),
        '{"number":null}': ("number", "wrong_shape"), "{}": ("number", "missing_field"), '{"a":1,"a":2}': ("", "not_an_object"), '"{"': ("", "not_an_object"), '{"marks":{}}': ("marks", "wrong_shape"),
        '{"marks":%s}' % one: ("marks", "scalar_for_group"), '{"marks":[1]}': ("marks[0].rank", "missing_field"), '{"buyer":null}': ("buyer", "wrong_shape"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "document_id int, payload string")
    got = {(r.document_id, r.field_path): r.problem for r in C.conformed(df, ORDER).collect()}
    for i, (path, problem) in enumerate(cases.values()):
        assert got[i, path] == problem, (i, path)
