"""Whole reports: refusals, tiers left out, documents without predictions, comparisons."""

import pytest
from pyspark.sql import functions as F

from folio.operators import scorecards as S

DOCS = "document_id string, tier string, declared long, schema_identity string, schema_hash string, note string"
LABELS = "document_id string, field_path string, expectation string, value string, type string"
PREDICTIONS = "document_id string, field_path string, value string, type string, present boolean"
STATES = "document_id string, failed boolean, exact long, fuzzy long, ungrounded long, verdict string, schema_identity string, schema_hash string, parser_version string, prompt_hash string, model_id string"


def state(key, exact=1, verdict="valid", failed=False, identity="s@1", hashed="h", parser="p1"):
    recorded = exact is not None
    return key, failed, exact, 0 if recorded else None, 1 if recorded else None, verdict, identity, hashed, parser, "", None


@pytest.fixture(scope="module")
def sets(spark):
    make = spark.createDataFrame
    docs = make([("a", "public", 2, "s@1", "h", "x"), ("b", "public", 1, "s@1", "h", None), ("c", "restricted", 3, "s@1", "h", "y"), ("d", "public", 0, "s@1", "h", "")], DOCS)
    labels = make([("a", "t", "value", "1", "int"), ("a", "u", "absent", None, "int"), ("b", "t", "value", None, "string"), ("c", "t", "value", "2", "int")], LABELS)
    predictions = make([("a", "t", "1", "int", True), ("a", "u", "3", "int", True), ("b", "t", None, "string", True), ("c", "t", "9", "int", True), ("c", "v", "9", "int", True), ("zz", "t", "9", "int", True)], PREDICTIONS)
    states = make([state("a"), state("b", None, None, True), state("c", 2, "invalid", parser="p2")], STATES)
    return docs, labels, predictions, states


def rows(df):
    return {(r["section"], r["key"], r["name"]): (r["numerator"], r["denominator"], r["value"], r["said"]) for r in df.collect()}


def test_every_level(sets):
    got = rows(S.report(*sets, "g"))
    assert got["micro", None, "field_accuracy"] == (1, 4, 0.25, None)
    assert got["micro", None, "grounding_rate"] == (3, 5, 0.6, None)
    assert got["micro", None, "spurious_rate"] == (1, 1, 1.0, None)
    assert got["count", None, "missing"][0] == 1 and got["count", None, "unlabeled"][0] == 1
    assert got["document", "a", "field_accuracy"] == (1, 2, 0.5, None)
    assert got["document", "b", "missing_rate"] == (1, 1, 1.0, None)
    assert got["document", "d", "field_accuracy"] == (0, 0, None, None)
    assert got["path", "u", "spurious_rate"] == (1, 1, 1.0, None)
    assert got["path", "t", "grounding_rate"] == (0, 0, None, None)
    assert got["macro", None, "field_accuracy"][:2] == (3, 4) and abs(got["macro", None, "field_accuracy"][2] - 1 / 6) < 1e-12
    assert got["macro", None, "mislocation_rate"] == (0, 4, None, None)
    assert got["tier", "public", "documents"][:2] == (3, 3) and got["tier", "restricted", "labels"][:2] == (3, 3)
    assert got["verdict", "valid", "documents"][0] == 1 and got["verdict", "invalid", "documents"][0] == 1
    assert got["provenance", None, "parser_version"][3] == "p1,p2"
    assert not {k for k in got if k[0] == "partial" or k[:3] == ("provenance", None, "model_id") or k[0] == "document" and k[1] == "zz"}
    assert got["fact", None, "partial"][3] == "false" and got["fact", None, "schema_hash"][3] == "h"


def test_public_tier_alone_says_what_is_left_out(sets):
    got = rows(S.report(*sets, "g", include_restricted=False))
    assert got["partial", None, "documents"] == (3, 4, 0.75, None)
    assert got["partial", None, "labels"] == (3, 6, 0.5, None)
    assert got["partial", None, "tiers"][3] == "restricted"
    assert got["tier", "restricted", "documents"][:2] == (0, 1)
    assert ("document", "c", "coverage") not in got and ("path", "v", "coverage") not in got
    assert got["provenance", None, "parser_version"][3] == "p1"
    assert got["micro", None, "grounding_rate"][:2] == (1, 2)


def test_levels_add_up(sets):
    got = {r["name"]: r["reconciled"] for r in S.reconciles(S.report(*sets, "g")).collect()}
    assert set(got.values()) == {True} and len(got) == 6


def test_refusals_come_first(spark, sets):
    docs, labels, predictions, states = sets
    for extra, why in ((state("a"), "a: repeated_prediction"), (state("q"), "q: unknown_document"), (state("d", identity="s@2"), "d: schema_mismatch"), (state("d", hashed="k"), "d: schema_hash_mismatch")):
        with pytest.raises(ValueError, match=why):
            S.report(docs, labels, predictions, states.unionByName(spark.createDataFrame([extra], STATES)), "g")


def test_empty_tables(sets):
    docs, labels, predictions, states = sets
    got = rows(S.report(docs.where("false"), labels.where("false"), predictions.where("false"), states.where("false"), "g"))
    assert got["micro", None, "field_accuracy"] == (0, 0, None, None) and not {k for k in got if k[0] in ("document", "path", "tier", "macro")}
    unscored = rows(S.report(docs, labels, predictions.where("false"), states.where("false"), "g"))
    assert unscored["micro", None, "unevaluated_rate"] == (4, 4, 1.0, None)


def test_comparison(spark, sets):
    docs, labels, predictions, states = sets
    before = S.report(*sets, "g")
    better = predictions.where("field_path <> 'u'")
    later = states.where("document_id <> 'c'").unionByName(spark.createDataFrame([state("c", 2, "invalid", parser="p3")], STATES))
    got = {(r["section"], r["key"], r["name"]): r for r in S.changes(before, S.report(docs, labels, better, later, "g")).collect()}
    assert got["micro", None, "spurious_rate"]["judgement"] == "improved"
    assert got["micro", None, "coverage"]["judgement"] == "unchanged"
    assert got["document", "a", "field_accuracy"]["delta"] == 0.5
    assert (got["provenance", None, "parser_version"]["said_before"], got["provenance", None, "parser_version"]["said_after"]) == ("p1,p2", "p1,p3")
    assert {r["judgement"] for k, r in got.items() if k[0] == "provenance"} == {"changed"}
    assert {r["judgement"] for r in S.changes(before, before).collect()} == {"unchanged"}
    with pytest.raises(ValueError, match="golden_set_id, partial"):
        S.changes(before, S.report(*sets, "other", include_restricted=False))
    other = docs.withColumn("schema_hash", F.lit("k")), labels, predictions, states.withColumn("schema_hash", F.lit("k"))
    with pytest.raises(ValueError, match="schema_hash"):
        S.changes(before, S.report(*other, "g"))
