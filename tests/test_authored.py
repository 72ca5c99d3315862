"""Folders of declared schemas: parsed in tasks, every authoring error a row."""

import copy
import json

import pytest

from folio.sources import authored as A

GOOD = {
    "name": "berth", "version": 3, "description": "d",
    "fields": [
        {"name": "ship", "type": "string", "required": True, "constraints": {"pattern": "[A-Z]+", "min_length": 1}}, {"name": "berths", "type": "integer", "constraints": {"enum": [1, 2], "multiple_of": 1}},
        {"name": "left", "type": "date", "constraints": {"minimum": "2020-01-31"}}, {"name": "owner", "cardinality": "group", "fields": [{"name": "open", "type": "boolean", "constraints": {"const": True}}]},
        {"name": "loads", "cardinality": "repeating_group", "fields": [{"name": "tons", "type": "decimal", "cardinality": "scalar"}]}, {"name": "tons", "type": "decimal"},
    ],
    "rules": [{"id": "sum", "kind": "sum_equals", "operands": ["loads.tons", "tons"], "tolerance": "0.01", "operator": None}],
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return out


def test_a_good_schema():
    name, fields, rules, refusals = A.parse_one(json.dumps(GOOD))
    assert (name, refusals) == ("berth@3", [])
    assert [(f[1], f[3], f[4], f[8]) for f in fields][2:] == [("left", "date", "one", None), ("owner", "group", "one", None), ("owner.open", "boolean", "one", None), ("loads", "group", "many", None), ("loads.tons", "decimal", "one", "loads"), ("tons", "decimal", "one", None)]
    assert rules == [(0, "sum", "sum_equals", ["loads.tons", "tons"], None, "0.01")]
    assert A.parse_one('{"name":"none","version":1}') == ("none@1", [], [], [])


@pytest.mark.parametrize(
    ("content", "refusal"),
    [
        (None, ("", "not_json")), ("", ("", "not_json")), ("{", ("", "not_json")), ("[" * 100_000, ("", "not_json")), ("[]", ("", "not_an_object")), ('{"name":"a"}', ("version", "missing_key")),
        (changed(["version"], True), ("version", "wrong_type")), (changed(["version"], 0), ("version", "too_small")), (changed(["name"], ""), ("name", "empty")), (changed(["colour"], 1), ("colour", "unknown_key")),
        (changed(["fields"], {}), ("fields", "wrong_type")), (changed(["fields", 0], 5), ("fields.0", "not_an_object")), (changed(["fields", 0, "type"], "money"), ("fields.0.type", "unknown_word")),
        (changed(["fields", 0, "cardinality"], "several"), ("fields.0.cardinality", "unknown_word")), (changed(["fields", 4, "fields", 0, "required"], "yes"), ("fields.4.fields.0.required", "wrong_type")),
        (changed(["fields", 4, "fields", 0, "size"], 1), ("fields.4.fields.0.size", "unknown_key")), (changed(["rules", 0, "operands"], [1]), ("rules.0.operands", "wrong_type")), (changed(["rules", 0, "operator"], "~"), ("rules.0.operator", "unknown_word")),
        (changed(["rules", 0, "tolerance"], "much"), ("rules.0.tolerance", "wrong_type")), (changed(["fields", 0, "constraints", "pattern"], "(a)\\1"), ("ship", "pattern_refused")), (changed(["fields", 0, "constraints", "pattern"], 1), ("ship", "constraint_value")),
        (changed(["fields", 0, "constraints", "min_length"], 1.5), ("ship", "constraint_value")), (changed(["fields", 0, "constraints", "min_length"], -1), ("ship", "constraint_value")), (changed(["fields", 1, "constraints", "enum"], "1,2"), ("berths", "constraint_value")),
        (changed(["fields", 1, "constraints", "enum"], []), ("berths", "constraint_value")), (changed(["fields", 1, "constraints", "multiple_of"], 0), ("berths", "constraint_value")), (changed(["fields", 2, "constraints", "minimum"], "31.1.2020"), ("left", "constraint_value")),
        (changed(["fields", 3, "fields", 0, "constraints", "const"], []), ("owner.open", "constraint_value")), (changed(["fields", 5, "name"], "ship"), ("ship", "repeated_name")), (changed(["rules", 0, "operands"], ["loads.tons", "owner"]), ("sum", "operand_is_group")),
        (changed(["rules"], GOOD["rules"] * 2), ("sum", "repeated_rule")), (changed(["rules", 0, "kind"], "odd"), ("sum", "unknown_kind")),
    ],
)
def test_authoring_errors(content, refusal):
    name, fields, rules, refusals = A.parse_one(content if content is None or isinstance(content, str) else json.dumps(content))
    assert refusal in refusals and not fields and not rules


def test_folder(spark, tmp_path):
    root = tmp_path / "schemas"
    (root / "prompts").mkdir(parents=True)
    for stem, payload, prompt in (("a", GOOD, "Read.\nWell."), ("b", changed(["version"], 4), " \n\t"), ("c", changed(["version"], 5), None), ("d", changed(["name"], "twin"), "x"), ("e", changed(["name"], "twin"), "y"), ("f", changed(["fields", 0, "type"], "money") | {"version": 6}, "z")):
        (root / f"{stem}.json").write_text(json.dumps(payload, indent=1))
        if prompt is not None:
            (root / "prompts" / f"{stem}.md").write_text(prompt)
    (root / "broken.json").write_text("{\n")
    (root / "prompts" / "nested.json").write_text("{")
    (root / "notes.txt").write_text("x")
    got = A.load(spark, str(root))
    rows = {(r["path"].rsplit("/", 1)[1], r["at"], r["problem"]) for r in A.refusals(got).collect()}
    assert rows == {
        ("b.json", "berth@4", "empty_prompt"), ("c.json", "berth@5", "no_prompt"), ("d.json", "twin@3", "repeated_identity"), ("e.json", "twin@3", "repeated_identity"),
        ("f.json", "fields.0.type", "unknown_word"), ("broken.json", "", "not_json"),
    }
    good = A.accepted(got).collect()
    assert [(r["schema_identity"], r["prompt"]) for r in good] == [("berth@3", "Read.\nWell.")]
    assert A.field_table(A.accepted(got)).count() == 8 and A.rule_table(A.accepted(got)).count() == 1


def test_no_files(spark):
    none = A.parsed(spark.createDataFrame([], "path string, content string, refusals int"))
    assert A.refusals(none).count() == 0 and A.accepted(none).count() == 0
