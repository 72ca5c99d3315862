import pytest

from folio.sources import schemas as S

VOYAGE = {
    "name": "voyage", "version": 2,
    "fields": [
        {"name": "distance", "type": "decimal", "constraints": {"minimum": 0}}, {"name": "harbour", "type": "string", "constraints": {"enum": ["Bremen", "Porto"]}}, {"name": "arrival", "type": "date"},
        {"name": "stops", "cardinality": "many", "fields": [{"name": "miles", "type": "decimal"}, {"name": "hours", "type": "number"}, {"name": "knots", "type": "decimal"}]},
    ],
    "rules": [{"id": "sum", "kind": "sum_equals", "operands": ["stops.miles", "distance"]}, {"id": "product", "kind": "product_equals", "operands": ["stops.hours", "stops.knots", "stops.miles"]}],
}


def test_fields_in_declared_order(spark):
    rows = S.field_rows(spark, [VOYAGE]).orderBy("ordinal").collect()
    assert [r.path for r in rows] == ["distance", "harbour", "arrival", "stops", "stops.miles", "stops.hours", "stops.knots"]
    assert [r.group_path for r in rows][-3:] == ["stops"] * 3 and rows[3].type == "group" and rows[0].schema_identity == "voyage@2"
    assert S.problems(VOYAGE) == []


@pytest.mark.parametrize(
    ("field", "problem"),
    [
        ({"name": "Distance", "type": "int"}, "bad_name"),
        ({"name": "a", "type": "int", "constraints": {"pattern": "x"}}, "constraint_type"),
        ({"name": "a", "type": "int", "constraints": {"colour": "x"}}, "unknown_constraint"),
        ({"name": "a"}, "group_or_type"),
        ({"name": "distance", "type": "int"}, "repeated_name"),
        ({"name": "g", "cardinality": "many", "fields": [{"name": "h", "cardinality": "many", "fields": [{"name": "x", "type": "int"}]}]}, "nested_repetition"),
    ],
)
def test_field_problems(field, problem):
    assert problem in [p for _, p in S.problems(VOYAGE | {"fields": [*VOYAGE["fields"], field]})]


@pytest.mark.parametrize(
    ("rule", "problem"),
    [
        ({"kind": "sum_equals", "operands": ["distance", "stops.miles"]}, "scope"),
        ({"kind": "comparison", "operands": ["distance", "arrival"], "operator": "lt"}, "operand_type"),
        ({"kind": "comparison", "operands": ["distance", "distance"]}, "operator"),
        ({"kind": "product_equals", "operands": ["distance"]}, "arity"),
        ({"kind": "sum_equals", "operands": ["stops.x", "distance"]}, "unknown_operand"),
        ({"kind": "other", "operands": []}, "unknown_kind"),
    ],
)
def test_rule_problems(rule, problem):
    assert S.problems(VOYAGE | {"rules": [{"id": "r", **rule}]}) == [("r", problem)]


def test_identities_and_shapes():
    assert S.parse_identity("voyage@12") == ("voyage", 12)
    with pytest.raises(ValueError):
        S.parse_identity("voyage@v1")
    shape = S.response_shape(VOYAGE)
    assert shape["required"] == ["distance", "harbour", "arrival", "stops"] and shape["properties"]["stops"]["type"] == "array"
    assert shape["properties"]["harbour"]["properties"]["value"] == {"type": ["string", "null"], "enum": ["Bremen", "Porto"]}
