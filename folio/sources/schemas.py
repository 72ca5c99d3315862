"""Declared schemas: small JSON documents, read on the driver, as rows of fields and as the problems they have."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: The types a constraint goes with.
TEMPORAL, NUMERIC = ("date", "datetime"), ("int", "number", "decimal")
DOMAINS = {
    "enum": ("string", *NUMERIC), "const": ("string", "boolean", *NUMERIC), "pattern": ("string",), "minimum": (*NUMERIC, *TEMPORAL), "maximum": (*NUMERIC, *TEMPORAL),
    "multiple_of": NUMERIC, "min_length": ("string", "group"), "max_length": ("string", "group"),
}
FIELDS = "schema_identity string, ordinal int, path string, name string, type string, cardinality string, required boolean, description string, constraints map<string,string>, group_path string"


def walk(fields: list[dict[str, Any]], prefix: str = "", group: str | None = None):
    """Every field before its children, in declared order: (path, field, path of the repeating group around it)."""
    for f in fields:
        path = f"{prefix}{f['name']}"
        yield path, f, group
        inner = path if f.get("cardinality") == "many" else group
        yield from walk(f.get("fields") or [], f"{path}.", inner)


def identity(schema: dict[str, Any]) -> str:
    return f"{schema['name']}@{schema['version']}"


def parse_identity(text: str) -> tuple[str, int]:
    found = re.fullmatch(r"(.+)@([0-9]+)", text)
    if not found:
        raise ValueError(f"not a schema identity: {text}")
    return found[1], int(found[2])


def field_rows(spark: SparkSession, schemas: list[dict[str, Any]]) -> DataFrame:
    """The fields of schemas, a row each."""
    rows = []
    for s in schemas:
        for i, (path, f, group) in enumerate(walk(s["fields"])):
            kind = "group" if f.get("fields") else f.get("type")
            given = {k: str(v) for k, v in (f.get("constraints") or {}).items()}
            rows.append((identity(s), i, path, f["name"], kind, f.get("cardinality", "one"), bool(f.get("required", False)), f.get("description"), given, group))
    return spark.createDataFrame(rows, FIELDS)


def problems(schema: dict[str, Any]) -> list[tuple[str, str]]:
    """What is wrong with a schema: (path, problem)."""
    out, paths = [], {}
    for path, f, group in walk(schema["fields"]):
        children, kind = f.get("fields"), f.get("type")
        if path in paths:
            out.append((path, "repeated_name"))
        paths[path] = (f, group)
        if not re.fullmatch(r"[a-z][a-z0-9_]*", f["name"]):
            out.append((path, "bad_name"))
        if bool(children) == bool(kind):
            out.append((path, "group_or_type"))
        if group and f.get("cardinality") == "many":
            out.append((path, "nested_repetition"))
        for key in f.get("constraints") or {}:
            if key not in DOMAINS:
                out.append((path, "unknown_constraint"))
            elif ("group" if children else kind) not in DOMAINS[key]:
                out.append((path, "constraint_type"))
    for rule in schema.get("rules") or []:
        out += [(rule["id"], p) for p in rule_problems(rule, paths)]
    return out


ARITY = {"sum_equals": 2, "product_equals": 3, "comparison": 2, "conditional_presence": 2}


def rule_problems(rule: dict[str, Any], paths: dict) -> list[str]:
    """What is wrong with a rule: its kind, its operands, their groups and their types."""
    kind, operands = rule["kind"], rule["operands"]
    if kind not in ARITY:
        return ["unknown_kind"]
    if len(operands) != ARITY[kind]:
        return ["arity"]
    if any(o not in paths for o in operands):
        return ["unknown_operand"]
    out = []
    groups, types = [paths[o][1] for o in operands], [paths[o][0].get("type") for o in operands]
    if kind == "sum_equals":
        if groups[0] is None or groups[1] is not None:
            out.append("scope")
    elif len(set(groups)) > 1:
        out.append("scope")
    if kind in ("sum_equals", "product_equals") and any(t not in NUMERIC for t in types):
        out.append("operand_type")
    if kind == "comparison" and (len(set(types)) > 1 or types[0] == "boolean"):
        out.append("operand_type")
    if (kind == "comparison") != ("operator" in rule):
        out.append("operator")
    if rule.get("tolerance", 0) < 0:
        out.append("tolerance")
    return out


def response_shape(schema: dict[str, Any]) -> dict[str, Any]:
    """The JSON Schema of an answer: every key required, a scalar as value, claimed text and confidence."""
    names = {"string": "string", "int": "integer", "number": "number", "decimal": "string", "boolean": "boolean", "date": "string", "datetime": "string"}

    def shape(f: dict[str, Any]) -> dict[str, Any]:
        if f.get("fields"):
            one = whole(f["fields"])
        else:
            kept = {k: v for k, v in (f.get("constraints") or {}).items() if k in ("enum", "const")}
            one = {"type": "object", "required": ["value", "claimed_text", "confidence"], "properties": {"value": {"type": [names[f["type"]], "null"], **kept}, "claimed_text": {"type": ["string", "null"]}, "confidence": {"type": ["number", "null"]}}}
        return {"type": "array", "items": one} if f.get("cardinality") == "many" else one

    def whole(fields: list[dict[str, Any]]) -> dict[str, Any]:
        return {"type": "object", "required": [f["name"] for f in fields], "properties": {f["name"]: shape(f) for f in fields}, "additionalProperties": False}

    return whole(schema["fields"])
