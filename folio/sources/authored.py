"""Folders of declared schemas and their prompts, as rows: parsed within tasks, and every authoring error a row.

Files stand directly below a folder, one schema each, with its prompt at prompts/<stem>.md. Listing and reading are Spark's, so a folder may be
on any file system that it reads; a task parses the files that it is dealt, one at a time, and the driver none. A file of
another form is refused by its shape alone; only one of the right shape is asked whether its fields and rules make sense.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import pattern
from folio.sources.schemas import NUMERIC, TEMPORAL, identity, problems, walk

#: Keys of declared schemas with the types of their values, those that must stand first.
SCHEMA_KEYS = {"name": str, "version": int, "description": str, "fields": list, "rules": list}
FIELD_KEYS = {"name": str, "type": str, "cardinality": str, "required": bool, "description": str, "constraints": dict, "fields": list}
RULE_KEYS = {"id": str, "kind": str, "operands": list, "operator": str, "tolerance": (int, float, str), "severity": str}
NEEDED = {"schema": ("name", "version"), "field": ("name",), "rule": ("id", "kind", "operands")}
#: The words of files, and the library's for them.
CARDINALITIES = {"scalar": "one", "group": "one", "repeating_group": "many", "one": "one", "many": "many"}
TYPES = {"string": "string", "integer": "int", "int": "int", "number": "number", "boolean": "boolean", "date": "date", "datetime": "datetime", "decimal": "decimal"}
OPERATORS = ("==", "!=", "<", "<=", ">", ">=")

FIELD_COLUMNS = ("ordinal", "path", "name", "type", "cardinality", "required", "description", "constraints", "group_path")
RULE_COLUMNS = ("ordinal", "id", "kind", "operands", "operator", "tolerance")
REFUSAL_COLUMNS = ("at", "problem")
KINDS = {"ordinal": "int", "required": "boolean", "operands": "array<string>"}


def _rows_of(columns: tuple[str, ...]) -> str:
    return f"array<struct<{','.join(f'{c}:{KINDS.get(c, 'string')}' for c in columns)}>>"


PARSED = f"path string, schema_identity string, fields {_rows_of(FIELD_COLUMNS)}, rules {_rows_of(RULE_COLUMNS)}, refusals {_rows_of(REFUSAL_COLUMNS)}"


def files(spark: SparkSession, folder: str, suffix: str = ".json") -> DataFrame:
    """The files directly below a folder: path, content."""
    return spark.read.text(f"{folder.rstrip('/')}/*{suffix}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _shape(value: Any, keys: dict, what: str, at: str) -> list[tuple[str, str]]:
    """What an object's keys and the types of their values get wrong."""
    if not isinstance(value, dict):
        return [(at, "not_an_object")]
    out = [(f"{at}.{k}".lstrip("."), "missing_key") for k in NEEDED[what] if k not in value]
    for key, given in value.items():
        # A truth value is no number here.
        if key not in keys:
            out.append((f"{at}.{key}".lstrip("."), "unknown_key"))
        elif not (given is None and key in ("type", "operator", "severity")) and (not isinstance(given, keys[key]) or (isinstance(given, bool) and keys[key] is not bool)):
            out.append((f"{at}.{key}".lstrip("."), "wrong_type"))
    return out


def _field_shapes(given: list, at: str) -> list[tuple[str, str]]:
    out = []
    for i, f in enumerate(given):
        here = f"{at}.{i}".lstrip(".")
        wrong = _shape(f, FIELD_KEYS, "field", here)
        if not wrong:
            if f.get("type") is not None and f["type"] not in TYPES:
                wrong.append((f"{here}.type", "unknown_word"))
            if f.get("cardinality", "one") not in CARDINALITIES:
                wrong.append((f"{here}.cardinality", "unknown_word"))
            wrong += _field_shapes(f.get("fields") or [], f"{here}.fields")
        out += wrong
    return out


def shape_problems(payload: Any) -> list[tuple[str, str]]:
    """Errors of form, each with its place: keys that are unknown or missing, values of another type, words that aren't any."""
    out = _shape(payload, SCHEMA_KEYS, "schema", "")
    if out:
        return out
    if payload["version"] < 1:
        out.append(("version", "too_small"))
    if not payload["name"]:
        out.append(("name", "empty"))
    out += _field_shapes(payload.get("fields") or [], "fields")
    for i, r in enumerate(payload.get("rules") or []):
        here = f"rules.{i}"
        wrong = _shape(r, RULE_KEYS, "rule", here)
        if not wrong and not all(isinstance(o, str) for o in r["operands"]):
            wrong.append((f"{here}.operands", "wrong_type"))
        if not wrong and r.get("operator") is not None and r["operator"] not in OPERATORS:
            wrong.append((f"{here}.operator", "unknown_word"))
        if not wrong and _number(r.get("tolerance", 0)) is None:
            wrong.append((f"{here}.tolerance", "wrong_type"))
        out += wrong
    return out


def _number(value: Any) -> float | None:
    try:
        out = None if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        return None
    return out if out is not None and math.isfinite(out) else None


def in_own_words(payload: dict[str, Any]) -> dict[str, Any]:
    """The same schema in the library's words; keys without a value go."""

    def field(f: dict[str, Any]) -> dict[str, Any]:
        out = {k: v for k, v in f.items() if v is not None}
        if "type" in out:
            out["type"] = TYPES[out["type"]]
        out["cardinality"] = CARDINALITIES[out.get("cardinality", "one")]
        return out | ({"fields": [field(x) for x in f["fields"]]} if f.get("fields") else {})

    rules = [{k: (_number(v) if k == "tolerance" else v) for k, v in r.items() if v is not None} for r in payload.get("rules") or []]
    return payload | {"fields": [field(f) for f in payload.get("fields") or []], "rules": rules}


def _temporal(value: Any, kind: str) -> bool:
    try:
        (dt.date if kind == "date" else dt.datetime).fromisoformat(value)
    except (TypeError, ValueError):
        return False
    return True


def constraint_problem(key: str, value: Any, kind: str | None) -> str | None:
    """Why a constraint's own value can't be used, or None."""
    whole = isinstance(value, int) and not isinstance(value, bool)
    wrong = {
        "enum": lambda: not isinstance(value, list) or not value,
        "const": lambda: isinstance(value, (list, dict)) or value is None,
        "pattern": lambda: not isinstance(value, str),
        "min_length": lambda: not whole or value < 0,
        "max_length": lambda: not whole or value < 0,
        "multiple_of": lambda: not _number(value),
    }
    if key in ("minimum", "maximum"):
        bad = not _temporal(value, kind) if kind in TEMPORAL else kind in NUMERIC and _number(value) is None
    else:
        bad = wrong[key]() if key in wrong else False
    if bad:
        return "constraint_value"
    if key == "pattern":
        try:
            pattern.matcher(value)
        except pattern.PatternRefused:
            return "pattern_refused"
    return None


def meaning_problems(schema: dict[str, Any]) -> list[tuple[str, str]]:
    """Errors of meaning of a schema of the right form, in the library's words."""
    out = list(problems(schema))
    groups = {}
    for path, f, _ in walk(schema["fields"]):
        groups[path] = bool(f.get("fields"))
        for key, value in (f.get("constraints") or {}).items():
            wrong = constraint_problem(key, value, f.get("type"))
            if wrong:
                out.append((path, wrong))
    ids = [r["id"] for r in schema["rules"]]
    out += [(i, "repeated_rule") for i in sorted({i for i in ids if ids.count(i) > 1})]
    out += [(r["id"], "operand_is_group") for r in schema["rules"] if any(groups.get(o) for o in r["operands"])]
    return out


def parse_one(content: str | None) -> tuple[str | None, list, list, list]:
    """A file's identity, fields, rules and refusals; a refused file has neither fields nor rules."""
    try:
        payload = json.loads(content or "")
    except (ValueError, RecursionError):
        return None, [], [], [("", "not_json")]
    wrong = shape_problems(payload)
    name = identity(payload) if not any(at in ("", "name", "version") for at, _ in wrong) else None
    if wrong:
        return name, [], [], wrong
    schema = in_own_words(payload)
    wrong = meaning_problems(schema)
    if wrong:
        return name, [], [], wrong
    given = lambda f: json.dumps(f.get("constraints") or {}, sort_keys=True, ensure_ascii=False)
    fields = [
        (i, path, f["name"], "group" if f.get("fields") else f["type"], f["cardinality"], bool(f.get("required", False)), f.get("description", ""), given(f), group)
        for i, (path, f, group) in enumerate(walk(schema["fields"]))
    ]
    rules = [(i, r["id"], r["kind"], list(r["operands"]), r.get("operator"), str(r.get("tolerance", 0.0))) for i, r in enumerate(schema["rules"])]
    return name, fields, rules, []


def parsed(rows: DataFrame) -> DataFrame:
    """Files (path, content) as schemas, a row each: path, schema_identity, fields, rules, refusals."""
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [parse_one(c) for c in batch["content"]]
            columns = [[[dict(zip(names, r, strict=True)) for r in m[n]] for m in made] for n, names in enumerate((FIELD_COLUMNS, RULE_COLUMNS, REFUSAL_COLUMNS), 1)]
            yield pd.DataFrame({"path": batch["path"], "schema_identity": [m[0] for m in made], "fields": columns[0], "rules": columns[1], "refusals": columns[2]})

    return rows.select("path", "content").mapInPandas(each, PARSED)


def stem(path: Column) -> Column:
    """A file's name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1)


def with_prompts(schemas: DataFrame, prompts: DataFrame) -> DataFrame:
    """Schemas with the text of their prompts (path, content), by stem."""
    mine = prompts.select(stem(F.col("path")).alias("_stem"), F.col("content").alias("prompt"))
    return schemas.withColumn("_stem", stem(F.col("path"))).join(mine, "_stem", "left").drop("_stem")


def refusals(schemas: DataFrame) -> DataFrame:
    """Every authoring error: path, at, problem. Two files of one identity are both refused, as is a schema without a prompt or with a blank one.

    schemas come from `parsed`; prompts are asked for where there is a column of them.
    """
    own = schemas.select("path", F.explode("refusals").alias("_r")).select("path", "_r.*")
    twice = schemas.where("schema_identity IS NOT NULL").groupBy("schema_identity").agg(F.count("*").alias("_n")).where("_n > 1")
    out = own.unionByName(schemas.join(twice, "schema_identity").select("path", F.col("schema_identity").alias("at"), F.lit("repeated_identity").alias("problem")))
    if "prompt" in schemas.columns:
        blank = F.when(F.col("prompt").isNull(), "no_prompt").when(F.trim(F.regexp_replace("prompt", r"\s", " ")) == "", "empty_prompt")
        out = out.unionByName(schemas.where("schema_identity IS NOT NULL").select("path", F.col("schema_identity").alias("at"), blank.alias("problem")).where("problem IS NOT NULL"))
    return out


def accepted(schemas: DataFrame) -> DataFrame:
    """The schemas without any refusal."""
    return schemas.join(refusals(schemas).select("path").distinct(), "path", "left_anti")


def field_table(schemas: DataFrame) -> DataFrame:
    """A row for each field: schema_identity, ordinal, path, name, type, cardinality, required, description, constraints (JSON), group_path."""
    return schemas.select("schema_identity", F.explode("fields").alias("_f")).select("schema_identity", "_f.*")


def rule_table(schemas: DataFrame) -> DataFrame:
    """A row for each rule."""
    return schemas.select("schema_identity", F.explode("rules").alias("_r")).select("schema_identity", "_r.*")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The schemas of a folder with their prompts; see `refusals` and `accepted`."""
    return with_prompts(parsed(files(spark, folder)), files(spark, f"{folder.rstrip('/')}/prompts", ".md"))
