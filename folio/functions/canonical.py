"""Canonical JSON and the identities made of it.

`canonical_json` is for small values on the driver (options, schemas, prompts); rows use expressions of functions.text and
those below. Keys are sorted, there are no spaces, text is in composed form and not escaped beyond what JSON asks for, and
numbers are finite.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions.text import canonical, content_id


def composed(value: Any) -> Any:
    """The value with its texts composed; a number that isn't finite and a key that isn't text are refused."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, bool) or value is None or isinstance(value, int):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number isn't finite")
        return value
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("a key isn't text")
        out = {composed(k): composed(v) for k, v in value.items()}
        if len(out) < len(value):
            raise ValueError("two keys are one when composed")
        return out
    if isinstance(value, (list, tuple)):
        return [composed(v) for v in value]
    raise ValueError(f"no JSON form: {type(value).__name__}")


def canonical_json(value: Any) -> bytes:
    return json.dumps(composed(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def identity_of(value: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(value)).hexdigest()


def options_hash(options: dict[str, Any]) -> str:
    return identity_of(options)


def prompt_hash(prompt: str) -> str:
    return identity_of({"prompt": prompt})


def prompt_hash_of(prompt: Column) -> Column:
    """The same on rows; composition has no built-in function."""
    def composed_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    compose = F.pandas_udf(composed_texts, "string")
    return content_id(canonical(prompt=F.when(prompt.rlike(r"\A[\x00-\x7F]*\z"), prompt).otherwise(compose(prompt))))


def schema_hash(schema: dict[str, Any]) -> str:
    """Fields by name at every depth and rules by id, so that their order doesn't count; without rules there is no such key.

    Name and version are left out: a new version that changes nothing has the same hash.
    """

    def by_name(fields: list[dict[str, Any]]) -> list[dict[str, Any]]:
        return sorted(({**f, "fields": by_name(f["fields"])} if f.get("fields") else f for f in fields), key=lambda f: f["name"])

    out = {"fields": by_name(schema["fields"])}
    if schema.get("rules"):
        out["rules"] = sorted(schema["rules"], key=lambda r: r["id"])
    return identity_of(out)


#: What the hash of an extraction's options is made of.
EXTRACTION_OPTIONS = ("schema_identity", "schema_hash", "prompt_hash", "projection_id", "model_id", "model_version", "max_output_tokens", "temperature", "top_p", "top_k", "seed", "thinking_budget", "input_budget_tokens")


def extraction_options_hash(**options: Any) -> str:
    """The hash of all options that shape an extraction; one left out is null."""
    unknown = set(options) - set(EXTRACTION_OPTIONS)
    if unknown:
        raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
    return identity_of({name: options.get(name) for name in EXTRACTION_OPTIONS})


def artifact_chain(document_id: Column, extraction: tuple[str, str, str], grounding: tuple[str, str, str], validation: tuple[str, str, str]) -> dict[str, Column]:
    """The ids of a document's three artifacts, each of its input, processor, version and options hash."""
    out, source = {}, document_id
    for name, (processor, version, options) in {"extraction_id": extraction, "grounding_id": grounding, "validation_id": validation}.items():
        source = content_id(canonical(input=source, processor_id=F.lit(processor), processor_version=F.lit(version), options_hash=F.lit(options)))
        out[name] = source
    return out


def report_id(golden_set: Column, prediction_set: Column, options: str) -> Column:
    return content_id(canonical(golden_set_id=golden_set, prediction_set_id=prediction_set, options_hash=F.lit(options)))


def orientation_id(document_id: Column) -> Column:
    """The id of the record of a document's page turns."""
    return content_id(canonical(document_id=document_id, kind=F.lit("orientation"), v=F.lit("1")))
