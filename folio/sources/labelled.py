"""Folders of labelled sets as rows: parsed within tasks, and every authoring error a row.

A set is a folder: manifest.json lists its documents and the keys by which entries of groups are aligned, labels/<document>.json has a document's
labels (colons of its id are underscores), restricted.json those of restricted documents, by the hash of their content. Files are read by
Spark and parsed one at a time in tasks. What concerns several files is joined and grouped by set and document. A set whose manifest
can't be read is told so, and nothing is held against it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.lineage import dealt

#: Keys of a manifest's documents, of their origins, of alignment keys and of labels, with their values' types; those that must stand.
DOCUMENT_KEYS = {"document_id": str, "blob_sha256": str, "tier": str, "origin": dict, "schema_identity": str, "schema_hash": str, "path": str, "declared_label_count": int}
ORIGIN_KEYS = {"kind": str, "basis": str, "source": str, "generator_id": str, "generator_version": str}
ENTRY_KEYS = {"group_path": str, "key_field": str}
LABEL_KEYS = {"field_path": str, "expectation": str, "value": object, "location": dict, "labeler": str, "labeled_at": str}
NEEDED = {"document_id", "blob_sha256", "tier", "origin", "schema_identity", "schema_hash", "kind", "basis", "group_path", "key_field", "field_path", "expectation"}
OPTIONAL = {"path", "source", "generator_id", "generator_version", "value", "location", "labeler", "labeled_at"}
TIERS = ("public", "restricted")
ORIGINS = ("synthetic", "public_domain", "licensed", "restricted")
EXPECTATIONS = ("value", "absent")

DOCUMENTS = "array<struct<document_id:string,blob_sha256:string,tier:string,schema_identity:string,doc_path:string,declared:long,ok:boolean>>"
LABELS = "array<struct<name:string,field_path:string,expectation:string,value:string,value_kind:string,ok:boolean>>"
REFUSALS = "array<struct<document_id:string,at:string,problem:string>>"
PARSED = f"set_path string, kind string, name string, documents {DOCUMENTS}, entry_keys array<struct<group_path:string,key_field:string>>, labels {LABELS}, refusals {REFUSALS}"

Wrong = list[tuple[str, str]]


def shape(value: Any, keys: dict[str, type]) -> Wrong:
    """What an object's keys and their values' types get wrong: (key, problem)."""
    if not isinstance(value, dict):
        return [("", "not_an_object")]
    out = [(k, "missing_key") for k in keys if k in NEEDED and k not in value]
    for key, given in value.items():
        if key not in keys:
            out.append((key, "unknown_key"))
        elif not (given is None and key in OPTIONAL) and (not isinstance(given, keys[key]) or (isinstance(given, bool) and keys[key] is int)):
            out.append((key, "wrong_type"))
    return out


def document_problems(entry: Any) -> Wrong:
    """What is wrong with a manifest's entry by itself."""
    out = shape(entry, DOCUMENT_KEYS)
    if out:
        return out
    origin = entry["origin"]
    wrong = [(f"origin.{k}".rstrip("."), p) for k, p in shape(origin, ORIGIN_KEYS)]
    if entry["tier"] not in TIERS:
        out.append(("tier", "unknown_word"))
    if not wrong:
        if origin["kind"] not in ORIGINS:
            wrong.append(("origin.kind", "unknown_word"))
        if not origin["basis"].strip():
            wrong.append(("origin.basis", "empty"))
        if origin["kind"] == "synthetic" and not (origin.get("generator_id") and origin.get("generator_version")):
            wrong.append(("origin", "no_generator"))
    return out + wrong


def label_problems(label: Any) -> Wrong:
    """What is wrong with a label by itself: (field path or place, problem)."""
    out = shape(label, LABEL_KEYS)
    if out:
        return out
    at, given = label["field_path"], label.get("value") is not None
    if label["expectation"] not in EXPECTATIONS:
        return [(at, "unknown_word")]
    if given != (label["expectation"] == "value"):
        return [(at, "value_given" if given else "no_value")]
    return []


def value_kind(value: Any) -> str | None:
    """A JSON value's type by name."""
    for kind, name in ((bool, "boolean"), (str, "string"), (int, "integer"), (float, "number"), (dict, "object"), (list, "list")):
        if isinstance(value, kind):
            return name
    return None


def _labels(name: str, given: Any, refusals: list) -> list:
    if not isinstance(given, list):
        refusals.append((name, "", "not_a_list"))
        return []
    out = []
    for i, label in enumerate(given):
        wrong = label_problems(label)
        refusals += [(name, at or str(i), p) for at, p in wrong]
        label = {} if wrong else label
        value = label.get("value")
        out.append((name, label.get("field_path"), label.get("expectation"), value if isinstance(value, str) else None if value is None else json.dumps(value, sort_keys=True), value_kind(value), not wrong))
    return out


def parse_one(kind: str, name: str, content: str | None) -> tuple[list, list, list, list]:
    """A file's documents, alignment keys, labels and refusals (name, place, problem)."""
    own = name if kind == "labels" else None
    try:
        payload = json.loads(content or "")
    except (ValueError, RecursionError):
        return [], [], [], [(own, "", "not_json")]
    refusals: list = []
    if kind == "labels":
        return [], [], _labels(name, payload, refusals), refusals
    if not isinstance(payload, dict):
        return [], [], [], [(own, "", "not_an_object")]
    if kind == "restricted":
        return [], [], [x for blob, given in payload.items() for x in _labels(blob, given, refusals)], refusals
    documents, keys = [], []
    for part in ("documents", "entry_keys"):
        if not isinstance(payload.get(part, []), list):
            return [], [], [], [(None, part, "not_a_list")]
    for i, entry in enumerate(payload.get("documents", [])):
        wrong, e = document_problems(entry), entry if isinstance(entry, dict) else {}
        text = lambda k: e.get(k) if isinstance(e.get(k), str) else None  # noqa: B023, E731
        refusals += [(text("document_id"), at or f"documents.{i}", p) for at, p in wrong]
        count = e.get("declared_label_count", 0)
        documents.append((text("document_id"), text("blob_sha256"), text("tier"), text("schema_identity"), text("path"), None if wrong else count, not wrong))
    for i, entry in enumerate(payload.get("entry_keys", [])):
        wrong = shape(entry, ENTRY_KEYS)
        refusals += [(None, f"entry_keys.{i}.{at}".rstrip("."), p) for at, p in wrong]
        if not wrong:
            keys.append((entry["group_path"], entry["key_field"]))
    return documents, keys, [], refusals


def parsed(files: DataFrame) -> DataFrame:
    """Files (path, content) as rows, one each; other files than those of sets are passed over."""
    path = F.col("path")
    kind = F.when(path.endswith("/manifest.json"), "manifest").when(path.endswith("/restricted.json"), "restricted").when(path.rlike(r"/labels/[^/]+\.json\z"), "labels")
    given = files.select(F.regexp_replace("path", r"(/labels)?/[^/]*\z", "").alias("set_path"), kind.alias("kind"), F.regexp_extract("path", r"([^/]*)\.json\z", 1).alias("name"), "content").where("kind IS NOT NULL")
    names = ("document_id", "blob_sha256", "tier", "schema_identity", "doc_path", "declared", "ok"), ("group_path", "key_field"), ("name", "field_path", "expectation", "value", "value_kind", "ok"), ("document_id", "at", "problem")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [parse_one(*x) for x in zip(batch["kind"], batch["name"], batch["content"], strict=True)]
            lists = [[[dict(zip(n, r, strict=True)) for r in m[i]] for m in made] for i, n in enumerate(names)]
            yield pd.DataFrame({"set_path": batch["set_path"], "kind": batch["kind"], "name": batch["name"], "documents": lists[0], "entry_keys": lists[1], "labels": lists[2], "refusals": lists[3]})

    return given.mapInPandas(each, PARSED)


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The files of every set directly below a folder, as `parsed` gives them."""
    root = folder.rstrip("/")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return parsed(rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def documents(files: DataFrame) -> DataFrame:
    """Documents of all manifests: set_path, document_id, blob_sha256, tier, schema_identity, doc_path, declared, ok."""
    return files.where("kind = 'manifest'").select("set_path", F.explode("documents").alias("_d")).select("set_path", "_d.*")


def labels(files: DataFrame) -> DataFrame:
    """Labels with the documents that they belong to, by file name or, for restricted ones, by content: set_path, document_id, schema_identity, declared, field_path, expectation, value, value_kind, ok."""
    given = files.where("kind <> 'manifest'").select("set_path", (F.col("kind") == "restricted").alias("_bundle"), F.explode("labels").alias("_l")).select("set_path", "_bundle", "_l.*")
    return given.join(dealt(_owners(files)), ["set_path", "_bundle", "name"]).drop("_bundle", "name")


def _owners(files: DataFrame) -> DataFrame:
    """Each document by the name under which its labels come; of one that stands twice, one."""
    bundle = F.col("tier") == "restricted"
    docs = documents(files).where("document_id IS NOT NULL").select("set_path", F.coalesce(bundle, F.lit(False)).alias("_bundle"), F.when(bundle, F.col("blob_sha256")).otherwise(F.replace("document_id", F.lit(":"), F.lit("_"))).alias("name"), "document_id", "schema_identity", "declared")
    return docs.dropDuplicates(["set_path", "_bundle", "name"])


def carried(value: Column, kind: Column, declared: Column) -> Column:
    """Whether a declared type can hold a JSON value as it is written; unknown types hold none."""
    day, text = r"\A\d{4}-\d{2}-\d{2}", kind == "string"
    return F.coalesce(
        F.when(declared.isin("string", "boolean"), kind == declared).when(declared.isin("int", "integer"), kind == "integer").when(declared == "number", kind.isin("integer", "number"))
        .when(declared == "decimal", text & value.rlike(r"(?i)\A\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|s?nan\d*)\s*\z"))
        .when(declared == "date", text & value.rlike(day + r"\z") & value.try_cast("date").isNotNull())
        .when(declared == "datetime", text & value.rlike(day + r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?\z") & F.substring(value, 1, 10).try_cast("date").isNotNull()),
        F.lit(False),
    )


def refusals(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Every authoring error: set_path, document_id, at, problem.

    files come from `parsed`, best checkpointed, as each kind of error reads them; facts are fields of schemas (schema_identity, path, type, groups included). Without facts, or for a schema
    that they lack, paths, values and scalar keys are not asked for.
    """
    row = lambda df, document, at, problem: df.select("set_path", document.alias("document_id"), at.alias("at"), F.lit(problem).alias("problem"))
    none, doc, path = F.lit(None).cast("string"), F.col("document_id"), F.col("field_path")
    own = files.select("set_path", F.explode("refusals").alias("_r")).select("set_path", "_r.*")
    docs = documents(files)
    good = docs.where("ok")
    twice = docs.where("document_id IS NOT NULL").groupBy("set_path", "document_id").count().where("count > 1")
    named = files.where("kind = 'labels'").select("set_path", F.lit(False).alias("_bundle"), "name")
    blobs = files.where("kind = 'restricted'").select("set_path", F.lit(True).alias("_bundle"), F.explode(F.array_distinct(F.transform("labels", lambda x: x["name"]))).alias("name"))
    # A file beside the manifest for a restricted document is not read, so it is no stranger.
    read = files.where("kind = 'manifest' AND NOT exists(refusals, x -> x.problem IN ('not_json', 'not_an_object', 'not_a_list'))").select("set_path")
    owners = _owners(files).select("set_path", "_bundle", "name").unionByName(docs.where("tier = 'restricted'").select("set_path", F.lit(False).alias("_bundle"), F.replace("document_id", F.lit(":"), F.lit("_")).alias("name")))
    lost = named.unionByName(blobs).join(dealt(read), "set_path", "left_semi").join(dealt(owners), ["set_path", "_bundle", "name"], "left_anti")
    given = labels(files)
    short = given.where("declared IS NOT NULL").groupBy("set_path", "document_id", "declared").count().where("count <> declared")
    well = given.where("ok")
    again = well.groupBy("set_path", "document_id", "field_path").count().where("count > 1")
    keys = files.where("kind = 'manifest'").select("set_path", F.explode("entry_keys").alias("_k")).select("set_path", "_k.*")
    entry = path.startswith(F.concat("group_path", F.lit("["))) & path.endswith(F.concat(F.lit("."), F.col("key_field")))
    same = well.join(dealt(keys.distinct()), "set_path").where(entry).groupBy("set_path", "document_id", "group_path", "key_field", "value_kind", "value").count().where("count > 1")
    key_path = F.concat_ws(".", "group_path", "key_field")
    out = (
        own.unionByName(row(twice, doc, none, "repeated_document"))
        .unionByName(row(good.where("tier = 'public' AND coalesce(doc_path, '') = ''"), doc, F.lit("path"), "public_without_path")).unionByName(row(good.where("tier = 'restricted' AND doc_path <> ''"), doc, F.lit("path"), "restricted_with_path"))
        .unionByName(row(lost.where("NOT _bundle"), F.col("name"), none, "unknown_document")).unionByName(row(lost.where("_bundle"), none, F.col("name"), "unknown_blob"))
        .unionByName(row(short, doc, none, "label_count")).unionByName(row(again, doc, path, "repeated_label"))
        .unionByName(row(keys.groupBy("set_path", "group_path").count().where("count > 1"), none, F.col("group_path"), "repeated_key")).unionByName(row(same, doc, key_path, "repeated_key_value").distinct())
    )
    if facts is None:
        return out
    known = facts.select("schema_identity").distinct()
    typed = well.withColumn("path", T.strip_indices(path)).join(known, "schema_identity", "left_semi").join(facts.select("schema_identity", "path", "type"), ["schema_identity", "path"], "left")
    unfit = typed.where((F.col("expectation") == "value") & F.col("type").isNotNull() & ~carried(F.col("value"), F.col("value_kind"), F.col("type")))
    asked = keys.distinct().join(dealt(good.select("set_path", "schema_identity").distinct()), "set_path").join(known, "schema_identity", "left_semi").withColumn("path", key_path)
    odd = asked.join(facts.where("type <> 'group'").select("schema_identity", "path"), ["schema_identity", "path"], "left_anti")
    return out.unionByName(row(typed.where("type IS NULL"), doc, path, "unresolved_path").distinct()).unionByName(row(unfit, doc, path, "value_not_carried").distinct()).unionByName(row(odd, none, F.col("path"), "key_not_scalar").distinct())


def accepted(files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """The files of sets without any refusal: a set is taken whole or not at all."""
    return files.join(dealt(refusals(files, facts).select("set_path").distinct()), "set_path", "left_anti")
