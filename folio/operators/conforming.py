"""Conforming: do model payloads have the declared shape and types?

rows(document_id, payload) hold one JSON object each. A scalar is an object of value, claimed_text and (optionally)
confidence; a missing value is null, a missing key refuses the payload. A payload is parsed once and becomes a row for each of its
declared fields; groups are opened a level at a time, and all scalars are held to their types in one place: document_id, ordinal, field_path, type, value (as text), claimed_text, present, problem.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.payloads import typed
from folio.sources.schemas import walk

#: The JSON kinds that a declared type may have.
JSON_KINDS = {"string": ("STRING",), "int": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE"), "decimal": ("STRING",), "boolean": ("BOOLEAN",), "date": ("STRING",), "datetime": ("STRING",)}


def at(tree: Column, name: str) -> Column:
    """A key's value, or null where the key is missing; a null value is a variant of its own."""
    return F.try_variant_get(tree, f"$.{name}", "variant")


def kind(tree: Column) -> Column:
    """The JSON kind: OBJECT, ARRAY, VOID, STRING, BOOLEAN, BIGINT, DECIMAL or DOUBLE."""
    return F.substring_index(F.substring_index(F.schema_of_variant(tree), "(", 1), "<", 1)


def is_triple(tree: Column) -> Column:
    return at(tree, "value").isNotNull() & at(tree, "claimed_text").isNotNull()


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns added behind a generated row, so that what reads them doesn't make them again."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns, *(c.alias(n) for n, c in columns.items())))).alias("_x")).select("_x.*")


def node(ordinal: int, path: Column, kind_: str, tree: Column, group: int | None = None, problem: str | None = None) -> Column:
    """A place of a payload: `group` names the group, or the entry of one, whose members are still to be read."""
    return F.struct(
        F.lit(ordinal).alias("ordinal"), path.alias("field_path"), F.lit(kind_).alias("type"), F.lit(group).cast("int").alias("_g"), tree.alias("_tree"), F.lit(problem).cast("string").alias("_problem"),
    )


def refused(path: Column, ordinal: int, problem: str) -> Column:
    return node(ordinal, path, "group", F.lit(None).cast("variant"), problem=problem)


def members(tree: Column, fields: list[dict[str, Any]], ordinals: dict[str, int], declared: str, prefix: Column | None) -> Column:
    """An array of the places of an object's fields."""
    out = []
    for f in fields:
        ordinal = ordinals[f"{declared}{f['name']}"]
        label = F.lit(f["name"]) if prefix is None else F.concat(prefix, F.lit(f".{f['name']}"))
        group = ordinal if f.get("fields") else None
        out.append(node(ordinal, label, f.get("type") if group is None else "group", at(tree, f["name"]), group))
    return F.array(*out)


def opened(field: dict[str, Any], ordinals: dict[str, int], path: str) -> list[tuple[int, Column]]:
    """What takes the place of a group and, if it repeats, of each of its entries: a group that isn't one gives its problem."""
    ordinal, label, tree = ordinals[path], F.col("field_path"), F.col("_tree")
    wrong = F.when(tree.isNull(), F.array(refused(label, ordinal, "missing_field"))).when(is_triple(tree), F.array(refused(label, ordinal, "scalar_for_group")))
    inner, shape = members(tree, field["fields"], ordinals, f"{path}.", label), F.array(refused(label, ordinal, "wrong_shape"))
    if field.get("cardinality") != "many":
        return [(ordinal, wrong.when(kind(tree) != "OBJECT", shape).otherwise(inner))]
    # Entries are numbered after all fields. Only an array is read as one.
    entry = lambda e, i: node(ordinal, F.concat(label, F.lit("["), i.cast("string"), F.lit("]")), "group", e, len(ordinals) + ordinal)
    entries = F.transform(F.try_variant_get(tree, "$", "array<variant>"), entry)
    return [(ordinal, F.coalesce(wrong.otherwise(entries), shape)), (len(ordinals) + ordinal, inner)]


def openings(fields: list[dict[str, Any]], ordinals: dict[str, int], prefix: str = "") -> list[list[tuple[int, Column]]]:
    """The steps in which groups are opened, outer ones first: one for each level, two where it repeats."""
    steps: list[list[tuple[int, Column]]] = []
    for f in fields:
        if not f.get("fields"):
            continue
        path = f"{prefix}{f['name']}"
        for i, made in enumerate([[x] for x in opened(f, ordinals, path)] + openings(f["fields"], ordinals, f"{path}.")):
            if i == len(steps):
                steps.append([])
            steps[i] += made
    return steps


def scalars(places: DataFrame) -> DataFrame:
    """Each place as a row: a scalar's value if it is of the declared type, else what is wrong."""
    tree, value, claimed = F.col("_tree"), F.col("_value"), F.col("_claimed")
    rows = once(places, _value=at(tree, "value"), _claimed=at(tree, "claimed_text"))
    text = lambda v: F.try_variant_get(v, "$", "string")
    rows = once(rows, _kind=kind(value), _claimed_kind=kind(claimed), _text=text(value), _claimed_text=text(claimed))
    fits = F.lit(False)
    for declared, kinds in JSON_KINDS.items():
        fits = F.when(F.col("type") == declared, F.col("_kind").isin(*kinds) & typed(F.col("_text"), declared).isNotNull()).otherwise(fits)
    problem = (
        F.when(F.col("_problem").isNotNull(), F.col("_problem"))
        .when(tree.isNull(), "missing_field")
        # What has both keys is an object.
        .when(value.isNull() | claimed.isNull(), F.when(kind(tree) != "OBJECT", "wrong_shape").otherwise("missing_key"))
        .when(~F.col("_claimed_kind").isin("STRING", "VOID"), "wrong_shape")
        .when((F.col("_kind") != "VOID") & ~fits, "wrong_type")
    )
    rows = once(rows.select("document_id", "ordinal", "field_path", "type", "_kind", "_text", "_claimed_text", problem.alias("problem")))
    sound = F.col("problem").isNull() & (F.col("_kind") != "VOID")
    return rows.select("document_id", "ordinal", "field_path", "type", F.when(sound, F.col("_text")).alias("value"), F.when(F.col("problem").isNull(), F.col("_claimed_text")).alias("claimed_text"), F.coalesce(sound, F.lit(False)).alias("present"), "problem")


def conformed(rows: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """Every declared field of every payload; a payload that isn't an object is one refused row."""
    ordinals = {path: i for i, (path, _, _) in enumerate(walk(schema["fields"]))}
    tree = F.col("_t")
    # Of a payload that can be parsed the first sign tells whether it is an object.
    trees = once(rows.select("document_id", "payload"), _t=F.try_parse_json("payload"))
    whole = F.when(tree.isNotNull() & F.col("payload").rlike(r"\A\s*\{"), members(tree, schema["fields"], ordinals, "", None)).otherwise(F.array(refused(F.lit(""), -1, "not_an_object")))
    places = trees.select("document_id", F.explode(whole).alias("_f")).select("document_id", "_f.*")
    own = F.array(F.struct(*(c for c in places.columns if c != "document_id")))
    for step in openings(schema["fields"], ordinals):
        taken = own
        for group, inner in step:
            taken = F.when(F.col("_g") == group, inner).otherwise(taken)
        places = places.select("document_id", F.explode(taken).alias("_f")).select("document_id", "_f.*")
    return scalars(places)


def refusals(fields: DataFrame) -> DataFrame:
    """The first problem of each refused payload: document_id, field_path, problem."""
    by = Window.partitionBy("document_id").orderBy("ordinal", "field_path")
    return fields.where("problem IS NOT NULL").withColumn("_r", F.row_number().over(by)).where("_r = 1").select("document_id", "field_path", "problem")


def presence(fields: DataFrame) -> DataFrame:
    """How many declared fields of each payload are present and absent."""
    return fields.groupBy("document_id").agg(F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("absent"))


def discarded(rows: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """Keys that the schema doesn't declare: document_id, key."""
    declared = F.array(*(F.lit(f["name"]) for f in schema["fields"]))
    return rows.select("document_id", F.explode(F.array_except(F.json_object_keys("payload"), declared)).alias("key"))


def at_path(fields: DataFrame, path: str) -> DataFrame:
    """The value at a path of each payload: document_id, value."""
    return fields.where(F.col("field_path") == path).select("document_id", "value")


# Registries of schemas


def merged_registry(files: DataFrame, console: DataFrame) -> DataFrame:
    """Schemas by identity: a valid one of the console stands before that of a file; shadowed tells that both have it."""
    mine = console.where("valid").select("schema_identity", F.col("prompt").alias("_p"))
    rows = files.select("schema_identity", F.col("prompt").alias("_f")).join(mine, "schema_identity", "full_outer")
    return rows.select("schema_identity", F.coalesce("_p", "_f").alias("prompt"), F.when(F.col("_p").isNotNull(), "console").otherwise("file").alias("source"), (F.col("_p").isNotNull() & F.col("_f").isNotNull()).alias("shadowed"))


def resolved(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The schema of each request by its exact name and version, or why there is none: no latest one is guessed."""
    sound = F.col("schema_identity").rlike(r"\A.+@[0-9]+\z")
    # A registry is a list of declared schemas, each a file or a row written by hand.
    rows = requests.join(F.broadcast(registry), "schema_identity", "left")
    reason = F.when(~sound, "bad_identity").when(F.col("prompt").isNull(), "unknown_schema")
    return rows.withColumn("refusal", reason)


def next_version(console: DataFrame) -> DataFrame:
    """The version a new schema of each name would get."""
    name, version = F.regexp_extract("schema_identity", r"^(.+)@([0-9]+)$", 1), F.regexp_extract("schema_identity", r"^(.+)@([0-9]+)$", 2).cast("int")
    return console.groupBy(name.alias("name")).agg((F.max(version) + 1).alias("next_version"))


def requested(rows: DataFrame, prompt: str, budget: int) -> DataFrame:
    """Model requests: the prompt, then the text, refused beyond the token budget. rows(document_id, text, tokens)."""
    return rows.select("document_id", F.concat(F.lit(prompt), F.lit("\n\n"), F.col("text")).alias("request"), F.when(F.col("tokens") > budget, "input_budget").alias("refusal"))
