"""Trees back from rows: the values of a declared schema, a row each, become one JSON tree a document.

fields(document_id, ordinal, field_path, type, value, claimed_text, present) as `conforming.conformed` gives them. Values stand at the
deepest level; a level at a time, the children of each object or array are gathered and become their parent's text, in as many
steps as the schema has levels. A document's values are gathered once, and it is dealt by its id from then on.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.payloads import typed
from folio.sources.schemas import walk

STEP = r"(?:\.?([^.\[\]]+)|\[([0-9]+)\])$"
#: The types whose values are JSON's own words; all others are text.
BARE = ("int", "number", "boolean")
TYPES = {"int": "long", "number": "double", "decimal": "decimal(38,18)", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


def levels(fields: list[dict[str, Any]]) -> int:
    """How many steps the longest path has."""
    return max((1 + (f.get("cardinality") == "many") + levels(f["fields"]) if f.get("fields") else 1 for f in fields), default=0)


def repeated_groups(fields: list[dict[str, Any]], ordinals: dict[str, int], prefix: str = "") -> list[tuple[str, int]]:
    """(path, ordinal) of the repeating groups, which may have no entry."""
    out = []
    for f in fields:
        path = f"{prefix}{f['name']}"
        if f.get("cardinality") == "many":
            out.append((path, ordinals[path]))
        elif f.get("fields"):
            out += repeated_groups(f["fields"], ordinals, f"{path}.")
    return out


def quoted(text: Column) -> Column:
    """A text as JSON's."""
    whole = F.to_json(F.struct(text.alias("q")))
    # Most texts have nothing to escape.
    return F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


def leaf(kind: Column, value: Column, claimed: Column) -> Column:
    """One scalar: its value in its type's form and the text that was claimed for it."""
    own = F.when(value.isNull(), "null").when(kind.isin(*BARE), value).otherwise(quoted(value))
    return F.concat(F.lit('{"value":'), own, F.lit(',"claimed_text":'), F.when(claimed.isNull(), "null").otherwise(quoted(claimed)), F.lit("}"))


def rebuilt(fields: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """document_id, tree (JSON text): every document's values as the payload they came from, fields in declared order.

    A document with a problem has no tree; a repeating group without entries is an empty array.
    """
    ordinals = {path: i for i, (path, _, _) in enumerate(walk(schema["fields"]))}
    own = F.struct("ordinal", F.col("field_path").alias("path"), leaf(F.col("type"), F.col("value"), F.col("claimed_text")).alias("json"))
    whole = fields.groupBy("document_id").agg(F.bool_or(F.col("problem").isNotNull()).alias("_bad"), F.collect_list(own).alias("_n")).where("NOT _bad")
    empty = [F.when(~F.exists("_n", lambda x: F.startswith(x["path"], F.lit(f"{path}["))), F.struct(F.lit(ordinal).alias("ordinal"), F.lit(path).alias("path"), F.lit("[]").alias("json"))) for path, ordinal in repeated_groups(schema["fields"], ordinals)]  # noqa: B023
    nodes = whole.select("document_id", F.explode(F.concat("_n", F.array_compact(F.array(*empty))) if empty else F.col("_n")).alias("_x")).select("document_id", "_x.*")
    nodes = nodes.withColumn("level", F.size(F.regexp_extract_all("path", F.lit(r"[^.\[\]]+"), F.lit(0))))
    for level in range(levels(schema["fields"]), 0, -1):
        # Nodes of other levels go along as groups of their own. All is dealt by document already, so nothing is dealt again.
        deep, index = F.col("level") == level, F.regexp_extract("path", STEP, 2)
        name = F.when(deep, quoted(F.regexp_extract("path", STEP, 1)))
        now = nodes.select("document_id", F.when(deep, F.regexp_replace("path", STEP, "")).otherwise(F.col("path")).alias("path"), "ordinal", "level", name.alias("name"), F.when(deep & (index != ""), index.cast("int")).alias("at"), "json")
        children = F.array_sort(F.collect_list(F.struct("at", "ordinal", "name", "json")))
        made = now.groupBy("document_id", "path").agg(children.alias("_c"), F.min("ordinal").alias("ordinal"), F.max("at").alias("_last"), F.max("level").alias("_level"))
        members = F.array_join(F.transform("_c", lambda c: F.concat(c["name"], F.lit(":"), c["json"])), ",")
        entries = F.array_join(F.transform("_c", lambda c: c["json"]), ",")
        joined = F.when(F.col("_last").isNull(), F.concat(F.lit("{"), members, F.lit("}"))).otherwise(F.concat(F.lit("["), entries, F.lit("]")))
        json = F.when(F.col("_level") < level, F.get("_c", F.lit(0))["json"]).otherwise(joined)
        nodes = made.select("document_id", "ordinal", "path", json.alias("json"), F.least("_level", F.lit(level - 1)).alias("level"))
    return nodes.select("document_id", F.col("json").alias("tree"))


def retyped(fields: DataFrame) -> DataFrame:
    """Values in their declared types again, a column a type (as_int … as_datetime); text stays in `value`.

    Values read back from text are compared and summed as what they are: decimals as decimals, dates as dates.
    """

    def own(kind: str) -> Column:
        return F.when((F.col("type") == kind) & F.col("present"), typed(F.col("value"), kind)).cast(TYPES[kind]).alias(f"as_{kind}")

    return fields.select("*", *(own(kind) for kind in TYPES))
