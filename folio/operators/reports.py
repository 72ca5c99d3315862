"""Evaluation reports: the eight metrics, roll-ups of what predictions recorded, partial reports, provenance, comparability.

documents(document_id, tier, declared), predictions(document_id, ...recorded counts and provenance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import path_key
from folio.operators.evaluation import TALLIES, tallies

GROUNDING = ("exact", "fuzzy", "ungrounded")
PROVENANCE = ("parser_version", "schema_hash", "prompt_hash", "model_id")


def rate(numerator: Column, denominator: Column) -> Column:
    """A share; without a denominator it is null, never 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def metric_rows(given: list[str]) -> Column:
    """The eight metrics of a row of tallies, grounding and places as an array of (metric, numerator, denominator, value); counts that aren't given are 0."""
    c = {n: F.coalesce(F.col(n), F.lit(0)).cast("long") if n in given else F.lit(0).cast("long") for n in (*TALLIES, *GROUNDING, "agrees", "disagrees")}
    values = c["correct_value"] + c["incorrect"] + c["missing"] + c["unevaluated_value"]
    absences = c["correct_absence"] + c["spurious"] + c["unevaluated_absence"]
    # The metrics' definitions.
    defined = {
        "field_accuracy": (c["correct_value"] + c["correct_absence"], values + absences),
        "coverage": (c["correct_value"] + c["incorrect"], values),
        "missing_rate": (c["missing"], values),
        "incorrect_rate": (c["incorrect"], values),
        "grounding_rate": (c["exact"] + c["fuzzy"], c["exact"] + c["fuzzy"] + c["ungrounded"]),
        "spurious_rate": (c["spurious"], absences),
        "unevaluated_rate": (c["unevaluated_value"] + c["unevaluated_absence"], values + absences),
        "mislocation_rate": (c["disagrees"], c["agrees"] + c["disagrees"]),
    }
    return F.array(*(F.struct(F.lit(n).alias("metric"), a.alias("numerator"), b.alias("denominator"), rate(a, b).alias("value")) for n, (a, b) in defined.items()))


def eight_metrics(tally: DataFrame) -> DataFrame:
    """metric, numerator, denominator, value of one row of tallies with grounding (exact, fuzzy, ungrounded) and places (agrees, disagrees)."""
    return tally.select(F.explode(metric_rows([*TALLIES, *GROUNDING, "agrees", "disagrees"])).alias("_m")).select("_m.*")


def report_metrics(outcomes: DataFrame, predictions: DataFrame, places: DataFrame) -> DataFrame:
    """The eight metrics of a report: outcomes(document_id, kind, expectation), places(agreement), predictions' recorded grounding."""
    said = lambda s: F.count_if(F.col("agreement") == s).alias(s)
    whole = outcomes.agg(*tallies())
    # One row each, from aggregates without groups.
    for part in (grounding_totals(predictions), places.agg(said("agrees"), said("disagrees"))):
        whole = whole.join(F.broadcast(part))
    return eight_metrics(whole)


def grounding_totals(predictions: DataFrame) -> DataFrame:
    """The recorded grounding counts of all predictions; 0 where none was recorded."""
    return predictions.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in GROUNDING))


def validation_totals(predictions: DataFrame, names: list[str]) -> DataFrame:
    """The recorded validation counts of all predictions; null where none was recorded."""
    return predictions.agg(*(F.sum(n).alias(n) for n in names))


def tiers(documents: DataFrame) -> DataFrame:
    """How many documents and declared labels each tier has."""
    return documents.groupBy("tier").agg(F.count("*").alias("documents"), F.sum("declared").alias("labels"))


def partial(documents: DataFrame, considered: DataFrame) -> DataFrame:
    """What a report of some documents leaves out: skipped documents and tiers, covered and declared labels, and their share."""
    rows = documents.join(considered.select("document_id", F.lit(True).alias("_in")), "document_id", "left")
    inside = F.coalesce("_in", F.lit(False))
    sums = rows.agg(
        F.count_if(~inside).alias("skipped_documents"),
        F.array_join(F.array_sort(F.collect_set(F.when(~inside, F.col("tier")))), ",").alias("skipped_tiers"),
        F.sum(F.when(inside, F.col("declared")).otherwise(0)).alias("covered_labels"),
        F.sum("declared").alias("declared_labels"),
    )
    return sums.withColumn("covered_fraction", rate(F.col("covered_labels"), F.col("declared_labels")))


def provenance(predictions: DataFrame, names: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """The distinct values of each field of provenance, sorted: field, seen. Versions and models are few."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("_v")) for n in names))).alias("_p")
    rows = predictions.select(pairs).select("_p.*").where("_v IS NOT NULL AND _v <> ''").distinct()
    return rows.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("_v")), ",").alias("seen"))


def provenance_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The fields of provenance that differ between two reports."""
    rows = before.select("field", F.col("seen").alias("before")).join(after.select("field", F.col("seen").alias("after")), "field", "full_outer")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def prediction_problems(predictions: DataFrame, documents: DataFrame) -> DataFrame:
    """Predictions that don't belong to the labelled set: document_id, problem (the first that holds)."""
    mine = documents.select("document_id", F.col("schema_identity").alias("_i"), F.col("schema_hash").alias("_h"))
    copies = predictions.groupBy("document_id").agg(F.count("*").alias("_n"), F.min("schema_identity").alias("schema_identity"), F.min("schema_hash").alias("schema_hash"))
    rows = copies.join(mine, "document_id", "left")
    problem = (
        F.when(F.col("_n") > 1, "repeated_prediction").when(F.col("_i").isNull(), "unknown_document")
        .when(F.col("schema_identity") != F.col("_i"), "schema_mismatch").when(F.col("schema_hash") != F.col("_h"), "schema_hash_mismatch")
    )
    return rows.select("document_id", problem.alias("problem")).where("problem IS NOT NULL")


def incomparable(pairs: DataFrame) -> DataFrame:
    """Why two reports may not be compared, or null. pairs has each side's facts as before and after structs."""
    differs = lambda n: ~F.col(f"before.{n}").eqNullSafe(F.col(f"after.{n}"))
    reason = (
        F.when(differs("golden_set_id"), "golden_set").when(differs("schemas"), "schemas").when(differs("metric_version"), "metric_version").when(differs("partial"), "partial_and_whole")
    )
    return pairs.withColumn("refusal", reason)


def in_order(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their rank within the document: index steps of paths by number, before names."""
    by = Window.partitionBy("document_id").orderBy(path_key(F.col("field_path")), "field_path")
    return outcomes.withColumn("rank", F.row_number().over(by))


def value_paths(labels: DataFrame) -> DataFrame:
    """The fields whose label states a value."""
    return labels.where("expectation = 'value'").select("document_id", "field_path").distinct()


def compared_paths(expected: DataFrame, pairs: DataFrame) -> DataFrame:
    """The path under which each expected entry's field is predicted: the paired index in place of its own; null without a pair.

    expected(document_id, field_path), pairs(document_id, group_path, expected_index, predicted_index).
    """
    part = [F.regexp_extract("field_path", r"^([^\[]+)\[(\d+)\](.*)$", i) for i in (1, 2, 3)]
    rows = expected.select("document_id", "field_path", part[0].alias("group_path"), part[1].cast("string").alias("_i"), part[2].alias("_rest"))
    met = rows.withColumn("expected_index", F.col("_i").try_cast("int")).join(pairs, ["document_id", "group_path", "expected_index"], "left")
    path = F.when(F.col("group_path") == "", F.col("field_path")).when(F.col("predicted_index").isNotNull(), F.concat("group_path", F.lit("["), F.col("predicted_index").cast("string"), F.lit("]"), "_rest"))
    return met.select("document_id", "field_path", path.alias("compared_path"))


def field_table(outcomes: DataFrame) -> DataFrame:
    """Each declared path's outcomes: correct, wrong, missing, and the least and greatest document with an outcome that isn't correct."""
    off = F.when(F.col("kind") != "correct", F.col("document_id"))
    return outcomes.groupBy("field_path").agg(
        F.count_if(F.col("kind") == "correct").alias("correct"), F.count_if(F.col("kind").isin("incorrect", "spurious")).alias("wrong"), F.count_if(F.col("kind") == "missing").alias("missing"),
        F.min(off).alias("first_off"), F.max(off).alias("last_off"),
    )


def stat_strip(metrics: DataFrame) -> DataFrame:
    """Rates as percentages with one decimal, a dash where undefined."""
    share = F.round(F.col("numerator") * 1000 / F.col("denominator")).cast("long")
    return metrics.select("metric", F.when(F.col("denominator") == 0, "-").otherwise(F.concat((share / 10).cast("decimal(10,1)").cast("string"), F.lit("%"))).alias("shown"))
