"""Evaluation: labels against predictions, and what follows from the outcomes.

labels(document_id, field_path, expectation, value, type): expectation is value or absent. predictions(document_id,
field_path, value, type, present). An outcome is one of KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("correct", "incorrect", "missing", "spurious", "unlabeled", "unevaluated")
HIGHER_IS_BETTER = ("field_accuracy", "coverage", "grounding_rate")


def aligned(expected: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """Entries paired by a key, where a missing key is a value: the key, and whether each side has the entry.

    The key is (document, index) for alignment by position and (document, key field) for alignment by key.
    """
    left = expected.select(*(F.col(k).alias(f"_l_{k}") for k in key), F.lit(True).alias("expected"))
    right = predicted.select(*(F.col(k).alias(f"_r_{k}") for k in key), F.lit(True).alias("predicted"))
    same = None
    for k in key:
        one = F.col(f"_l_{k}").eqNullSafe(F.col(f"_r_{k}"))
        same = one if same is None else same & one
    pairs = left.join(right, same, "full_outer")
    # A missing key of a side that has the entry stays missing.
    return pairs.select(*(F.when(F.col("expected"), F.col(f"_l_{k}")).otherwise(F.col(f"_r_{k}")).alias(k) for k in key), F.coalesce("expected", F.lit(False)).alias("expected"), F.coalesce("predicted", F.lit(False)).alias("predicted"))


def group_outcomes(pairs: DataFrame) -> DataFrame:
    """How many entries of each document pair off, are missing and are spurious."""
    return pairs.groupBy("document_id").agg(
        F.count_if(F.col("expected") & F.col("predicted")).alias("paired"),
        F.count_if(F.col("expected") & ~F.col("predicted")).alias("missing"),
        F.count_if(~F.col("expected") & F.col("predicted")).alias("spurious"),
    )


def repeated_keys(entries: DataFrame, key: list[str]) -> DataFrame:
    """The keys that stand more than once, for which alignment by key is refused."""
    return entries.groupBy(*key).count().where("count > 1").withColumnRenamed("count", "copies")


def scored(labels: DataFrame, predictions: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One outcome for each label and each present prediction without a label: document_id, field_path, expectation, kind.

    evaluated(document_id, failed): documents that have a prediction at all. A document whose processing failed has no
    values. Values are equal only if their types are.
    """
    mine = predictions.where("present").select("document_id", "field_path", F.col("value").alias("_value"), F.col("type").alias("_type"), F.lit(True).alias("_present"))
    rows = labels.join(mine, ["document_id", "field_path"], "full_outer").join(evaluated, "document_id", "left")
    present = F.coalesce("_present", F.lit(False)) & ~F.coalesce("failed", F.lit(False))
    equal = (F.col("type") == F.col("_type")) & F.col("value").eqNullSafe(F.col("_value"))
    kind = (
        F.when(F.col("expectation").isNull(), "unlabeled")
        .when(F.col("failed").isNull(), "unevaluated")
        .when(F.col("expectation") == "value", F.when(~present, "missing").when(equal, "correct").otherwise("incorrect"))
        .otherwise(F.when(present, "spurious").otherwise("correct"))
    )
    return rows.select("document_id", "field_path", "expectation", kind.alias("kind"))


TALLIES = {
    "correct_value": ("correct", "value"), "correct_absence": ("correct", "absent"), "incorrect": ("incorrect", None), "missing": ("missing", None),
    "spurious": ("spurious", None), "unlabeled": ("unlabeled", None), "unevaluated_value": ("unevaluated", "value"), "unevaluated_absence": ("unevaluated", "absent"),
}


def tallies() -> list[Column]:
    out = []
    for name, (kind, side) in TALLIES.items():
        is_kind = F.col("kind") == kind
        out.append(F.count_if(is_kind & (F.col("expectation") == side) if side else is_kind).alias(name))
    return out


def rates(t: DataFrame) -> DataFrame:
    """Add the rates that tallies define; a rate without a denominator is null."""
    c = {name: F.col(name) for name in TALLIES}
    values = c["correct_value"] + c["incorrect"] + c["missing"] + c["unevaluated_value"]
    absences = c["correct_absence"] + c["spurious"] + c["unevaluated_absence"]
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return t.withColumns({
        "field_accuracy": rate(c["correct_value"] + c["correct_absence"], values + absences),
        "coverage": rate(c["correct_value"] + c["incorrect"], values),
        "missing_rate": rate(c["missing"], values),
        "incorrect_rate": rate(c["incorrect"], values),
        "spurious_rate": rate(c["spurious"], absences),
        "unevaluated_rate": rate(c["unevaluated_value"] + c["unevaluated_absence"], values + absences),
    })


RATES = ("field_accuracy", "coverage", "missing_rate", "incorrect_rate", "spurious_rate", "unevaluated_rate")


def metrics(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Tallies and rates over all outcomes (by nothing), by document or by field path."""
    return rates(outcomes.groupBy(*by).agg(*tallies()))


def macro(outcomes: DataFrame) -> DataFrame:
    """The mean of each rate over the documents that define it, and how many do not: metric, value, undefined."""
    rows = metrics(outcomes, ["document_id"])
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("_v")) for n in RATES))).alias("_m")
    return rows.select(pairs).select("_m.*").groupBy("metric").agg(F.avg("_v").alias("value"), F.count_if(F.col("_v").isNull()).alias("undefined"))


def reconciled(outcomes: DataFrame) -> DataFrame:
    """Do documents and paths add up to the whole? One row a tally: total, by_document, by_path, reconciled. One pass of grouping sets."""
    sets = outcomes.groupingSets([["document_id"], ["field_path"], []], "document_id", "field_path").agg(F.grouping_id().alias("_g"), *tallies())
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "by_document").otherwise("by_path")
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("tally"), F.col(n).alias("_v")) for n in TALLIES))).alias("_t")
    rows = sets.select(level.alias("_level"), pairs).select("_level", "_t.*")
    sums = rows.groupBy("tally").agg(*(F.sum(F.when(F.col("_level") == n, F.col("_v"))).alias(n) for n in ("total", "by_document", "by_path")))
    return sums.withColumn("reconciled", (F.col("total") == F.col("by_document")) & (F.col("total") == F.col("by_path")))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each metric's change between two reports (metric, value): delta and judgement."""
    rows = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric", "full_outer")
    delta = F.col("after") - F.col("before")
    judgement = (
        F.when(F.col("before").isNull() & F.col("after").isNull(), "unchanged")
        .when(F.col("before").isNull(), "became_defined")
        .when(F.col("after").isNull(), "became_undefined")
        .when(delta == 0, "unchanged")
        .when((delta > 0) == F.col("metric").isin(*HIGHER_IS_BETTER), "improved")
        .otherwise("regressed")
    )
    return rows.select("metric", "before", "after", delta.alias("delta"), judgement.alias("judgement"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The fields whose outcome differs between two reports: document_id, field_path, before, after."""
    key = ["document_id", "field_path"]
    rows = before.select(*key, F.col("kind").alias("before")).join(after.select(*key, F.col("kind").alias("after")), key, "full_outer")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def promoted(labels: DataFrame, corrections: DataFrame) -> DataFrame:
    """Labels with the last correction of each field in place of the label: document_id, field_path, expectation, value.

    corrections(document_id, field_path, confirmed, predicted, corrected, at): a confirmed missing value is a label of
    absence, a confirmed value the predicted one, else the corrected one.
    """
    key = ["document_id", "field_path"]
    last = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("corrected"))
    rows = corrections.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    value = F.when(F.col("confirmed"), F.col("predicted")).otherwise(F.col("corrected"))
    mine = rows.select(*key, F.when(value.isNull(), "absent").otherwise("value").alias("expectation"), value.alias("value"))
    return labels.select(*key, "expectation", "value").join(mine.select(*key), key, "left_anti").unionByName(mine)


def redacted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the restricted tier become their hashes."""
    hidden = F.col("tier") == "restricted"
    return rows.withColumns({c: F.when(hidden, F.sha2(F.col(c).cast("string"), 256)).otherwise(F.col(c).cast("string")) for c in columns}).withColumn("redacted", hidden)


def location(expected: DataFrame, found: DataFrame, share: float = 0.5) -> DataFrame:
    """Does a value's place agree with its label's? By area: the share of the found boxes within the expected one.

    expected(document_id, field_path, page, x0, y0, x1, y1), found the same with a row for each box.
    """
    key = ["document_id", "field_path"]
    side = lambda p: [F.col(c).alias(f"{p}{c}") for c in ("page", "x0", "y0", "x1", "y1")]
    rows = expected.select(*key, *side("e_")).join(found.select(*key, *side("f_")), key, "left")
    area = (F.col("f_x1") - F.col("f_x0")) * (F.col("f_y1") - F.col("f_y0"))
    overlap = lambda d: F.greatest(F.lit(0.0), F.least(F.col(f"e_{d}1"), F.col(f"f_{d}1")) - F.greatest(F.col(f"e_{d}0"), F.col(f"f_{d}0")))
    inside = F.when(F.col("e_page") == F.col("f_page"), overlap("x") * overlap("y")).otherwise(0.0)
    sums = rows.groupBy(*key).agg(F.sum(area).alias("_area"), F.sum(inside).alias("_inside"))
    agreement = F.when(F.col("_area").isNull() | (F.col("_area") <= 0), "not_assessable").when(F.col("_inside") / F.col("_area") >= share, "agrees").otherwise("disagrees")
    return sums.select(*key, agreement.alias("agreement"))
