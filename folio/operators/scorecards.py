"""One report of an evaluation as rows: scores at every level, sizes, what is left out, provenance; and two reports compared.

A report is section, key, name, numerator, denominator, value, said:

- micro, document (key: document_id), path (key: field_path): the eight metrics; a rate without a denominator is null. Grounding and
  places of whole documents are not known by path.
- macro: the mean of each metric over documents that define it; numerator such documents, denominator all.
- count: the outcomes by kind of the whole; each must be the sum over documents and over paths, which `reconciles` asks.
- tier (key: tier): documents and labels. verdict (key: verdict): documents. Both of all rows of the labelled set that the report considers or, for
  tiers, leaves out too.
- partial, where documents are left out: documents, labels (covered of declared) and the tiers left out.
- provenance: the distinct values of each field, sorted.
- fact: what must be equal in two reports that are compared.

Outcomes and documents are one tagged union that is aggregated once, by grouping sets; labels and predictions are read once, the
documents' ids a second time to leave out outcomes that are not of the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.evaluation import HIGHER_IS_BETTER, TALLIES, scored, tallies
from folio.operators.reports import GROUNDING, PROVENANCE, metric_rows, prediction_problems, rate

ROW = "section string, key string, name string, numerator long, denominator long, value double, said string"
#: A change of the metrics' definitions takes another number.
METRIC_VERSION = "1"
FACTS = ("golden_set_id", "metric_version", "partial", "schema_hash", "schema_identity")
SCORED = ("micro", "macro", "document", "path")


def refused(states: DataFrame, documents: DataFrame) -> DataFrame:
    """Why a set of predictions isn't scored: documents given twice or unknown, and those of another schema."""
    return prediction_problems(states, documents)


def report(documents: DataFrame, labels: DataFrame, predictions: DataFrame, states: DataFrame, golden_set_id: str, include_restricted: bool = True, check: bool = True) -> DataFrame:
    """A report, or ValueError where `refused` has a row.

    documents(document_id, tier, declared, schema_identity, schema_hash), labels and predictions as for `scored`, states(document_id, failed, exact, fuzzy,
    ungrounded, verdict, schema_identity, schema_hash and the fields of provenance), one row for each document that was processed.
    """
    if check:
        wrong = refused(states, documents).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0]['document_id']}: {wrong[0]['problem']}")
    mine = states.select("document_id", F.coalesce("failed", F.lit(False)).alias("failed"), *GROUNDING, "verdict", *(F.col(n).alias(f"_p_{n}") for n in PROVENANCE))
    whole = documents.select("document_id", "tier", "declared", "schema_identity", F.col("schema_hash").alias("_hash"), (F.lit(include_restricted) | (F.col("tier") == "public")).alias("inside"))
    facts = whole.join(mine, "document_id", "left")
    # Outcomes of documents outside the report, or of none of the set, go before anything is summed.
    kinds = scored(labels, predictions, states.select("document_id", F.coalesce("failed", F.lit(False)).alias("failed")))
    kinds = kinds.join(whole.where("inside").select("document_id"), "document_id", "left_semi")
    union = kinds.withColumn("_tag", F.lit("outcome")).unionByName(facts.withColumn("_tag", F.lit("document")), allowMissingColumns=True)
    # Grouping sets of no rows have no whole; one row that counts as nothing gives it.
    nothing = documents.sparkSession.range(1).select(F.lit("nothing").alias("_tag"))
    return _rows(_levels(union.unionByName(nothing, allowMissingColumns=True)), golden_set_id)


def _levels(union: DataFrame) -> DataFrame:
    is_document = F.col("_tag") == "document"
    inside = is_document & F.col("inside")
    kept = lambda c: F.collect_set(F.when(inside & (F.col(c) != ""), F.col(c)))
    sums = [
        *tallies(), *(F.coalesce(F.sum(F.when(inside, F.col(n))), F.lit(0)).alias(n) for n in GROUNDING), F.count_if(F.col("_tag") == "outcome").alias("outcomes"), F.count_if(is_document).alias("all_documents"),
        F.count_if(inside).alias("documents"), F.coalesce(F.sum(F.when(is_document, F.col("declared"))), F.lit(0)).cast("long").alias("all_labels"), F.coalesce(F.sum(F.when(inside, F.col("declared"))), F.lit(0)).cast("long").alias("labels"),
        F.collect_set(F.when(is_document & ~F.col("inside"), F.col("tier"))).alias("_without"), *(kept(f"_p_{n}").alias(f"_p_{n}") for n in PROVENANCE), kept("schema_identity").alias("_identities"), kept("_hash").alias("_hashes"),
    ]
    sets = union.groupingSets([["document_id"], ["field_path"], ["tier"], ["verdict"], []], "document_id", "field_path", "tier", "verdict").agg(F.grouping_id().alias("_g"), *sums)
    # Bits of grouping_id, the first key highest: 0 where the key is one of the set.
    level = F.when(F.col("_g") == 0b0111, "document").when(F.col("_g") == 0b1011, "path").when(F.col("_g") == 0b1101, "tier").when(F.col("_g") == 0b1110, "verdict").otherwise("micro")
    return sets.withColumn("_level", level)


def _row(section: str | Column, name: Column | str, numerator=None, denominator=None, value=None, said=None, key: Column | None = None) -> Column:
    of = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(
        of(section, "string").alias("section"), of(key, "string").alias("key"), of(name, "string").alias("name"), of(numerator, "long").alias("numerator"), of(denominator, "long").alias("denominator"),
        of(value, "double").alias("value"), of(said, "string").alias("said"),
    )


def _rows(levels: DataFrame, golden_set_id: str) -> DataFrame:
    level, joined = F.col("_level"), lambda c: F.array_join(F.array_sort(c), ",")
    scores = lambda section, given, key=None: F.transform(metric_rows(given), lambda m: _row(section, m["metric"], m["numerator"], m["denominator"], m["value"], key=key))
    every = [*TALLIES, *GROUNDING]
    empty = F.array().cast(f"array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in ROW.split(','))}>>")
    partial = F.col("documents") < F.col("all_documents")
    micro = F.concat(
        scores("micro", every), F.array(*(_row("count", n, F.col(n)) for n in TALLIES)),
        F.when(partial, F.array(
            _row("partial", "documents", F.col("documents"), F.col("all_documents"), rate(F.col("documents"), F.col("all_documents"))), _row("partial", "labels", F.col("labels"), F.col("all_labels"), rate(F.col("labels"), F.col("all_labels"))),
            _row("partial", "tiers", said=joined("_without")),
        )).otherwise(empty),
        F.filter(F.array(*(_row("provenance", n, said=joined(f"_p_{n}")) for n in PROVENANCE)), lambda r: r["said"] != ""),
        F.array(
            _row("fact", "golden_set_id", said=golden_set_id), _row("fact", "metric_version", said=METRIC_VERSION), _row("fact", "partial", said=partial.cast("string")),
            _row("fact", "schema_hash", said=joined("_hashes")), _row("fact", "schema_identity", said=joined("_identities")),
        ),
    )
    # A document's scores go to its own rows and, by name, to the mean of all.
    document = F.concat(scores("document", every, F.col("document_id")), scores("macro", every))
    path = scores("path", list(TALLIES), F.col("field_path"))
    tier = F.array(_row("tier", "documents", F.col("documents"), F.col("all_documents"), key=F.col("tier")), _row("tier", "labels", F.col("labels"), F.col("all_labels"), key=F.col("tier")))
    verdict = F.array(_row("verdict", "documents", F.col("documents"), key=F.col("verdict")))
    made = (
        F.when(level == "micro", micro).when((level == "document") & (F.col("documents") > 0), document).when((level == "path") & (F.col("outcomes") > 0), path)
        .when((level == "tier") & (F.col("all_documents") > 0), tier).when((level == "verdict") & (F.col("documents") > 0) & F.col("verdict").isNotNull(), verdict).otherwise(empty)
    )
    rows = levels.select(F.explode(made).alias("_r")).select("_r.*")
    # Documents' rows for the mean become one a task before they are shuffled; all others stand alone under their key.
    macro, one = F.col("section") == "macro", lambda c: F.max(c).alias(c)
    met = rows.groupBy("section", "key", "name").agg(one("numerator"), one("denominator"), one("value"), one("said"), F.count("value").alias("_defined"), F.count("*").alias("_all"), _mean(F.when(macro, F.col("value"))).alias("_mean"))
    of = lambda mean, own: F.when(macro, F.col(mean)).otherwise(F.col(own)).alias(own)
    return met.select("section", "key", "name", of("_defined", "numerator"), of("_all", "denominator"), of("_mean", "value"), "said")


def _mean(c: Column) -> Column:
    """A mean of rates whose sum is exact, so that it doesn't depend on the order of rows: equal reports have equal means."""
    return F.try_divide(F.sum(c.cast("decimal(20,18)")).cast("double"), F.count(c))


def reconciles(rows: DataFrame) -> DataFrame:
    """Do documents and paths add up? name, total, by_document, by_path of each metric's two counts that both know, and whether they are equal."""
    # Grounding and places are not known by path.
    known = ~F.col("name").isin("grounding_rate", "mislocation_rate")
    at = lambda s, c: F.coalesce(F.sum(F.when(F.col("section") == s, F.col(c))), F.lit(0))
    sums = rows.where(known & F.col("section").isin("micro", "document", "path")).groupBy("name").agg(*(at(s, c).alias(f"{s}_{c}") for s in ("micro", "document", "path") for c in ("numerator", "denominator")))
    same = reduce(lambda a, b: a & b, (F.col(f"micro_{c}") == F.col(f"{s}_{c}") for s in ("document", "path") for c in ("numerator", "denominator")))
    return sums.select("name", F.col("micro_numerator").alias("numerator"), F.col("micro_denominator").alias("denominator"), same.alias("reconciled"))


def incomparable_facts(before: DataFrame, after: DataFrame) -> DataFrame:
    """The facts that differ between two reports: name, before, after. Reports with any are not compared."""
    side = lambda rows, name: rows.where("section = 'fact'").select("name", F.col("said").alias(name))
    return side(before, "before").join(side(after, "after"), "name", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What moved between two reports: section, key, name, before, after, delta, judgement; or ValueError, which names the facts that differ.

    Scores are judged; of provenance only the fields that differ are told.
    """
    wrong = sorted(r["name"] for r in incomparable_facts(before, after).collect())
    if wrong:
        raise ValueError(f"reports of different {', '.join(wrong)}")
    side = lambda rows, n: rows.where(F.col("section").isin(*SCORED, "provenance")).select("section", "key", "name", F.col("value").alias(f"_{n}"), F.col("said").alias(f"_{n}_said"), F.lit(True).alias(f"_{n}_in"))
    one, two = side(before, "b"), side(after, "a")
    # A missing key is joined as a value of its own, which no path or id can be confused with.
    key = lambda rows: rows.withColumn("_k", F.coalesce(F.concat(F.lit("="), F.col("key")), F.lit("-"))).drop("key")
    rows = key(one).join(key(two), ["section", "_k", "name"], "full_outer").withColumn("key", F.when(F.startswith("_k", F.lit("=")), F.substr("_k", F.lit(2))))
    b, a = F.col("_b"), F.col("_a")
    delta = a - b
    judgement = (
        F.when(F.col("section") == "provenance", "changed").when(b.isNull() & a.isNull(), "unchanged").when(b.isNull(), "became_defined").when(a.isNull(), "became_undefined")
        .when(delta == 0, "unchanged").when((delta > 0) == F.col("name").isin(*HIGHER_IS_BETTER), "improved").otherwise("regressed")
    )
    told = (F.col("section") != "provenance") | ~F.col("_b_said").eqNullSafe(F.col("_a_said"))
    return rows.where(told).select("section", "key", "name", b.alias("before"), a.alias("after"), delta.alias("delta"), judgement.alias("judgement"), F.col("_b_said").alias("said_before"), F.col("_a_said").alias("said_after"))
