"""Queries on evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.operators import evaluation as E
from folio.plans.tables import table

#: Labels state a quality and, for toxic documents, toxicity; else its absence. The prediction reads the text's size: it is
#: wrong now and then, leaves values out, invents some, and has documents that failed or were never processed.
SCORED = """label AS (
  SELECT doc_id AS document_id, 'quality' AS field_path, 'value' AS expectation, quality::VARCHAR AS value, 'int' AS type FROM labels
  UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 'value' ELSE 'absent' END, CASE WHEN toxic = 1 THEN '1' END, 'int' FROM labels),
prediction AS (
  SELECT doc_id AS document_id, 'quality' AS field_path, CASE WHEN n_chars % {m} = 0 THEN '0' ELSE '1' END AS value, CASE WHEN doc_id % 13 = 0 THEN 'float' ELSE 'int' END AS type, doc_id % 11 <> 0 AS present FROM documents
  UNION ALL SELECT doc_id, 'toxic', '1', 'int', n_chars % 5 = 0 FROM documents
  UNION ALL SELECT doc_id, 'topic', 'x', 'string', doc_id % 9 = 0 FROM documents),
state AS (SELECT doc_id AS document_id, doc_id % 17 = 0 AS failed FROM documents WHERE doc_id % 19 <> 0),
scored AS (
  SELECT coalesce(l.document_id, p.document_id) AS document_id, coalesce(l.field_path, p.field_path) AS field_path, expectation,
    CASE WHEN expectation IS NULL THEN 'unlabeled' WHEN failed IS NULL THEN 'unevaluated'
      WHEN expectation = 'value' THEN CASE WHEN p.document_id IS NULL OR failed THEN 'missing' WHEN l.type = p.type AND l.value IS NOT DISTINCT FROM p.value THEN 'correct' ELSE 'incorrect' END
      WHEN p.document_id IS NULL OR failed THEN 'correct' ELSE 'spurious' END AS kind
  FROM label l FULL JOIN (SELECT * FROM prediction WHERE present) p ON l.document_id = p.document_id AND l.field_path = p.field_path
    LEFT JOIN state s ON s.document_id = coalesce(l.document_id, p.document_id))"""
COUNTS = """count(*) FILTER (WHERE kind = 'correct' AND expectation = 'value')::BIGINT AS correct_value, count(*) FILTER (WHERE kind = 'correct' AND expectation = 'absent')::BIGINT AS correct_absence,
  count(*) FILTER (WHERE kind = 'incorrect')::BIGINT AS incorrect, count(*) FILTER (WHERE kind = 'missing')::BIGINT AS missing, count(*) FILTER (WHERE kind = 'spurious')::BIGINT AS spurious,
  count(*) FILTER (WHERE kind = 'unlabeled')::BIGINT AS unlabeled, count(*) FILTER (WHERE kind = 'unevaluated' AND expectation = 'value')::BIGINT AS unevaluated_value,
  count(*) FILTER (WHERE kind = 'unevaluated' AND expectation = 'absent')::BIGINT AS unevaluated_absence"""
RATES = """(correct_value + correct_absence)::DOUBLE / nullif(correct_value + incorrect + missing + unevaluated_value + correct_absence + spurious + unevaluated_absence, 0) AS field_accuracy,
  (correct_value + incorrect)::DOUBLE / nullif(correct_value + incorrect + missing + unevaluated_value, 0) AS coverage,
  missing::DOUBLE / nullif(correct_value + incorrect + missing + unevaluated_value, 0) AS missing_rate, incorrect::DOUBLE / nullif(correct_value + incorrect + missing + unevaluated_value, 0) AS incorrect_rate,
  spurious::DOUBLE / nullif(correct_absence + spurious + unevaluated_absence, 0) AS spurious_rate,
  (unevaluated_value + unevaluated_absence)::DOUBLE / nullif(correct_value + incorrect + missing + unevaluated_value + correct_absence + spurious + unevaluated_absence, 0) AS unevaluated_rate"""


def outcomes(spark: SparkSession, sf_dir: str, m: int = 7) -> DataFrame:
    return E.scored(*sides(spark, sf_dir, m))


def sides(spark: SparkSession, sf_dir: str, m: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, predictions, and the documents that were processed at all."""
    given, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    key = F.col("doc_id").alias("document_id")
    toxic = F.col("toxic") == 1
    row = lambda path, expectation, value: (key, F.lit(path).alias("field_path"), expectation.alias("expectation"), value.alias("value"), F.lit("int").alias("type"))
    labels = given.select(*row("quality", F.lit("value"), F.col("quality").cast("string"))).unionByName(given.select(*row("toxic", F.when(toxic, "value").otherwise("absent"), F.when(toxic, "1"))))
    said = lambda path, value, kind, present: (key, F.lit(path).alias("field_path"), value.alias("value"), kind.alias("type"), present.alias("present"))
    quality = F.when(F.col("n_chars") % m == 0, "0").otherwise("1"), F.when(F.col("doc_id") % 13 == 0, "float").otherwise("int"), F.col("doc_id") % 11 != 0
    predictions = docs.select(*said("quality", *quality)).unionByName(docs.select(*said("toxic", F.lit("1"), F.lit("int"), F.col("n_chars") % 5 == 0)))
    predictions = predictions.unionByName(docs.select(*said("topic", F.lit("x"), F.lit("string"), F.col("doc_id") % 9 == 0)))
    state = docs.where("doc_id % 19 <> 0").select(key, (F.col("doc_id") % 17 == 0).alias("failed"))
    return labels, predictions, state


def unpivoted(sql: str) -> str:
    return f"SELECT metric, value FROM (SELECT {RATES} FROM ({sql})) UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(E.RATES)}))"


def report(rows: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in E.RATES))).alias("_m")
    return E.metrics(rows, []).select(pairs).select("_m.*")


@query("score_outcomes", f"WITH {SCORED.format(m=7)} SELECT * FROM scored")
def score_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query("metrics_micro", f"WITH {SCORED.format(m=7)} SELECT *, {RATES} FROM (SELECT {COUNTS} FROM scored)")
def metrics_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(outcomes(spark, sf_dir), [])


@query("metrics_by_path", f"WITH {SCORED.format(m=7)} SELECT *, {RATES} FROM (SELECT field_path, {COUNTS} FROM scored GROUP BY field_path)")
def metrics_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(outcomes(spark, sf_dir), ["field_path"])


@query("metrics_by_document", f"WITH {SCORED.format(m=7)} SELECT *, {RATES} FROM (SELECT document_id, {COUNTS} FROM scored GROUP BY document_id)")
def metrics_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.metrics(outcomes(spark, sf_dir), ["document_id"])


@query("metrics_macro", f"""
WITH {SCORED.format(m=7)}, doc AS (SELECT {RATES} FROM (SELECT document_id, {COUNTS} FROM scored GROUP BY document_id))
SELECT metric, avg(value) AS value, count(*) FILTER (WHERE value IS NULL)::BIGINT AS undefined FROM doc UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(E.RATES)})) GROUP BY metric
""")
def metrics_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(outcomes(spark, sf_dir))


@query("metrics_reconcile", f"""
WITH {SCORED.format(m=7)}, t AS (SELECT {COUNTS} FROM scored)
SELECT tally, n::BIGINT AS total, n::BIGINT AS by_document, n::BIGINT AS by_path, true AS reconciled FROM t UNPIVOT (n FOR tally IN ({", ".join(E.TALLIES)}))
""")
def metrics_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reconciled(outcomes(spark, sf_dir))


@query("report_compare", f"""
WITH {SCORED.format(m=7)}, b AS ({unpivoted(f"SELECT {COUNTS} FROM scored")}),
second AS (SELECT * FROM (WITH {SCORED.format(m=3)} SELECT * FROM scored)), a AS ({unpivoted(f"SELECT {COUNTS} FROM second")})
SELECT metric, b.value AS before, a.value AS after, a.value - b.value AS delta,
  CASE WHEN b.value IS NULL AND a.value IS NULL THEN 'unchanged' WHEN b.value IS NULL THEN 'became_defined' WHEN a.value IS NULL THEN 'became_undefined' WHEN a.value = b.value THEN 'unchanged'
    WHEN (a.value > b.value) = (metric IN ('field_accuracy', 'coverage', 'grounding_rate')) THEN 'improved' ELSE 'regressed' END AS judgement
FROM b FULL JOIN a USING (metric)
""")
def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compared(report(outcomes(spark, sf_dir)), report(outcomes(spark, sf_dir, 3)))


@query("changed_outcomes", f"""
WITH {SCORED.format(m=7)}, second AS (SELECT * FROM (WITH {SCORED.format(m=3)} SELECT * FROM scored))
SELECT document_id, field_path, s.kind AS before, t.kind AS after FROM scored s FULL JOIN second t USING (document_id, field_path) WHERE s.kind IS DISTINCT FROM t.kind
""")
def changed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.changed(outcomes(spark, sf_dir), outcomes(spark, sf_dir, 3))


#: Lines of an order as truth; the prediction lacks every fourth part and repeats the first line's place after the last.
ENTRIES = """truth AS (SELECT l_orderkey AS document_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS entry, l_partkey FROM lineitem),
guess AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY entry) - 1 AS entry, l_partkey FROM (SELECT * FROM truth WHERE l_partkey % 4 <> 0 UNION ALL SELECT document_id, 1000, l_partkey FROM truth WHERE entry = 0))"""


def entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    truth = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.row_number().over(by) - 1).alias("entry"), "l_partkey")
    extra = truth.where("entry = 0").withColumn("entry", F.lit(1000))
    again = Window.partitionBy("document_id").orderBy("entry")
    return truth, truth.where("l_partkey % 4 <> 0").unionByName(extra).withColumn("entry", F.row_number().over(again) - 1)


@query("align_positional", f"""
WITH {ENTRIES}
SELECT document_id, count(*) FILTER (WHERE t.l_partkey IS NOT NULL AND g.l_partkey IS NOT NULL)::BIGINT AS paired, count(*) FILTER (WHERE g.l_partkey IS NULL)::BIGINT AS missing,
  count(*) FILTER (WHERE t.l_partkey IS NULL)::BIGINT AS spurious
FROM truth t FULL JOIN guess g USING (document_id, entry) GROUP BY document_id
""")
def align_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, guess = entries(spark, sf_dir)
    return E.group_outcomes(E.aligned(truth, guess, ["document_id", "entry"]))


@query("align_keyed", f"""
WITH {ENTRIES}, t AS (SELECT DISTINCT document_id, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS k FROM truth), g AS (SELECT DISTINCT document_id, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS k FROM guess WHERE l_partkey % 3 <> 0)
SELECT coalesce(t.document_id, g.document_id) AS document_id, count(*) FILTER (WHERE t.document_id IS NOT NULL AND g.document_id IS NOT NULL)::BIGINT AS paired,
  count(*) FILTER (WHERE g.document_id IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE t.document_id IS NULL)::BIGINT AS spurious
FROM t FULL JOIN g ON t.document_id = g.document_id AND t.k IS NOT DISTINCT FROM g.k GROUP BY ALL
""")
def align_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By part: a missing key is a value of its own."""
    truth, guess = entries(spark, sf_dir)
    key = F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("k")
    pairs = E.aligned(truth.select("document_id", key).distinct(), guess.where("l_partkey % 3 <> 0").select("document_id", key).distinct(), ["document_id", "k"])
    return E.group_outcomes(pairs)


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("promote_labels", """
WITH c AS (SELECT user_id AS document_id, 'quality' AS field_path, event_type = 'view' AS confirmed, CASE WHEN event_id % 3 <> 0 THEN event_type END AS predicted, 'fixed ' || event_id AS corrected, ts FROM events),
last AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ts DESC, corrected DESC) = 1),
mine AS (SELECT document_id, field_path, CASE WHEN confirmed THEN predicted ELSE corrected END AS value FROM last)
SELECT document_id, field_path, CASE WHEN value IS NULL THEN 'absent' ELSE 'value' END AS expectation, value FROM mine
UNION ALL SELECT doc_id, 'quality', 'value', quality::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT document_id FROM mine)
""")
def promote_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as corrections: the last one of a field takes the label's place."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit("quality").alias("field_path"), F.lit("value").alias("expectation"), F.col("quality").cast("string").alias("value"))
    own = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.lit("quality").alias("field_path"), (F.col("event_type") == "view").alias("confirmed"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("predicted"),
        F.concat(F.lit("fixed "), F.col("event_id").cast("string")).alias("corrected"), F.col("ts").alias("at"),
    )
    return E.promoted(labels, own)


@query("redact", "SELECT doc_id, CASE WHEN source = 'src0' THEN 'restricted' ELSE 'public' END AS tier, CASE WHEN source = 'src0' THEN sha256(lang) ELSE lang END AS lang, source = 'src0' AS redacted FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src0", "restricted").otherwise("public").alias("tier"), "lang")
    return E.redacted(rows, ["lang"])


BOX = "least(abs(embedding[{0}]), abs(embedding[{1}]))::DOUBLE AS {2}0, (greatest(abs(embedding[{0}]), abs(embedding[{1}])) + 0.05)::DOUBLE AS {2}1"


@query("location_agreement", f"""
WITH e AS (SELECT vec_id, vec_id % 2 AS page, {BOX.format(1, 2, 'x')}, {BOX.format(3, 4, 'y')} FROM embeddings),
f AS (SELECT vec_id, vec_id % 3 % 2 AS page, {BOX.format(1, 5, 'x')}, {BOX.format(3, 6, 'y')} FROM embeddings WHERE vec_id % 10 <> 0)
SELECT e.vec_id AS document_id, 'value' AS field_path, CASE WHEN f.vec_id IS NULL THEN 'not_assessable'
  WHEN (CASE WHEN e.page = f.page THEN greatest(0, least(e.x1, f.x1) - greatest(e.x0, f.x0)) * greatest(0, least(e.y1, f.y1) - greatest(e.y0, f.y0)) ELSE 0 END) / ((f.x1 - f.x0) * (f.y1 - f.y0)) >= 0.5 THEN 'agrees' ELSE 'disagrees' END AS agreement
FROM e LEFT JOIN f USING (vec_id)
""")  # fmt: skip
def location_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from vectors' components: how far the found one lies within the expected one."""
    size = lambda i: F.abs(F.col("embedding")[i - 1]).cast("double")

    def boxes(rows: DataFrame, page, x: int, y: int) -> DataFrame:
        sides = {"x0": F.least(size(1), size(x)), "x1": F.greatest(size(1), size(x)) + 0.05, "y0": F.least(size(3), size(y)), "y1": F.greatest(size(3), size(y)) + 0.05}
        return rows.select(F.col("vec_id").alias("document_id"), F.lit("value").alias("field_path"), page.alias("page"), *(c.alias(n) for n, c in sides.items()))

    rows = table(spark, sf_dir, "embeddings")
    return E.location(boxes(rows, F.col("vec_id") % 2, 2, 4), boxes(rows.where("vec_id % 10 <> 0"), F.col("vec_id") % 3 % 2, 5, 6))
