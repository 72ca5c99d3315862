"""Queries on document construction, spans, text layers and parser choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalogue import query
from folio.functions import text as T
from folio.operators import documents as D
from folio.plans.tables import table

PAGE = 2000

#: SQL that gives the pages of PAGE characters.
TILES = f"""tile AS (
  SELECT doc_id AS document_id, k AS page_index, k * {PAGE} AS span_start, least((k + 1) * {PAGE}, length(text)) AS span_end,
    substr(text, k * {PAGE} + 1, {PAGE}) AS text
  FROM documents, unnest(range(greatest(1, cast(ceil(length(text) / {PAGE}.0) AS BIGINT)))) AS u(k))"""
#: A passage's next place begins behind the end of the last.
HITS = """hit AS (
  SELECT d.doc_id AS document_id, b.item_id AS needle_id, p AS span_start, p + length(b.text) AS span_end
  FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text),
    unnest(list_reduce(list_transform(list_filter(range(length(d.text) - length(b.text) + 1), lambda i: substr(d.text, i + 1, length(b.text)) = b.text), lambda i: [i]),
      lambda taken, p: CASE WHEN p[1] >= taken[-1] + length(b.text) THEN list_concat(taken, p) ELSE taken END)) AS u(p))"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))


def lengths(rows: DataFrame) -> DataFrame:
    return rows.select("document_id", F.length("text").alias("length"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    return D.find(docs(spark, sf_dir), needles)


HEADS = ("89504E470D0A1A0A", "255044462D312E37", "FFD8FFE0", "49492A00", "")


@query("source_scan", f"""
WITH raw AS (SELECT doc_id, unhex(CASE doc_id % 5 {" ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADS))} END) || encode(text) AS content FROM documents),
kind AS (SELECT *, CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/tiff' END AS media_type FROM raw)
SELECT doc_id, media_type, octet_length(content)::BIGINT AS size_bytes, 'sha256:' || sha256(content) AS blob_id,
  CASE WHEN media_type IS NULL THEN 'unrecognized' WHEN media_type = 'image/tiff' THEN 'mime_type' END AS refusal
FROM kind
""")  # fmt: skip
def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes with a media type by signature, their content id and why they are refused."""
    head = F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"))
    size = F.length("content").cast("long")
    rows = rows.select("doc_id", T.media_type(F.col("content")).alias("media_type"), size.alias("size_bytes"), T.content_id(F.col("content")).alias("blob_id"))
    return rows.withColumn("refusal", T.refusal(F.col("media_type"), F.col("size_bytes")))


@query("meaningful_length", r"""
SELECT doc_id, length(regexp_replace(text, '[\p{C}\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{FFFD}]', '', 'g'))::INT AS meaningful
FROM documents
""")
def meaningful_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.meaningful_length(F.col("text")).alias("meaningful"))


@query("text_layer_verdict", rf"""
WITH {TILES},
page AS (SELECT document_id, length(regexp_replace(text, '[\p{{C}}\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{FFFD}}]', '', 'g')) >= 100 AS bearing FROM tile)
SELECT document_id, count(*)::BIGINT AS pages, count(*) FILTER (WHERE bearing)::BIGINT AS bearing,
  count(*) FILTER (WHERE bearing) >= count(*) * 0.5 AND count(*) FILTER (WHERE bearing) > 0 AS usable
FROM page GROUP BY document_id
""")  # fmt: skip
def text_layer_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_layer(D.tiles(docs(spark, sf_dir), PAGE))


REGISTRY = (
    ("layout", ["application/pdf", "image/png", "image/jpeg"], ["text", "geometry", "tables"], True, 2),
    ("native", ["application/pdf"], ["text", "geometry"], True, 0),
    ("lines", ["image/png", "image/jpeg"], ["text", "geometry"], True, 1),
    ("offline", ["application/pdf", "image/png"], ["text", "geometry", "tables"], False, 0),
)


@query("parser_route", """
SELECT doc_id AS document_id,
  CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'layout' ELSE 'lines' END
       WHEN doc_id % 5 = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'layout' ELSE 'native' END
       WHEN doc_id % 5 = 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'layout' ELSE 'lines' END END AS parser_id,
  CASE WHEN doc_id % 5 >= 3 THEN 'no_parser' END AS refusal
FROM documents
""")
def parser_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first available parser that takes a document's type and supplies what it needs."""
    registry = spark.createDataFrame(list(REGISTRY), "parser_id string, media_types array<string>, supplies array<string>, available boolean, priority int")
    kinds = F.array(*(F.lit(k) for k in ("image/png", "application/pdf", "image/jpeg", "image/tiff")))
    kind = F.try_element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int"))
    needs = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("text"), F.lit("tables"))).otherwise(F.array(F.lit("text")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), kind.alias("media_type"), needs.alias("needs"))
    return D.parser_for(rows, registry)


@query("page_tiling_check", f"""
WITH {TILES}
SELECT document_id, count(*)::BIGINT AS pages, max(span_end) = any_value(length(d.text)) AND count(*) = count(DISTINCT page_index) AS tiled
FROM tile JOIN documents d ON d.doc_id = document_id GROUP BY document_id
""")  # fmt: skip
def page_tiling_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return D.tiling(D.tiles(rows, PAGE), lengths(rows))


CONVERSATION_WORDS = r"""word AS (
  SELECT conv_id AS document_id, turn AS line, i - 1 AS ord, w[i] AS word
  FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), unnest(range(1, len(w) + 1)) AS u(i) WHERE w[i] <> '')"""


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("line"), F.posexplode(F.split("text", " ")).alias("ord", "word"))


@query("token_offsets", f"""
WITH {CONVERSATION_WORDS}
SELECT document_id, line, ord, word, s - length(word) - 1 AS span_start, s - 1 AS span_end
FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY document_id ORDER BY line, ord)::BIGINT AS s FROM word)
""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word of a conversation stands in the text that joins its turns."""
    return D.built(conversation_words(spark, sf_dir))


@query("built_text", f"""
WITH {CONVERSATION_WORDS}, line AS (SELECT document_id, line, string_agg(word, ' ' ORDER BY ord) AS l FROM word GROUP BY ALL)
SELECT document_id, string_agg(l, chr(10) ORDER BY line) || chr(10) AS text FROM line GROUP BY document_id
""")
def built_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.built_text(D.built(conversation_words(spark, sf_dir)))


@query("token_violations", f"""
WITH {CONVERSATION_WORDS},
span AS (SELECT *, s - length(word) - 1 - (CASE WHEN ord % 7 = 6 THEN 3 ELSE 0 END) AS a, s - 1 AS b FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY document_id ORDER BY line, ord)::BIGINT AS s FROM word)),
seq AS (SELECT *, lag(b) OVER (PARTITION BY document_id ORDER BY line, ord) AS before FROM span)
SELECT document_id, a AS span_start, CASE WHEN a < 0 THEN 'bounds' ELSE 'order' END AS reason FROM seq WHERE a < 0 OR a < before
""")  # fmt: skip
def token_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh word of a line is moved on to the one before; the check finds those."""
    spans = D.built(conversation_words(spark, sf_dir))
    wrong = spans.withColumn("span_start", F.col("span_start") - F.when(F.col("ord") % 7 == 6, 3).otherwise(0)).withColumn("ord", F.struct("line", "ord"))
    return D.violations(wrong, spans.groupBy("document_id").agg((F.max("span_end") + 1).alias("length")))


@query("find_exact_spans", f"WITH {HITS} SELECT * FROM hit")
def find_exact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("document_id", "needle_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@query("page_for_span", f"""
WITH {TILES}, {HITS}
SELECT h.document_id, h.needle_id, h.span_start, h.span_end, array_to_string(list_sort(list(DISTINCT page_index)), ',') AS pages
FROM hit h JOIN tile t ON t.document_id = h.document_id AND h.span_start < t.span_end AND h.span_end > t.span_start AND t.span_start < t.span_end GROUP BY ALL
""")
def page_for_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a found passage touches."""
    out = D.pages_for(find_exact_spans(spark, sf_dir), D.tiles(docs(spark, sf_dir), PAGE), PAGE)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


@query("slice_tokens", f"""
WITH {CONVERSATION_WORDS},
span AS (SELECT *, s - length(word) - 1 AS a, s - 1 AS b FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY document_id ORDER BY line, ord)::BIGINT AS s FROM word))
SELECT document_id, word, a - 50 AS span_start, b - 50 AS span_end FROM span WHERE a >= 50 AND b <= 250 AND a < b
""")  # fmt: skip
def slice_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sliced(D.built(conversation_words(spark, sf_dir)), 50, 250).select("document_id", "word", "span_start", "span_end")


@query("merge_offsets", """
SELECT conv_id AS document_id, turn AS part, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length(text)::INT AS length
FROM conversations
""")
def merge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merged(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("part"), "text"))


@query("token_at", f"""
WITH {CONVERSATION_WORDS},
span AS (SELECT *, s - length(word) - 1 AS a, s - 1 AS b FROM (SELECT *, sum(length(word) + 1) OVER (PARTITION BY document_id ORDER BY line, ord)::BIGINT AS s FROM word)),
place AS (SELECT document_id, k * 37 AS place FROM (SELECT document_id, max(b) AS n FROM span GROUP BY document_id), unnest(range(n // 37 + 1)) AS u(k))
SELECT p.document_id, p.place::BIGINT AS place, a AS span_start, b AS span_end FROM place p LEFT JOIN span s ON s.document_id = p.document_id AND a <= place AND place < b
""")  # fmt: skip
def token_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token at every 37th place of each conversation's text."""
    spans = D.built(conversation_words(spark, sf_dir))
    places = spans.groupBy("document_id").agg(F.max("span_end").alias("_n")).select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"), F.lit(37).cast("long"))).alias("place"))
    return D.token_at(spans, places)


@query("token_budget", "SELECT doc_id, (floor(length(text) / 1.20::DOUBLE * 1.15::DOUBLE) + 1)::INT AS tokens, (floor(length(text) / 1.20::DOUBLE * 1.15::DOUBLE) + 1) > 20000 AS refused FROM documents")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))
    return rows.withColumn("refused", F.col("tokens") > 20000)


@query("grouped_chars", r"""
WITH ch AS (SELECT conv_id AS document_id, turn * 10000000 + i AS pos, substr(text || chr(10), i, 1) AS c FROM conversations, unnest(range(1, length(text) + 2)) AS u(i)),
flag AS (SELECT *, regexp_full_match(c, '[\p{Cc}\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') AS gap FROM ch),
sums AS (
  SELECT *, coalesce(sum((c = chr(10))::INT) OVER w, 0)::BIGINT AS line, coalesce(sum(gap::INT) OVER w, 0) AS word_no FROM flag
  WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT document_id, line, row_number() OVER (PARTITION BY document_id, line ORDER BY word_no)::INT - 1 AS ord, word
FROM (SELECT document_id, line, word_no, string_agg(c, '' ORDER BY pos) AS word FROM sums WHERE NOT gap GROUP BY ALL)
""")
def grouped_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, character by character, put together to words and lines."""
    chars = F.filter(F.split(F.concat("text", F.lit("\n")), ""), lambda c: c != "")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "turn", F.posexplode(chars).alias("_i", "char"))
    return D.grouped_chars(rows.select("document_id", F.struct("turn", "_i").alias("at"), "char"))


@query("locate_spans", f"""
WITH {HITS},
part AS (SELECT doc_id AS document_id, k AS ord, k * 7 AS a, least(k * 7 + 6, length(text)) AS b FROM documents, unnest(range(cast(ceil(length(text) / 7.0) AS BIGINT))) AS u(k))
SELECT h.document_id, h.needle_id, h.span_start, h.span_end, ord, a AS token_start, b AS token_end FROM hit h JOIN part p ON p.document_id = h.document_id AND h.span_start < b AND h.span_end > a AND a < b
""")
def locate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of six characters that a found passage touches."""
    rows = docs(spark, sf_dir)
    last = F.ceil(F.length("text") / 7) - 1
    pieces = rows.where("text <> ''").select("document_id", F.length("text").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("ord"))
    pieces = pieces.select("document_id", "ord", (F.col("ord") * 7).alias("span_start"), F.least(F.col("ord") * 7 + 6, F.col("_n").cast("long")).alias("span_end"))
    return D.tokens_in(find_exact_spans(spark, sf_dir), pieces)


@query("page_references", f"""
WITH {TILES}, token AS (SELECT document_id, page_index + CASE WHEN document_id % 50 = 0 THEN 1 ELSE 0 END AS page_index, span_start + CASE WHEN document_id % 20 = 0 THEN -1 ELSE 0 END AS a, span_end AS b FROM tile)
SELECT t.document_id, t.a AS span_start, CASE WHEN p.page_index IS NULL THEN 'no_page' ELSE 'outside_page' END AS reason
FROM token t LEFT JOIN tile p ON p.document_id = t.document_id AND p.page_index = t.page_index WHERE p.page_index IS NULL OR t.a < p.span_start OR t.b > p.span_end
""")
def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as tokens of their own, some of them on a wrong page or beginning too early."""
    pages = D.tiles(docs(spark, sf_dir), PAGE)
    key = F.col("document_id")
    tokens = pages.select("document_id", (F.col("page_index") + F.when(key % 50 == 0, 1).otherwise(0)).alias("page_index"), (F.col("span_start") - F.when(key % 20 == 0, 1).otherwise(0)).alias("span_start"), "span_end")
    return D.page_references(tokens, pages)
