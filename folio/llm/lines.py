"""Line dedup over a suffix array of line-ID sequences.

A text's lines with at least one word form a sequence; a line's ID is its rank among all lines. Prefix doubling sorts the
suffixes of all sequences: rank k of a position is the number of suffixes that are smaller in their first 2^k lines, got
from the pair of ranks k-1 at the position and 2^(k-1) lines further on. Each round is a window within the document for
the second rank, a partial count of the pairs, running sums within a rank's pairs in bounded slices, and an equality join.
Lines that occur once can't be in a repeated run and stand outside; a run stops there.

Suffixes that share their first d lines are neighbours in the array: an interval whose longest common prefix is d or more,
named by the ranks at its first and last 2^k lines (2^k <= d < 2^(k+1)). A run of d lines is repeated if its interval has
more than one suffix, and its first copy is the one of least position. Runs count from MIN_WORDS words on. Every line in
a repeated run that isn't the first copy is deleted. As every run of MIN_WORDS words contains a shortest one (no line can
be spared at one end), the intervals of shortest runs, at most MIN_WORDS lines long, decide; so doubling ends there, and
neighbouring deleted runs join to the maximal ones.

Positions are ordered by doc_id (a missing one first), then the text's hash, then line.

Cases: a missing or empty text has no lines to delete; lines without a word are kept unless they stand between deleted
lines; rows that repeat in doc_id and text are one document twice and lose the same lines; an empty table gives an empty
result; other columns are ignored by `line_report` and kept by `line_dedup`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import WORD, checkpoint, dealt, keyed, mark, real_id

MIN_WORDS = 8
#: Slices of the order in which running sums are taken.
SLICES = 64


def numbered(docs: DataFrame) -> DataFrame:
    """_id, _th, seq (from 0, among lines with words), line (from 0, among all), words, a and b (two hashes of the line)."""
    parts = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    rows = keyed(docs).select("_id", "_th", F.posexplode(F.filter(parts, lambda x: x["words"] > 0)).alias("seq", "_x"))
    return rows.select("_id", "_th", "seq", "_x.*")


def ordered(groups: DataFrame, by: list[str], key: Column, slice_: Column) -> DataFrame:
    """`groups` (with a count n) with before: the sum of n over the groups of the same `by` whose key is smaller.

    The key's order is cut in SLICES slices; sums are taken within a slice, and over slices, so no window grows with the
    number of groups of one `by`.
    """
    rows = groups.withColumns({"_key": key, "_slice": slice_})
    sums = rows.groupBy(*by, "_slice").agg(F.sum("n").alias("_n"))
    over = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_slice", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*by, "_slice").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return rows.join(dealt(sums), [*by, "_slice"]).withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in", "_slice", "_key")


def first_ranks(rows: DataFrame) -> DataFrame:
    """The rows of lines that occur more than once, with r0: the number of such lines of smaller ID."""
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    # All lines are one `by`; 4,096 leading slices of the hash keep each window small.
    counts = counts.withColumn("_one", F.shiftrightunsigned("a", 52))
    ranked = ordered(counts, ["_one"], F.struct("a", "b"), F.shiftrightunsigned("a", 46).bitwiseAND(F.lit(63)))
    tops = counts.groupBy("_one").agg(F.sum("n").alias("_n"))
    tops = tops.select("_one", F.coalesce(F.sum("_n").over(Window.orderBy("_one").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # at most 4,096 rows
    ranked = ranked.join(F.broadcast(tops), "_one").select("a", "b", (F.col("before") + F.col("_base")).alias("r0"))
    return rows.join(dealt(ranked), ["a", "b"]).drop("a", "b").distinct()


def doubled(rows: DataFrame, k: int) -> DataFrame:
    """Add r{k+1} from r{k}: the rank by the first 2^(k+1) lines."""
    top = rows.agg(F.max(f"r{k}")).first()[0] or 0
    step, name, after = 1 << k, f"r{k}", f"r{k + 1}"
    ahead = Window.partitionBy("_id", "_th").orderBy("seq").rangeBetween(step, step)
    # Where the sequence leaves the repeated lines the suffix is alone: its second rank is a number of its own, after all.
    alone = F.xxhash64(F.lit(k), "_id", "_th", "seq").bitwiseAND(F.lit((1 << 62) - 1))
    rows = rows.withColumn("_next", F.first(name).over(ahead)).withColumn("_alone", F.col("_next").isNull()).withColumn("_second", F.coalesce("_next", alone))
    pairs = rows.groupBy(name, "_alone", "_second").agg(F.count("*").alias("n"))
    slice_ = F.when(F.col("_alone"), SLICES + F.shiftrightunsigned("_second", 56)).otherwise(F.floor(F.col("_second") * F.lit(SLICES / (top + 1))))
    ranked = ordered(pairs, [name], F.struct("_alone", "_second"), slice_).select(name, "_alone", "_second", (F.col(name) + F.col("before")).alias(after))
    return rows.join(dealt(ranked), [name, "_alone", "_second"]).drop("_next", "_alone", "_second")


def suffix_array(docs: DataFrame, depth: int) -> DataFrame:
    """_id, _th, seq, line, words and the ranks r0 to rK (2^K the largest power up to depth) of repeated lines' positions.

    Ordered by rK the rows are the suffix array of the repeated lines, sorted by their first 2^K lines.
    """
    rows = first_ranks(numbered(docs))
    for k in range(depth.bit_length() - 1):
        rows = doubled(checkpoint(rows), k)
    return checkpoint(rows)


def runs(array: DataFrame, min_words: int) -> DataFrame:
    """The shortest runs of min_words words: _id, _th, seq, d (lines) and the name of their interval (d, x, y)."""
    top = min_words.bit_length() - 1
    by = Window.partitionBy("_id", "_th").orderBy("seq")
    # The lines from a position on, or up to it, that follow one another in the text.
    item = F.struct("seq", "words", *(f"r{k}" for k in range(top + 1)))
    near = array.withColumn("_ahead", F.collect_list(item).over(by.rangeBetween(0, min_words - 1)))
    total = lambda d: F.aggregate(F.slice("_ahead", 1, d), F.lit(0), lambda s, x: s + x["words"])
    joined = lambda d: F.get("_ahead", d - 1)["seq"] == F.col("seq") + d - 1
    found = []
    for d in range(1, min_words + 1):
        k = d.bit_length() - 1
        ends = F.get("_ahead", F.lit(d - 1))
        enough = (total(d) >= min_words) & ((total(d) - F.col("words") < min_words) | (total(d - 1) < min_words) if d > 1 else F.lit(True))
        name = F.struct(F.lit(d).alias("d"), F.col(f"r{k}").alias("x"), F.get("_ahead", F.lit(d - (1 << k)))[f"r{k}"].alias("y"), (ends["words"] * 0).alias("_"))
        found.append(F.when(joined(F.lit(d)) & enough, name))
    return near.select("_id", "_th", "seq", "line", F.explode(F.array_compact(F.array(*found))).alias("_r")).select("_id", "_th", "seq", "line", "_r.d", "_r.x", "_r.y")


def deleted(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to delete as maximal runs: _id, _th, gone (sorted array of structs from_line, to_line)."""
    array = suffix_array(docs, min_words)
    found = checkpoint(runs(array, min_words))
    place = F.struct("_id", "_th", "seq")
    heads = found.groupBy("d", "x", "y").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    later = found.join(dealt(checkpoint(heads)), ["d", "x", "y"]).where(place > F.col("_first"))
    lines_ = array.select("_id", "_th", "seq", "line")
    by = Window.partitionBy("_id", "_th").orderBy("seq")
    reach = later.groupBy("_id", "_th", "seq").agg(F.max(F.col("seq") + F.col("d")).alias("_to"))
    marked = lines_.join(dealt(reach), ["_id", "_th", "seq"], "left")
    marked = marked.withColumn("_till", F.max("_to").over(by.rowsBetween(Window.unboundedPreceding, 0))).where("seq < _till")
    start = F.when(F.lag("seq").over(by).isNull() | (F.col("seq") > F.lag("seq").over(by) + 1), 1).otherwise(0)
    marked = marked.withColumn("_start", start).withColumn("_run", F.sum("_start").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    maximal = marked.groupBy("_id", "_th", "_run").agg(F.min("line").alias("from_line"), F.max("line").alias("to_line"))
    return maximal.groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("from_line", "to_line"))).alias("gone"))


def left(text: Column) -> Column:
    """The lines outside the runs in `gone`: runs and gaps are spread to one flag a line, so lines and runs are walked once."""
    lines_ = F.split(text, "\n")
    flags = lambda keep, n: F.array_repeat(F.lit(keep), n.cast("int"))
    behind = lambda i: F.coalesce(F.get("gone", i - 1)["to_line"] + 1, F.lit(0))
    spread = F.flatten(F.transform("gone", lambda g, i: F.concat(flags(True, g["from_line"] - behind(i)), flags(False, g["to_line"] - g["from_line"] + 1))))
    kept = F.concat(spread, flags(True, F.size(lines_) - behind(F.size("gone"))))
    return F.when(F.col("gone").isNull(), lines_).otherwise(F.array_compact(F.zip_with(lines_, kept, lambda x, keep: F.when(keep, x))))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, kept_sha256 (of the lines left, joined by line ends)."""
    rows = keyed(docs).select("_id", "_th", "text").join(dealt(deleted(docs, min_words)), ["_id", "_th"], "left").withColumn("_left", left(F.col("text")))
    n = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select(real_id("_id"), n.alias("n_lines"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")) - F.size("_left")).cast("long").alias("n_removed"), F.sha2(F.array_join("_left", "\n"), 256).alias("kept_sha256"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies of repeated line runs deleted from the text."""
    rows = mark(docs).join(dealt(deleted(docs, min_words)), ["_id", "_th"], "left")
    kind = docs.schema["text"].dataType
    text = F.when(F.col("gone").isNull(), F.col("_row.text")).otherwise(F.array_join(left(F.col("_row.text").cast("string")), "\n").cast(kind))
    return rows.withColumn("_text", text).select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


#: The same report in DuckDB's SQL, for tables without repeated doc_ids.
REPORT_SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s, coalesce(text, '') AS text FROM documents),
line AS (SELECT doc_id, i - 1 AS line, s[i] AS t, len(regexp_extract_all(s[i], '[^\\x20\\x09-\\x0D]+')) AS words FROM cut, unnest(range(1, len(s) + 1)) AS u(i)),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS seq FROM line WHERE words > 0),
run AS (
  SELECT a.doc_id, a.seq, d, list(b.t ORDER BY b.seq) AS run
  FROM seq a, range(1, {MIN_WORDS + 1}) AS r(d) JOIN seq b ON b.doc_id = a.doc_id AND b.seq BETWEEN a.seq AND a.seq + d - 1
  GROUP BY ALL HAVING count(*) = d AND sum(b.words) >= {MIN_WORDS}),
head AS (SELECT run, min(struct_pack(doc_id := doc_id, seq := seq)) AS first FROM run GROUP BY run HAVING count(*) > 1),
later AS (SELECT r.doc_id, r.seq, r.d FROM run r JOIN head USING (run) WHERE struct_pack(doc_id := r.doc_id, seq := r.seq) > first),
gone AS (SELECT DISTINCT s.doc_id, s.seq, s.line FROM later l JOIN seq s ON s.doc_id = l.doc_id AND s.seq BETWEEN l.seq AND l.seq + l.d - 1),
span AS (
  SELECT doc_id, min(line) AS a, max(line) AS b
  FROM (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS g FROM gone) GROUP BY doc_id, g),
out AS (SELECT l.doc_id, l.line, l.t, bool_or(s.a IS NOT NULL) AS gone FROM line l LEFT JOIN span s ON s.doc_id = l.doc_id AND l.line BETWEEN s.a AND s.b GROUP BY ALL)
SELECT o.doc_id, max(CASE WHEN c.text = '' THEN 0 ELSE len(c.s) END)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(o.t, chr(10) ORDER BY o.line) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM out o JOIN cut c ON c.doc_id = o.doc_id GROUP BY o.doc_id
"""
