"""Secret scans by character Markov models, in built-in functions only.

Base kinds are three fixed patterns. The method adds spans of kind `markov`: tokens whose characters look drawn at random
rather than written. Two first-order Markov models over 68 characters are trained from labelled samples: random
strings (values that the base patterns mark, and digests in several alphabets) and ordinary identifiers (tokens of the
texts that no base pattern marks). A token of 20 characters or more that holds a digit is a span if the log-likelihood
ratio of the two models per transition is at least THRESHOLD; words without a digit are never drawn at random.

The sample is the SAMPLE_DOCS documents of least keyed hash: a bounded sample of labelled rows. The models are two tables
over the fixed alphabet (some 4,000 pairs), so their size doesn't follow the input. Scoring happens within a row; nothing
is shuffled but the sample's counts.

Cases: a missing or empty text has no spans (base_sha256 is that of the empty string); repeated rows give repeated
results; a missing doc_id stays missing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import least_hashed, text_of
from folio.llm.native import placed

#: The base kinds in order, their patterns and the least length of what they mark.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
TOKEN = r"[A-Za-z0-9+/_.=-]{20,}"
TRAIN_TOKEN = r"[A-Za-z0-9+/_.=-]{4,}"
SAMPLE_DOCS = 2000
DIGESTS = 4000
#: Labelled by hand: ordinary identifiers, so that a corpus without any still has a model of them. Each counts ORDINARY_WEIGHT times.
ORDINARY = (
    "internationalization", "configuration_manager", "getUserNameFromSession", "max_retry_count", "application.properties", "department/organization", "characteristics", "responsibilities", "SerializationException",
    "java.util.concurrent.atomic", "src/main/resources/templates", "background-color-transparent", "AUTHENTICATION_REQUIRED", "createTableIfNotExists", "user_account_settings", "representation", "numberOfElements",
    "com.example.service.implementation", "test_connection_timeout_error", "node_modules/typescript/lib", "acknowledgements", "version-2.14.0-release-notes", "include/linux/netdevice.h", "ThreadPoolExecutorFactory",
)
ORDINARY_WEIGHT = 200
#: Nats per transition by which a token must be likelier as a random string.
THRESHOLD = 0.3
SEED = 4
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """The leftmost non-overlapping matches that `keep` (a function of the match) accepts, as structs (start, kind, stop)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), F.length)
    # The last gap is followed by no match.
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))
    kept = F.filter(placed(steps, size, "struct<gap:int,match:string>"), lambda p: p["x"]["match"].isNotNull() & keep(p["x"]["match"]))
    return F.transform(kept, lambda p: F.struct((p["at"] + p["x"]["gap"]).alias("start"), F.lit(kind).alias("kind"), (p["at"] + size(p["x"])).alias("stop")))


def base_spans(text: Column) -> list[Column]:
    """The base spans by kind; a text without a kind's possible match isn't cut."""
    none = F.array().cast(SPAN)
    assign = spans(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST["assign"])
    access = spans(text, ACCESS, 1, lambda m: F.length(m) >= LEAST["access"])
    # Only runs of the least length can pass, and runs are maximal, so shorter ones need not be cut out.
    long_hex = spans(text, rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}", 2, lambda m: F.lit(True))
    return [
        F.when(text.rlike(ASSIGN), assign).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), access).otherwise(none),
        F.when(text.rlike(rf"[0-9a-f]{{{LEAST['hex']}}}"), long_hex).otherwise(none),
    ]


def samples(docs: DataFrame) -> DataFrame:
    """The labelled samples (word, random): digests and marked values are random, other tokens of the texts ordinary."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = least_hashed(rows, SAMPLE_DOCS, SEED, "doc_id", "text").select("text")
    marked = F.concat(
        F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(rf"{ACCESS}(?<=[A-Z0-9]{{{LEAST['access']}}})"), F.lit(0)),
        F.regexp_extract_all("text", F.lit(rf"[0-9a-f]{{{LEAST['hex']},}}"), F.lit(0)),
    )
    rest = F.regexp_extract_all(F.regexp_replace("text", rf"{ASSIGN}|AKIA[A-Z0-9]+|[0-9a-f]{{{LEAST['hex']},}}", " "), F.lit(TRAIN_TOKEN), F.lit(0))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    words = F.array(digest, F.base64(F.unhex(digest)), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", ""))
    made = docs.sparkSession.range(DIGESTS).select(F.explode(words).alias("word"), F.lit(True).alias("random"))
    listed = docs.sparkSession.createDataFrame([(w,) for w in ORDINARY], "word string").select("word", F.explode(F.sequence(F.lit(1), F.lit(ORDINARY_WEIGHT))).alias("_i"), F.lit(False).alias("random"))
    made = made.unionByName(listed.drop("_i"))
    return rows.select(F.explode(marked).alias("word"), F.lit(True).alias("random")).unionByName(rows.select(F.explode(rest).alias("word"), F.lit(False).alias("random"))).unionByName(made)


def ratios(docs: DataFrame) -> list[float]:
    """The log-likelihood ratio of every transition, random against ordinary, at index 68 * from + to (add-half smoothing)."""
    n = len(ALPHABET)
    chars = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_c") - 1, F.lit(1))), lambda i: F.get("_c", i - 1) * n + F.get("_c", i))
    rows = samples(docs).withColumn("_c", chars).where(F.size("_c") > 1).select("random", F.explode(pair).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in rows.groupBy("random", "pair").count().collect()}  # at most 2 * 68 * 68 rows
    total = {(kind, a): sum(counts.get((kind, a * n + b), 0) for b in range(n)) for kind in (True, False) for a in range(n)}
    share = lambda kind, a, b: (counts.get((kind, a * n + b), 0) + 0.5) / (total[kind, a] + 0.5 * n)
    return [log(share(True, a, b) / share(False, a, b)) for a in range(n) for b in range(n)]


def markov_spans(text: Column, table: Column) -> Column:
    """Tokens that the models find random."""
    n = len(ALPHABET)

    def likely(word: Column) -> Column:
        places = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        total = F.aggregate(places, start, lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * n + c))).alias("sum")), lambda s: s["sum"])
        return (total >= THRESHOLD * (F.length(word) - 1)) & word.rlike("[0-9]")

    return F.when(text.rlike(TOKEN), spans(text, TOKEN, 3, likely)).otherwise(F.array().cast(SPAN))


def written(found: Column) -> Column:
    """Spans by start, then kind, as kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), one), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Spans count code points, ends exclusive."""
    # A constant of 4,624 numbers, whatever the input.
    model = F.split(F.lit(" ".join(map(repr, ratios(docs)))), " ").cast("array<double>")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("_text"))
    assign, access, hexes = base_spans(F.col("_text"))
    rows = rows.select("doc_id", assign.alias("_assign"), access.alias("_access"), hexes.alias("_hex"), markov_spans(F.col("_text"), model).alias("_markov"))
    base = F.concat("_assign", "_access", "_hex")
    return rows.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.concat(base, F.col("_markov"))).alias("spans"),
    )
