"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is a stream of words: its documents in the order of a keyed hash, one after another. The stream is cut into
blocks of `block_words` words. A source whose target is e whole passes and a rest gives e permuted passes over all its
blocks and a last pass that stops exactly at the target, within a block if need be. So every source gives its quota of
block draws, numbered t = 0, 1, ... in permuted order, and no word is drawn more than once a pass.

The draws go to output shards of equal size. Which source gives how many draws to which shard is settled by a binary
tree over the shards: at every node the left half takes a multivariate-hypergeometric sample of what the node has, so
leaves sum to the exact quotas. A shard walks from the root to its leaf by itself, with random numbers seeded by the
node, so the tree is computed by as many tasks as wanted and never gathered. Within its shard, a draw's place follows a
keyed hash (the local shuffle).

Cases: a missing text has size 0 and takes part with no words; a missing source is a source of its own, last in order;
repeated rows are separate documents; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import NO_ID, WORD, dealt, text_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix holds this many words for each word of the input.
TOTAL = 1.5
#: No source gives more than this many times its own words.
MOST = 2.0
BLOCK_WORDS = 4096
SHARD_WORDS = 1 << 20
#: The vector of source quotas is held by the driver and each task; more sources than this are refused.
MAX_SOURCES = 100_000
#: Documents in one group of the running sums, and groups whose sums are taken at once.
GROUP_DOCS = 512
GROUPS = 4096
#: numpy draws from this many at most.
DRAWABLE = 10**9
SEED = 20


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share `total` by weight; a share stops at `most` times the size and its excess is shared again by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if per * weights[i] > most * sizes[i]]
        for i in over or sorted(free):
            out[i] = most * sizes[i] if over else per * weights[i]
        if not over:
            break
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


@dataclass(frozen=True)
class Quota:
    """What one source gives: passes over all n blocks, then the first `full` ranks and `rest` words of the next."""

    source: str | None
    index: int
    size: int
    target: float
    n: int
    step: int
    passes: int
    full: int
    rest: int

    @property
    def draws(self) -> int:
        return self.passes * self.n + self.full + (self.rest > 0)


def quota(source: str | None, index: int, size: int, target: float, block: int) -> Quota:
    n = -(-size // block)
    step = max(1, round(n * 0.6180339887))
    while n > 1 and math.gcd(step, n) > 1:
        step += 1
    want = round(target)
    passes, want = divmod(want, size) if size else (0, 0)
    short, at = n * block - size, start_rank(n, step, passes, n - 1)  # the last block is short; its rank in the last pass
    full = want // block
    if full > at:
        full = (want + short) // block
        rest = want + short - full * block
    else:
        rest = want - full * block
        if full == at and rest >= block - short:  # the short block is drawn whole
            full, rest = full + 1, rest - (block - short)
    return Quota(source, index, size, target, n, step, passes, full, rest)


def start_rank(n: int, step: int, turn: int, k: int) -> int:
    """The rank of block k in pass `turn`: an affine permutation of 0..n-1, another for each pass."""
    return (step * k + (turn * 7919 + 13)) % n if n else 0


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each row with a hash that orders rows within their source.

    _th covers all columns of the row, so only rows that are equal in all of them share a key.
    """
    text = text_of(docs)
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("_source"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"),
        row_hash(docs).alias("_th"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; a missing value is told apart from one in the next column, and maps are hashed as JSON."""
    columns = [docs[f"`{c}`"] for c in docs.columns]
    held = [F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)]
    return F.xxhash64(*held, *(c.isNull() for c in columns))


def quotas(docs: DataFrame, block: int = BLOCK_WORDS) -> tuple[list[Quota], int]:
    """The quota of every source, in code-point order with the missing source last, and the number of rows."""
    per = docs.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    rows = per.orderBy(F.col("_source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = [r["size"] for r in rows]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], TOTAL * sum(sizes), MOST)
    return [quota(r["_source"], i, sizes[i], goal[i], block) for i, r in enumerate(rows)], sum(r["rows"] for r in rows)


def placed(rows: DataFrame, given: list[Quota], n_rows: int) -> DataFrame:
    """Give every row the place of its first word in its source's stream (_at), without a group that grows.

    Rows are grouped by source and the leading bits of their hash; the groups' totals are summed first, then the rows
    within each group.
    """
    spark = rows.sparkSession
    n_groups = max(1, -(-n_rows // GROUP_DOCS))
    facts = spark.createDataFrame(
        [(q.source, q.index, q.size, q.target, q.n, q.step, q.passes, q.full, q.rest) for q in given],
        "_name string, _s int, source_size long, target double, _n long, _step long, _passes int, _full long, _rest long",
    )
    # One row a source: at most MAX_SOURCES of some 100 bytes, as checked in quotas().
    rows = rows.join(F.broadcast(facts), rows["_source"].eqNullSafe(facts["_name"])).drop("_source", "_name")
    order = F.xxhash64(F.lit(SEED), "_id", "_th")
    rows = rows.withColumn("_o", order).withColumn("_g", F.floor(F.shiftrightunsigned("_o", 24) * n_groups / F.lit(float(1 << 40))))
    # In two levels: GROUPS groups at a time, so that no window holds all groups of a source.
    sums = rows.groupBy("_s", "_g").agg(F.sum("size").alias("_words")).withColumn("_h", F.floor(F.col("_g") / GROUPS))
    tops = sums.groupBy("_s", "_h").agg(F.sum("_words").alias("_words"))
    before = lambda *by: F.coalesce(F.sum("_words").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tops = tops.select("_s", "_h", before("_s", "_h").alias("_top"))
    sums = sums.withColumn("_in", before("_s", "_h", "_g")).join(tops.hint("merge"), ["_s", "_h"])
    sums = sums.select("_s", "_g", (F.col("_top") + F.col("_in")).alias("_base"))
    within = Window.partitionBy("_s", "_g").orderBy("_o", "_id", "_th")
    rows = rows.withColumn("_at", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_row", F.row_number().over(within))
    # Sums and draws grow with the input, so neither is broadcast.
    return rows.join(sums.hint("merge"), ["_s", "_g"]).withColumn("_at", F.col("_at") + F.col("_base")).drop("_base", "_o")


def drawn(rows: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row for each part of a document that a draw takes: _t, the draw's number in its source, words [_from, _to).

    A document of which nothing is drawn keeps one row with a missing _t.
    """
    first, last = F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block)
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    def parts(turn: Column) -> Column:
        def part(k: Column) -> Column:
            rank = F.pmod(F.col("_step") * k + turn * 7919 + 13, F.col("_n"))
            ends = F.when((turn < F.col("_passes")) | (rank < F.col("_full")), F.lit(block)).when(rank == F.col("_full"), F.col("_rest")).otherwise(0)
            low = F.greatest(k * block - F.col("_at"), F.lit(0))
            high = F.least(k * block + ends - F.col("_at"), F.col("size"))
            return F.struct((turn * F.col("_n") + rank).alias("_t"), low.alias("_from"), high.alias("_to"))

        return F.transform(blocks, part)

    turns = F.sequence(F.lit(0).cast("long"), F.col("_passes").cast("long"))
    found = F.filter(F.flatten(F.transform(turns, parts)), lambda x: x["_to"] > x["_from"])
    return rows.withColumn("_part", F.explode_outer(found)).select("*", "_part.*").drop("_part")


def drawn_left(counts: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate-hypergeometric sample of `take` draws.

    From DRAWABLE draws on (over 4 * 10^12 words) numpy refuses; there each source's share comes from the normal
    distribution of the same mean and variance, rounded and held to what is possible, so the sums stay exact.
    """
    if counts.sum() < DRAWABLE:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts.tolist()):
        mean = take * (n / rest) if rest else 0.0
        spread = math.sqrt(max(0.0, mean * (1 - n / rest) * ((rest - take) / max(1, rest - 1)))) if rest else 0.0
        out[i] = min(max(round(mean + spread * rng.standard_normal()), take - (rest - n), 0), n, take)
        take, rest = take - int(out[i]), rest - n
    return out


def leaf(counts: np.ndarray, shards: int, shard: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The leaf `shard` of the splitting tree over `shards` leaves of near equal size, and the sum of the leaves before it."""
    total, low, high, before = int(counts.sum()), 0, shards, np.zeros_like(counts)
    while high - low > 1:
        mid = (low + high) // 2
        take = total * mid // shards - total * low // shards
        left = drawn_left(counts, take, np.random.default_rng([seed, low, high]))
        if shard < mid:
            counts, high = left, mid
        else:
            counts, before, low = counts - left, before + left, mid
    return counts, before


def split(counts: np.ndarray, shards: int, shard: int, seed: int = SEED) -> np.ndarray:
    """The leaf alone."""
    return leaf(counts, shards, shard, seed)[0]


def shard_draws(spark, given: list[Quota], shards: int) -> DataFrame:
    """(_s, _t, shard): the shard that gets draw _t of source _s. Shards take consecutive draws, which are permuted blocks."""
    counts = np.array([q.draws for q in given], dtype=np.int64)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                got, before = leaf(counts, shards, int(shard))
                some = np.flatnonzero(got)
                yield pd.DataFrame({"shard": np.full(len(some), shard), "_s": some.astype(np.int32), "_from": before[some], "_to": before[some] + got[some] - 1})

    ranges = spark.range(shards).mapInPandas(leaves, "shard long, _s int, _from long, _to long")
    return ranges.select("_s", "shard", F.explode(F.sequence("_from", "_to")).alias("_t"))


def mix_plan(docs: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix: one row for each drawn part of a document, with its shard and its place there.

    Columns: doc_id, size, source_size, target, shard, place, word_from, word_to and the row's keys (_s, _g, _row, _id,
    _th). A document of which nothing is drawn has one row with a missing shard.
    """
    rows = sized(docs)
    given, n_rows = quotas(rows, block)
    shards = max(1, math.ceil(sum(q.target for q in given) / shard_words))
    parts = drawn(placed(rows, given, n_rows), block)
    parts = parts.join(shard_draws(docs.sparkSession, given, shards).hint("merge"), ["_s", "_t"], "left")
    return parts.select(
        "doc_id", "size", "source_size", "target", "shard", F.xxhash64(F.lit(SEED), "_s", "_t").alias("place"),
        F.col("_from").alias("word_from"), F.col("_to").alias("word_to"), "_s", "_g", "_row", "_id", "_th",
    )


def mix_report(docs: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, shards (how many shards get a part of it)."""
    return (
        mix_plan(docs, block, shard_words)
        .groupBy("_s", "_g", "_row", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("word_to") - F.col("word_from")), F.lit(0)).alias("taken"), F.count_distinct("shard").alias("shards"))
        .drop("_s", "_g", "_row")
    )


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mixed documents: `docs`' own columns, one row for each pass that takes words of a document, in shard order.

    A document taken whole keeps its text; one that is taken in part has the words taken, in order, joined by spaces.
    Rows that agree in all columns stand for one another.
    """
    columns = docs.columns
    plan = mix_plan(docs, block, shard_words).where("shard IS NOT NULL")
    parts = plan.groupBy("_s", "_g", "_row", "_id", "_th").agg(F.first("size").alias("_size"), F.sort_array(F.collect_list(F.struct("word_from", "word_to", "shard", "place"))).alias("_parts"))
    # A pass takes a word once, so the i-th part that starts at a word belongs to the i-th pass.
    whole = docs.withColumns({"_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), "_th": row_hash(docs)})
    # Rows of one key are equal in all columns, so any of them is the first.
    whole = whole.groupBy("_id", "_th").agg(F.first(F.struct(*(whole[f"`{c}`"] for c in columns))).alias("_doc"))
    out = parts.join(dealt(whole), ["_id", "_th"]).select("_doc", "_size", "_parts", "_id", "_th")
    words = F.regexp_extract_all(F.coalesce(F.col("_doc.text"), F.lit("")), F.lit(WORD), F.lit(0))
    full = F.filter("_parts", lambda p: p["word_from"] == 0)
    taken = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["word_to"] - p["word_from"])
    passes = F.floor(taken / F.col("_size"))
    rest = taken - passes * F.col("_size")
    out = out.withColumns({"_passes": passes, "_left": rest, "_first": F.element_at(full, 1)})
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("_passes") + 1), lambda i: i)
    out = out.withColumn("_copy", F.explode(copies)).where("_copy <= _passes OR _left > 0")
    # What is left after whole passes are the parts of the last pass: those words that occur once more than _passes.
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("_parts", lambda p: F.array(p["word_from"], p["word_to"])))))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(edges) - 1, F.lit(1))), lambda i: F.struct(F.element_at(edges, i).alias("a"), F.element_at(edges, F.least(i + 1, F.size(edges))).alias("b")))
    covered = F.filter(spans, lambda s: F.size(F.filter("_parts", lambda p: (p["word_from"] <= s["a"]) & (p["word_to"] >= s["b"]))) > F.col("_passes"))
    # The text is cut into words once, not once a span.
    cut = lambda w: F.flatten(F.transform(covered, lambda s: F.slice(w, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
    text = F.array_join(F.get(F.transform(F.array(words), cut), 0), " ")
    out = out.withColumn("_text", F.when(F.col("_copy") <= F.col("_passes"), F.col("_doc.text")).otherwise(text))
    kind = docs.schema["text"].dataType
    place = F.element_at("_parts", 1)
    out = out.repartition(place["shard"]).sortWithinPartitions(place["shard"], place["place"], "_id", "_th", "_copy")
    return out.select(*(F.col("_text").cast(kind).alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in columns))
