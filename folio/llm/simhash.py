"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits: a bit is 1 if it is set in over half the XXH64 hashes of the text's 3-word shingles. Two
fingerprints with at most 3 differing bits have a half (32 bits) in which at most one bit differs. So every half is
indexed under its 32 one-wildcard variants (the half with one bit deleted, and which bit); halves that differ by at most
one bit share a variant, and an equality join of variants followed by a check of the distance finds all links.

Only distinct fingerprints are joined. A variant that many fingerprints share is not paired off: its members are indexed
further, by quarters of the other half with one bit deleted, so that only members near each other meet. Members of one
such index entry agree in all but 18 bits; where it is still crowded, each member asks for the 987 fingerprints that
differ from it in one to three of these bits, by an equality join. So no group is paired off beyond THRONG members.

Cases: a missing or empty text has fingerprint zero and is linked like any other; repeated rows share a component; a
missing doc_id counts last for component_id (a component of missing ids alone has a missing one); an empty table gives
an empty result; other columns are ignored by `simhash` and kept by `near_dedup`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, components, dealt, each_batch, keyed, mark, real_id

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: Variants with more members than this are indexed further before members are compared.
CROWD = 32
#: Members of an index entry that are paired off at most; beyond it, neighbours are asked for.
THRONG = 1024
#: Distinct fingerprints whose variants one task makes, about.
TASK_ROWS = 20_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    # bytes.split() cuts at exactly the six separators of the contract.
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), ">u8", len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """_id, _th, doc_id and fp (the fingerprint as a signed long) of every row."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        fp = np.array([fingerprint(t) for t in batch["text"]], np.uint64).astype(np.int64)
        return pd.DataFrame({"_id": batch["_id"], "_th": batch["_th"], "fp": fp})

    found = each_batch(keyed(docs).drop("doc_id"), step, "_id long, _th long, fp long")
    return found.withColumn("doc_id", real_id("_id"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of the two halves; a key holds the half's number, the bit and the rest."""

    def key(j: Column) -> Column:
        part = F.when(j < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
        bit = F.pmod(j, F.lit(32))
        rest = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))
        return j * F.lit(1 << 32) + rest

    return fps.select("fp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), key)).alias("key"))


def finer(crowded: DataFrame) -> DataFrame:
    """(key, sub, fp): members of crowded variants under the one-wildcard variants of the other half's quarters.

    Two members that are linked differ by at most 3 bits in the other half, so by at most one in one of its quarters.
    """
    other = F.when(F.shiftright("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))

    def sub(j: Column) -> Column:
        part = F.when(j < 16, F.col("_o").bitwiseAND(F.lit(0xFFFF))).otherwise(F.shiftrightunsigned("_o", 16))
        bit = F.pmod(j, F.lit(16))
        rest = part.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))
        return j * F.lit(1 << 16) + rest

    return crowded.withColumn("_o", other).select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long")), sub)).alias("sub"))


def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    left, right = rows.withColumnRenamed("fp", "u"), rows.withColumnRenamed("fp", "v")
    met = left.join(dealt(right), keys).where("u > v")
    return met.where(distance(F.col("u"), F.col("v")) <= DISTANCE).select("u", "v").distinct()


def asked(rows: DataFrame) -> DataFrame:
    """Edges between members (key, sub, fp) of thronged entries: every fp joined with those that differ in 1 to DISTANCE of the entry's 18 free bits."""
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    j, s = F.shiftright("key", 32), F.shiftright("sub", 16)
    # The bits left out of the half and of the other half's quarter, and the other quarter's.
    base = F.when(j < 32, 32).otherwise(0)
    free = F.array(one(j), one(base + s), *(one(base + F.when(s < 16, 16).otherwise(0) + i) for i in range(16)))
    picks = [c for n in range(1, DISTANCE + 1) for c in combinations(range(18), n)]
    masks = F.transform(F.array(*(F.array(*(F.lit(i) for i in c)) for c in picks)), lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.get("_free", i))))
    wanted = rows.withColumn("_free", free).select("fp", F.explode(masks).alias("_m")).select(F.col("fp").alias("u"), F.col("fp").bitwiseXOR(F.col("_m")).alias("v")).where("u > v")
    members = rows.select(F.col("fp").alias("v")).distinct()
    return wanted.join(dealt(members), "v", "left_semi").select("u", "v").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that differ in at most DISTANCE bits."""
    index = variants(fps)
    counts = index.groupBy("key").count().where("count > 1")
    shared = checkpoint(index.join(dealt(counts), "key"))
    near = pairs(shared.where(F.col("count") <= CROWD).select("key", "fp"), ["key"])
    fine = finer(shared.where(F.col("count") > CROWD).select("key", "fp"))
    fine = checkpoint(fine.join(dealt(fine.groupBy("key", "sub").count().where("count > 1")), ["key", "sub"]))
    far = pairs(fine.where(F.col("count") <= THRONG).select("key", "sub", "fp"), ["key", "sub"])
    return near.unionByName(far).unionByName(asked(fine.where(F.col("count") > THRONG))).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """_id, _th, doc_id, fp and component (the least fingerprint linked) of every row."""
    rows = checkpoint(fingerprints(docs))
    # Each gives 64 variants: a number of partitions by rows, which isn't coalesced by bytes.
    tasks = max(1, -(-rows.count() // TASK_ROWS))
    found = components(links(rows.select("fp").distinct().repartition(tasks, "fp")))
    return rows.join(dealt(found), rows["fp"] == found["node"], "left").select("doc_id", "_id", "_th", "fp", F.coalesce("root", "fp").alias("component"))


def simhash(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id reachable)."""
    rows = classes(docs)
    # Written out, so that the join deals both sides by itself and can split a component that holds many rows.
    heads = checkpoint(rows.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return rows.join(dealt(heads), "component").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: the one of least doc_id (missing ids last), then of least text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_th").alias("c"))
    best = classes(docs).groupBy("component").agg(F.min(order).alias("_o")).select(F.col("_o.b").alias("_id"), F.col("_o.c").alias("_th"))
    kept = mark(docs).join(dealt(best), ["_id", "_th"], "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select("_row.*")
