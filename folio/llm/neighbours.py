"""Approximate nearest neighbours by adaptive dimension scans within probed lists.

Vectors are scaled to length 1 and turned by a fixed random rotation, so that any leading dimensions are a fair sample of
a distance. Lists are the cells of k-means centroids, which are learned from a bounded sample (SAMPLE vectors of least
keyed hash); every vector is indexed. A query probes its nearest lists, as many as the sample needs for a recall of
TARGET. Within a list the vectors lie in column blocks of BLOCK dimensions: after each block a hypothesis test compares the
distance so far, scaled to all dimensions, with the best k-th distance known, and drops candidates that are almost surely
farther. The survivors are scored exactly, as the cosine of the original vectors in double precision.

Equal vectors are one candidate with the KEEP least vec_ids, which is enough for any K neighbours and keeps no large group.
Lists are cut in chunks of CHUNK vectors, and a list that more than QUERIES queries probe is scanned by QUERIES of them at a
time, so a task's work is bounded and only crowded lists are copied.

Cases: a vector that is missing, empty, zero or that holds a missing or non-finite number takes no part, nor does one
without vec_id; vectors are compared with those of their size (another has no cosine with them): the commonest size (of
equal counts the least) has the centroids, any other size is one list, scanned whole; rows that agree in vec_id and
vector are one row; a vec_id with several vectors is one candidate, as near as its nearest vector is, and one query, as near to
a candidate as its nearest vector is; an empty table gives an empty result; with fewer than K candidates all found are returned; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, least_hashed

K = 5
EVERY = 50
KEEP = K + 1
SAMPLE = 20_000
TARGET = 0.97
LIST = 512
#: Sample vectors that a centroid is learned from, at least: SAMPLE / LEARNED lists at most.
LEARNED = 8
CHUNK = 4096
QUERIES = 4096
BLOCK = 16
#: How sure the test is before it drops a candidate; larger is surer.
EPSILON = 2.1
ROUNDS = 8
SEED = 6


def usable(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    rows = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"].cast("array<double>").alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("x")))


def distinct(rows: DataFrame) -> DataFrame:
    """(x, ids): each vector once with its KEEP least vec_ids; a common vector is cut to KEEP rows before it is dealt."""
    by = Window.partitionBy("x").orderBy("vec_id")
    return rows.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= KEEP).groupBy("x").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, size)))[0]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Index:
    size: int
    centroids: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lists of each vector of the index's size, nearest first."""
        return np.argsort(-(unit(x) @ rotation(self.size) @ self.centroids.T), axis=1, kind="stable")

    def lists(self, vectors: pd.Series, many: int) -> list[np.ndarray]:
        """The `many` nearest lists of each vector; a vector of another size n has the list -n."""
        out = [np.array([-len(v)]) for v in vectors]
        own = [i for i, v in enumerate(vectors) if len(v) == self.size]
        if own:
            for i, near in zip(own, self.nearest(np.array([vectors.iloc[i] for i in own], float))[:, :many], strict=True):
                out[i] = near
        return out


def fit(each: DataFrame) -> Index:
    """The commonest size, its centroids and the number of probes, from the sample."""
    size, many = each.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    mine = each.where(F.size("x") == size).select("x")
    got = least_hashed(mine, SAMPLE, SEED, "x").orderBy("x").collect()  # SAMPLE vectors, as they are distinct
    rng = np.random.default_rng(SEED)
    x = unit(np.array([r["x"] for r in got], float)) @ rotation(size)
    lists = int(np.clip(many // LIST, 1, max(1, len(x) // LEARNED)))
    centroids = x[rng.permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        some = np.sqrt((sums * sums).sum(1)) > 1e-9
        centroids[some] = sums[some] / np.sqrt((sums[some] ** 2).sum(1, keepdims=True))
    own = (x @ centroids.T).argmax(1)
    asked = rng.permutation(len(x))[:256]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-near, min(K, len(x) - 1), axis=1)[:, :K]
    place = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return Index(size, centroids, int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]))


def raw(vectors) -> list[bytes]:
    return [np.asarray(v, float).tobytes() for v in vectors]


def assigned(each: DataFrame, index: Index) -> DataFrame:
    """(list, ids, x): every vector with its list; x as bytes of doubles."""

    def run(batches):
        for batch in batches:
            own = index.lists(batch["x"], 1)
            yield pd.DataFrame({"list": [o[0] for o in own], "ids": batch["ids"], "x": raw(batch["x"])})

    return each.mapInPandas(run, "list int, ids array<long>, x binary")


def probing(asked: DataFrame, index: Index) -> DataFrame:
    """(list, query_id, x): every query once for each list that it probes."""

    def run(batches):
        for batch in batches:
            own = index.lists(batch["x"], index.probes)
            each = [len(o) for o in own]
            yield pd.DataFrame({"list": np.concatenate(own) if own else [], "query_id": np.repeat(batch["vec_id"].to_numpy(), each), "x": np.repeat(np.array(raw(batch["x"]), object), each)})

    return asked.mapInPandas(run, "list int, query_id long, x binary")


def survivors(blocks: list[np.ndarray], query: np.ndarray, k: int) -> np.ndarray:
    """The candidates that no test dropped and that are among the k nearest (or level with the k-th), by rotated distance."""
    n, size = len(blocks[0]), len(query)
    cuts = np.cumsum([0, *(b.shape[1] for b in blocks)])
    head = np.zeros(min(n, 8 * k))
    for b, a, z in zip(blocks, cuts, cuts[1:], strict=False):
        head += ((b[: len(head)] - query[a:z]) ** 2).sum(1)
    best = np.partition(head, k - 1)[k - 1] if len(head) >= k else np.inf
    alive, sums = np.arange(n), np.zeros(n)
    for b, a, z in zip(blocks, cuts, cuts[1:], strict=False):
        sums = sums + ((b[alive] - query[a:z]) ** 2).sum(1)
        if z < size:
            stay = sums * (size / z) <= best * (1 + EPSILON / np.sqrt(z)) ** 2 + 1e-12
            alive, sums = alive[stay], sums[stay]
    if len(sums) > k:
        alive = alive[sums <= np.partition(sums, k - 1)[k - 1] + 1e-9]
    return alive


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of each row of a with b, summed row by row, so that equal rows give equal results.

    Vectors whose squares leave the range of doubles are scaled by powers of two first, which changes no digit.
    """
    scaled = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    a, b = scaled(a), np.broadcast_to(scaled(b), a.shape)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def scan_list(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The K nearest of a list's chunk to each query."""
    out = []
    if len(rows) and len(asked):
        x = np.frombuffer(b"".join(rows["x"]), float).reshape(len(rows), -1)
        turn = rotation(x.shape[1])
        turned = unit(x) @ turn
        blocks = [np.ascontiguousarray(turned[:, a : a + BLOCK]) for a in range(0, x.shape[1], BLOCK)]
        q = np.frombuffer(b"".join(asked["x"]), float).reshape(len(asked), -1)
        ids = list(rows["ids"])
        for query_id, query, turned_query in zip(asked["query_id"], q, unit(q) @ turn, strict=True):
            # One more than K, as the nearest may be the query itself; more where several vectors have one vec_id.
            k, scored = K + 1, {}
            while True:
                near = survivors(blocks, turned_query, k)
                for i, s in zip(near, cosine(x[near], query), strict=True):
                    for v in ids[i]:
                        if v != query_id:
                            scored[int(v)] = max(s, scored.get(int(v), s))
                if len(scored) >= K or k >= len(x):
                    break
                k *= 2
            out += [(query_id, v, s) for v, s in sorted(scored.items(), key=lambda e: (-e[1], e[0]))[:K]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def search(embeddings: DataFrame, every: int = EVERY) -> DataFrame:
    """The K nearest of every query (vec_id divisible by `every`): query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    each = checkpoint(distinct(rows))
    if each.isEmpty():
        return spark.createDataFrame([], schema)
    index = fit(each)
    listed = checkpoint(assigned(each, index))
    asked = rows.where(F.col("vec_id") % every == 0).distinct()
    probes = checkpoint(probing(asked, index))
    # One row a list: SAMPLE / LEARNED and one for each further size. In chunks by vectors, in parts by queries.
    chunks = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    parts = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    cut = checkpoint(chunks.join(parts, "list"))
    every_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    slot = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    own = listed.join(cut, "list").select("list", slot("x", F.col("chunks")).alias("chunk"), every_(F.col("parts")).alias("part"), "ids", "x")
    probes = probes.join(cut, "list").select("list", every_(F.col("chunks")).alias("chunk"), slot("query_id", F.col("parts")).alias("part"), "query_id", "x")
    keys = ["list", "chunk", "part"]
    found = own.groupBy(*keys).cogroup(probes.groupBy(*keys)).applyInPandas(scan_list, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")
