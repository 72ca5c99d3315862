"""Centroid clustering of integer vectors with partial-distance search.

Components are integers, floor(256 x), so distances and means are exact and do not depend on the order of rows. The dimensions are
taken by falling variance over all vectors. For each vector the squared differences to all centroids are added up over the
first BLOCK dimensions; the centroid that leads there is measured to the end, and its distance is the bound: a centroid whose
partial sum is strictly above it is abandoned after any further block, the others finish all dimensions. Ties go to the smaller number.

A round sends the 40 centroids to the tasks, and each task gives one row a centroid (count and sums), so a round shuffles 40
rows a task however large a cluster is. Vectors are read from their table each round: nothing is held or cut.

Cases: vectors that are missing, of another size than 64 or with a missing or non-finite component take no part; repeated rows
count each; a row without vec_id takes part but comes last as a start; starts of equal hash are ordered by their vectors; with
fewer than 40 vectors all are starts; components beyond 2^27 (x beyond 524,288) count as that, so that every distance is
a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 64
CLUSTERS = 40
ROUNDS = 5
SCALE = 256
LIMIT = 2**27
BLOCK = 8
#: Vectors measured at once.
CHUNK = 4096


def report_sql(rounds: int = ROUNDS, clusters: int = CLUSTERS) -> str:
    """The same rows in DuckDB's SQL, round by round."""
    steps = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE)))),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, x) - 1 AS k, x FROM v
  QUALIFY k < {clusters})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT id, min(struct_pack(d := d, k := k)) AS best FROM (
    SELECT v.id, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} c) GROUP BY id)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS (
  SELECT k, i, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(x) AS e, unnest(range({SIZE})) AS i FROM a{r} JOIN v USING (id)) GROUP BY k, i),
n{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN n{r} USING (k))"""
            )
    last = rounds
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{last} JOIN v USING (id) JOIN c{last} c ON c.k = best.k"""


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors of the right size, as doubles."""
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("x"))
    return rows.where(F.size("x") == SIZE)


def integers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of the batch take part, and their components."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, SIZE)
    kept = np.isfinite(x).all(axis=1)
    # Scaling by a power of two is exact; the limit keeps it from overflowing.
    return kept, np.floor(np.clip(x[kept], -LIMIT, LIMIT) * SCALE).clip(-LIMIT, LIMIT).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's centroid and squared distance, and how many differences were squared."""
    x, c = x[:, order], centroids[:, order]
    n, work = len(x), len(x) * len(c) * BLOCK
    part = np.zeros((n, len(c)), np.int64)
    for i in range(BLOCK):
        part += (x[:, i, None] - c[None, :, i]) ** 2
    lead = part.argmin(axis=1)
    bound = ((x - c[lead]) ** 2).sum(axis=1)
    rows, of = np.nonzero(part <= bound[:, None])
    sums = part[rows, of]
    for a in range(BLOCK, SIZE, BLOCK):
        sums = sums + ((x[rows, a : a + BLOCK] - c[of, a : a + BLOCK]) ** 2).sum(axis=1)
        work += len(rows) * BLOCK
        stay = sums <= bound[rows]
        rows, of, sums = rows[stay], of[stay], sums[stay]
    # By row, then distance, then number: the first of each row is its nearest, and every row has one, as its lead is never dropped.
    by = np.lexsort((of, sums, rows))
    rows, of, sums = rows[by], of[by], sums[by]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    return of[first], sums[first], work


def measured(batch: pa.RecordBatch, centroids: np.ndarray, order: np.ndarray):
    """Chunks (rows that take part, their components, clusters, distances) of a batch."""
    kept, x = integers(batch)
    where = np.flatnonzero(kept)
    for a in range(0, len(x), CHUNK):
        part = x[a : a + CHUNK]
        of, distance, _ = nearest(part, centroids, order)
        yield where[a : a + CHUNK], part, of, distance


def moments(rows: DataFrame) -> np.ndarray:
    """The dimensions by falling variance over all vectors; of equal ones the smaller first."""

    def run(batches):
        for batch in batches:
            x = integers(batch)[1].astype(float)
            if len(x):
                mean = x.mean(axis=0)
                yield pa.RecordBatch.from_pydict({"n": [len(x)], "mean": [mean.tolist()], "m2": [((x - mean) ** 2).sum(axis=0).tolist()]})

    parts = rows.select("x").mapInArrow(run, "n long, mean array<double>, m2 array<double>")
    each = parts.select("n", F.posexplode("mean").alias("i", "mean"), "m2").select("n", "i", "mean", F.get("m2", F.col("i")).alias("m2"))
    within = each.groupBy("i").agg((F.sum("m2") + F.sum(F.col("n") * F.col("mean") ** 2) - F.sum(F.col("n") * F.col("mean")) ** 2 / F.sum("n")).alias("v"))
    v = {r["i"]: r["v"] for r in within.collect()}  # SIZE rows
    return np.array(sorted(range(SIZE), key=lambda i: (-v.get(i, 0.0), i)))


def starts(rows: DataFrame, clusters: int) -> np.ndarray:
    """The vectors of the least hashes of their ids."""
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    got = rows.where(finite).orderBy(name.asc_nulls_last(), "x").limit(clusters).select("x").collect()
    x = np.array([r["x"] for r in got], float).reshape(-1, SIZE)
    return np.floor(np.clip(x, -LIMIT, LIMIT) * SCALE).clip(-LIMIT, LIMIT).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean."""

    def run(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), SIZE), np.int64)
        for batch in batches:
            for _, x, of, _ in measured(batch, centroids, order):
                n += np.bincount(of, minlength=len(centroids))
                for k in np.unique(of):
                    sums[k] += x[of == k].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"k": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = rows.select("x").mapInArrow(run, "k int, n long, sums array<long>")
    each = parts.select("k", "n", F.posexplode("sums").alias("i", "s"))
    total = each.groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in total.collect():  # CLUSTERS * SIZE rows
        out[r["k"], r["i"]] = int(r["s"]) // r["n"]
    return out


def inertia(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> dict[int, int]:
    """The distances summed over each cluster."""

    def run(batches):
        sums = dict.fromkeys(range(len(centroids)), 0)
        for batch in batches:
            for _, _, of, distance in measured(batch, centroids, order):
                for k in np.unique(of):
                    sums[int(k)] += sum(distance[of == k].tolist())
        yield pa.RecordBatch.from_pydict({"k": pa.array(list(sums), pa.int32()), "s": pa.array([str(s) for s in sums.values()], pa.string())})

    total = rows.select("x").mapInArrow(run, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return {r["k"]: int(r["s"]) for r in total.collect()}  # CLUSTERS rows


def clusters(embeddings: DataFrame, many: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """Each vector with its cluster, its distance and the sums of distances."""
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = usable(embeddings)
    centroids = starts(rows, many)
    if not len(centroids):
        return embeddings.sparkSession.createDataFrame([], schema)
    order = moments(rows)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order)
    sums = inertia(rows, centroids, order)
    whole = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    most = 2**63 - 1

    def run(batches):
        for batch in batches:
            for at, _, of, distance in measured(batch, centroids, order):
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": batch.column("vec_id").take(pa.array(at)),
                        "cluster": pa.array(of, pa.int32()),
                        "distance": pa.array(distance, pa.int64()),
                        "cluster_inertia": pa.array([min(sums[k], most) for k in of.tolist()], pa.int64()),
                        "inertia": pa.array([min(whole, most)] * len(of), pa.int64()),
                        "centroid_sha256": pa.array([names[k] for k in of.tolist()], pa.string()),
                    }
                )

    return rows.mapInArrow(run, schema)

