import hashlib
from collections import Counter

from pyspark.sql import functions as F

from folio.operators import identity as I

STORE = "artifact_id string, stage string, input_artifact_id string"


def test_lineage_follows_long_chains_and_ends_cycles(spark):
    chain = [(str(i), "s", str(i - 1) if i else None) for i in range(21)]
    cycle = [("a", "s", "b"), ("b", "s", "c"), ("c", "s", "b"), ("own", "s", "own")]
    store = spark.createDataFrame(chain + cycle, STORE)
    got = sorted(tuple(r) for r in I.lineage(store, store).select("root_id", "step", "artifact_id").collect())
    want = [(str(i), n, str(i - n)) for i in range(21) for n in range(i + 1)]
    want += [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("b", 0, "b"), ("b", 1, "c"), ("c", 0, "c"), ("c", 1, "b"), ("own", 0, "own")]
    assert got == sorted(want)


def test_set_ids_without_gathering(spark):
    rows = [(i % 3 if i % 3 else None, "a,b"[i % 2 :: 2], f"m{i * 7919 % 5000}" if i % 11 else None) for i in range(5000)] + [(7, "x", None)]
    df = spark.createDataFrame(rows, "k int, g string, m string")
    out = I.set_id(df, ["k", "g"], "m")
    want = {}
    for k, g, m in rows:
        want.setdefault((k, g), []).append(m)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def tree(ms):
        """The digests of one level after the other."""
        nodes = sorted((sha(m), m, f"{m}:{n}") for m, n in Counter(m for m in ms if m is not None).items())
        for digits in I.RANGES:
            ranges = {}
            for r, at, item in nodes:
                ranges.setdefault(r[:digits], []).append((at, item))
            nodes = sorted((r, r, sha(",".join(item for _, item in sorted(x)))) for r, x in ranges.items())
        return f"sha256:{nodes[0][2]}" if nodes else None

    assert {(r.k, r.g): (r.set_id, r.members) for r in out.collect()} == {s: (tree(ms), len(ms)) for s, ms in want.items()}
    again = I.set_id(df.repartition(7).orderBy(F.desc("m")), ["k", "g"], "m")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert I.set_id(df.limit(0), ["k", "g"], "m").collect() == []
