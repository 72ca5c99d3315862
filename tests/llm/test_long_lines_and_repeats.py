"""Texts of very many lines, common segments of many batches, and vec_ids with several vectors."""

import time

import numpy as np

from folio.llm import lines, neighbours, substrings
from tests.llm.helpers import SCHEMA, rows
from tests.llm.test_text_operators import documents, plain_substrings


def test_lines_are_walked_once(spark):
    repeated = "this line of ten words stands in both of them"
    def text(k):
        return "\n".join(repeated if i % 2 else f"line {i} of document {k} and nothing else" for i in range(300_000))

    df = spark.createDataFrame([(1, text(1), "en", "a", 0), (2, text(2), "en", "a", 0)], SCHEMA)
    lines.line_report(df.limit(0)).collect()
    began = time.perf_counter()
    got = rows(lines.line_report(df), "doc_id", "n_lines", "n_removed")
    assert got == [(1, 300_000, 149_999), (2, 300_000, 150_000)]
    assert time.perf_counter() - began < 60


def test_lines_left_at_every_edge(spark):
    a = "a run of lines with enough words in it"
    texts = [f"{a}\n\n{a}", f"x\n{a}\ny\n\n{a}\n", f"{a}\n{a}\n{a}", "\n\n", f"\n{a}"]
    got = rows(lines.line_dedup(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)), "doc_id", "text")
    assert got == [(0, f"{a}\n"), (1, "x\ny\n\n"), (2, ""), (3, "\n\n"), (4, "")]


def test_a_common_segment_of_many_batches_is_one_row_of_a_shard(spark, monkeypatch):
    shared = " ".join(f"shared{i}" for i in range(60))
    df = spark.createDataFrame([(i, f"own{i} before {shared} after{i}", "en", "a", 0) for i in range(400)], SCHEMA).repartition(40)
    search = substrings.search

    def bounded(shard):
        assert not shard.duplicated(["h", "c"]).any()
        return search(shard)

    monkeypatch.setattr(substrings, "search", bounded)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_report(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {doc_id: x for (doc_id, _), x in plain_substrings(documents(df)).items()}


def test_a_vec_id_with_several_vectors_stands_once(spark):
    dice = np.random.default_rng(2)
    pairs = [(i, dice.normal(size=8).tolist()) for i in range(60)] + [(3, dice.normal(size=8).tolist()) for _ in range(9)] + [(50, dice.normal(size=8).tolist()), (100, pairs_like := [1.0] * 8)]
    pairs += [(7, (np.array(pairs_like) + j / 1000).tolist()) for j in range(12)]
    got = neighbours.search(spark.createDataFrame(pairs, "vec_id long, embedding array<double>")).collect()
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q in (0, 50, 100):
        near: dict[int, float] = {}
        for i, v in pairs:
            if i != q:
                near[i] = max([near.get(i, -2.0), *(float(unit(v) @ unit(u)) for j, u in pairs if j == q)])
        want = sorted(near, key=lambda i: (-near[i], i))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[1] for r in mine] == want and [r[0] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r[2] for r in mine], [near[i] for i in want])
