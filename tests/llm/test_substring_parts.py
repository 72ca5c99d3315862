"""Texts of the substring operator taken in parts, and its anchors made once."""

import random

import numpy as np
import pyarrow as pa

from folio.llm import substrings
from tests.llm.helpers import SCHEMA
from tests.llm.test_text_operators import documents, plain_substrings


def report(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_report(df).collect()}


def same_as_plain(df):
    return report(df) == {doc_id: x for (doc_id, _), x in plain_substrings(documents(df)).items()}


def test_every_text_is_hashed_once(spark):
    """The counts and the join of anchors read one exchange; they were two, each with its own pass over the texts."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "_k long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = substrings.repeated_anchors(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("MapIn") == 1 and "ReusedExchange" in plan


def test_windows_repeated_within_one_document_only(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{i}{rng.choice('ab'[: 1 + i % 2])}" for _ in range(rng.randint(18, 90))) for i in range(150)]
    # Of every period; just before and just after the first window that comes again.
    texts += [" ".join(f"p{p}.{j % p}" for j in range(n)) for p in range(1, 40) for n in (p + 19, p + 20, p + 27)]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert same_as_plain(df)


def test_texts_longer_than_a_part_and_odd_separators(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(150_000)]
    passage = "été\x1cand  no\x85break \U0001f600 " + " ".join(f"s{i}" for i in range(30))
    long = " ".join(words)
    assert len(long) > substrings.PART
    texts = [long, None, "", " \t\n", "x " + " ".join(words[70_000:70_050]) + " y", "\v\f".join(passage.split(" ")), f"\n{passage}\r\n", passage, "z" * 200_000 + " " + passage]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    got = report(df)
    # Python's str.split() cuts at more than the contract's separators, the plain version doesn't.
    assert got == {doc_id: x for (doc_id, _), x in plain_substrings(documents(df)).items()}
    assert [got[i][1] for i in (0, 1, 4, 5, 6, 7, 8)] == [0, 0, 50, 0, got[5][0], got[5][0], got[5][0]]


def test_hashes_do_not_depend_on_the_place():
    run = [f"r{i}" for i in range(40)]
    texts = [" ".join(run), "  ".join(run) + "\n", "q" * (substrings.BLOCK - 9) + " " + " ".join(run), "", None, "\t".join(["ab"] * 50_000 + run)]
    words = substrings.Words(pa.array(texts))
    assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in texts]
    words.ready()
    begin = np.array([words.first[1] - 40, words.first[2] - 40, words.first[3] - 40, words.first[6] - 40])
    for low, high in ((0, 40), (0, 5), (7, 12), (35, 40)):
        assert len(set(words.hashes(begin + low, begin + high).tolist())) == 1
        assert set(words.sequences(begin + low, begin + high)) == {" ".join(run[low:high]).encode()}
    codes, n = words.codes()
    assert n == 42 and all((codes[b : b + 40] == codes[begin[0] : begin[0] + 40]).all() for b in begin)
