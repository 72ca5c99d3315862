import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import grounding as G


@pytest.mark.parametrize(
    ("source", "view"),
    [
        ("aﬄuent", "affluent"),
        ("moon­light", "moonlight"),
        ("har-\nbour", "harbour"),
        ("KX-\n77", "KX-77"),
        ("mast   and\tsail", "mast and sail"),
        ("été", "été"),
        ("north-\n  East", "north-East"),
        ("-\nstart", "-\nstart".replace("\n", " ")),
        ("", ""),
    ],
)
def test_folding(source, view):
    got, parts = G.folded(source)
    assert got == unicodedata.normalize("NFC", view)
    at = 0
    for start, size, place, length in parts:
        assert start >= at and place + length <= len(source)
        at = start + size


def test_find_starts_is_left_to_right_without_overlap(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab.\\E|") for _ in range(40)), "".join(rng.choice("ab.\\E|") for _ in range(rng.randint(1, 3)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, n string").select("t", "n", T.find_starts(F.col("t"), F.col("n")).alias("at"))
    for t, n, at in df.collect():
        want, i = [], t.find(n)
        while i >= 0:
            want.append(i)
            i = t.find(n, i + len(n))
        assert at == want


def test_source_places(spark):
    source = "x ﬁ  y­z"
    df = spark.createDataFrame([(1, source)], "document_id int, text string").select(G.fold("text").alias("v"))
    place = lambda p, end: G.source_place(F.col("v.parts"), F.lit(p), end)
    view, a, b, c, d = df.select("v.view", place(2, False), place(4, True), place(5, False), place(7, True)).first()
    assert view == "x fi yz"
    assert source[a:b] == "ﬁ"
    assert source[c:d] == "y­z"


def test_ground_prefers_exact_then_the_best_near_place(spark):
    docs = spark.createDataFrame([(1, "total amount due: 1234.50 EUR, paid in full by transfer")], "document_id int, text string")
    claims = spark.createDataFrame([(1, "a", "1234.50"), (1, "b", "total amaunt due"), (1, "c", "nothing like it here"), (1, "d", " "), (1, "e", None)], "document_id int, field_path string, claim string")
    got = {r.field_path: r for r in G.ground(docs, claims).collect()}
    assert (got["a"].status, got["a"].span_start, got["a"].score) == ("exact", 18, 1.0)
    assert (got["b"].status, got["b"].span_start, got["b"].span_end) == ("fuzzy", 0, 16)
    assert {got[x].status for x in "cde"} == {"ungrounded"}


def test_threshold_is_inclusive(spark):
    docs = spark.createDataFrame([(1, "a wellknown fact")], "document_id int, text string")
    claims = spark.createDataFrame([(1, "a", "well-known")], "document_id int, field_path string, claim string")
    row = G.ground(docs, claims).first()
    assert (row.status, round(row.score, 9)) == ("fuzzy", 0.9)


def test_entries_take_places_of_their_own(spark):
    rows = [(1, "s", e, at, at + 3, 1.0) for e in (0, 1, 2) for at in (5, 9)]
    df = spark.createDataFrame(rows, "document_id int, slot string, entry int, span_start int, span_end int, score double")
    got = sorted((r.entry, r.span_start) for r in G.exclusive(df).collect())
    assert got[:2] == [(0, 5), (1, 9)] and got[2] == (2, None)
