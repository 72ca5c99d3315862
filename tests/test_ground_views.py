"""Grounding beyond ASCII and in folded views, against a plain version."""

import random
import unicodedata

import pytest

from folio.operators import grounding as G
from folio.plans import grounding as P

SF = "/root/testdata/sf0.001"
TEXT = "Der Betrag – 1.234,50 €, zahlbar bis zum Ende des\n  Monats “März” – naïve soft\u00adware, o\ufb03ce am-\nount; 合計金額は千二百円です。終わり"
CLAIMS = [
    "zum Ende des Monats “März”", "software, office amount", "zahlbar  bis\nzum Ende", "Betrag – 1.234,50 €, zahlbar bis", "合計金額は千二百円です。", "合計金額は千三百円です。",
    "Monats “Marz” – naïve software", "gänzlich andere Wörter hier", "office", "", None,
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text, claim):
    """Status, score and the view's words of the best place, looking at every window."""
    view, claim = G.folded(text)[0], G.folded(claim or "")[0]
    if not claim.strip():
        return "ungrounded", None, None
    if claim in view:
        return "exact", 1.0, claim
    found = []
    for a in range(len(view)):
        for b in range(a + max(1, len(claim) * 8 // 10), min(len(view), a + len(claim) * 12 // 10 + 1) + 1):
            score = 1 - distance(claim, view[a:b]) / max(len(claim), b - a)
            if score >= G.THRESHOLD:
                found.append((-score, a, b - a))
    if not found:
        return "ungrounded", None, None
    score, a, n = min(found)
    return "fuzzy", round(-score, 9), view[a : a + n]


def test_ground_folds_and_counts_characters(spark):
    docs = spark.createDataFrame([(1, TEXT)], "document_id int, text string")
    claims = spark.createDataFrame([(1, str(i), c) for i, c in enumerate(CLAIMS)], "document_id int, field_path string, claim string")
    got = {int(r.field_path): r for r in G.ground(docs, claims).collect()}
    assert len(got) == len(CLAIMS)
    for i, claim in enumerate(CLAIMS):
        status, score, words = plain(TEXT, claim)
        r = got[i]
        assert (r.status, r.score and round(r.score, 9)) == (status, score), claim
        assert (None if words is None else G.folded(TEXT[r.span_start : r.span_end])[0]) == words, claim
    assert {r.status for r in got.values()} == {"exact", "fuzzy", "ungrounded"}


@pytest.mark.parametrize("claim", ["aaaaaaaaaaaaaaaaaaab", "aaaaaaaaaaaaaaaaaabbbbbbb"])
def test_a_cut_search_is_told(spark, claim):
    docs = spark.createDataFrame([(1, "a" * 80 + " z" * 20), (2, "a" * 9)], "document_id int, text string")
    claims = spark.createDataFrame([(1, "x", claim), (2, "y", claim)], "document_id int, field_path string, claim string")
    out = G.ground(docs, claims, budget=10)
    assert {r.field_path: r.truncated for r in out.collect()} == {"x": True, "y": False}
    assert G.counts(out).first().truncated == 1


def test_passages_take_all_documents(spark):
    rows = P.ground_passages(spark, SF)
    assert rows.count() == P.hits(spark, SF).select("document_id", "needle_id").distinct().count()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    passages = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in rows.collect():
        needle = int(r.field_path.removeprefix("field"))
        if needle % 3 == 2:
            assert r.status == "ungrounded"
        else:
            assert r.status == ("exact", "fuzzy")[needle % 3]
            assert r.score == (1.0 if r.status == "exact" else 1 - 1 / len(passages[needle]))
            assert G.folded(texts[r.document_id][r.span_start : r.span_end])[0] == G.folded(passages[needle])[0]


def test_outcomes_have_alternatives_pages_and_boxes(spark):
    text = "alpha beta gamma " * 200
    docs = spark.createDataFrame([(2, text), (3, text), (4, "")], "document_id long, text string")
    claims = spark.createDataFrame([(d, f, c) for d in (2, 3, 4, 9) for f, c in (("a", "beta gamma alpha"), ("b", "zzz qqq"))], "document_id long, field_path string, claim string")
    got = {(r.document_id, r.field_path): r for r in P.placed_outcomes(docs, G.ground(docs, claims)).collect()}
    assert len(got) == 8
    hit = got[2, "a"]
    assert (hit.span_start, [a.span_start for a in hit.alternatives], hit.pages) == (6, [23, 40, 57, 74, 91], [0])
    assert [(g.page_index, g.box.x0) for g in hit.geometry] == [(0, 36), (0, 66), (0, 102)]
    assert got[3, "a"].geometry is None and got[3, "a"].pages == [0]
    assert {got[d, "a"].status for d in (4, 9)} | {got[d, "b"].status for d in (2, 3, 4, 9)} == {"ungrounded"}
    assert got[9, "a"].alternatives == [] and got[9, "a"].geometry is None and got[9, "a"].pages is None


def test_repeated_and_many_claims_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(G, "PACK", 7)
    docs = spark.createDataFrame([(1, " ".join(f"word{i:04d}" for i in range(500)))], "document_id int, text string")
    rows = [(1, f"f{i}", f"word{i:04d}") for i in range(300)] + [(1, "f1", "word0001")] * 3 + [(None, "n", "word0001"), (1, None, "word0002")]
    got = G.ground(docs, spark.createDataFrame(rows, "document_id int, field_path string, claim string")).collect()
    assert len(got) == 305
    assert {r.span_start for r in got if r.field_path == "f1"} == {9} and sum(r.field_path == "f1" for r in got) == 4
    assert [r.status for r in got if r.document_id is None] == ["ungrounded"]


def slow_view(source):
    """The view, character by character."""
    out, parts, size, i = [], [], 0, 0
    while i < len(source):
        c, after, text = source[i], i + 1, None
        if c == "\xad":
            text = ""
        if text is None and c == "-" and i:
            while after < len(source) and source[after].isspace():
                after += 1
            if "\n" in source[i + 1 : after] and after < len(source):
                text = "" if source[i - 1].islower() and source[after].islower() else "-"
            else:
                after = i + 1
        if text is None and c.isspace():
            while after < len(source) and source[after].isspace():
                after += 1
            text = " "
        if text is None:
            while after < len(source) and unicodedata.combining(source[after]):
                after += 1
            text = unicodedata.normalize("NFKC", source[i:after])
        if text != source[i:after]:
            parts.append((size, len(text), i, after - i))
        out.append(text)
        size += len(text)
        i = after
    return "".join(out), parts


def test_views_are_those_of_single_steps():
    dice = random.Random(4)
    for _ in range(4000):
        source = "".join(dice.choice("aB-- \n\t\xad\u0301\u0327é\ufb03漢\u1100\u1161\u00a0½e😀") for _ in range(dice.randint(0, 14)))
        assert G.folded(source) == slow_view(source), repr(source)
