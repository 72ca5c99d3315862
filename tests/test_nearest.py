"""Places near to claims, against every window of every start."""

import random
import time

import pytest

from folio.functions import nearest as N
from folio.operators import documents as D


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(text, claim, threshold, budget, most):
    """The claim's places by looking at each window of each start that a block allows."""
    if not claim.strip():
        return [], False
    out, at = [], text.find(claim)
    while at >= 0:
        out.append((1.0, at, at + len(claim)))
        at = text.find(claim, at + len(claim))
    if out:
        return out[:most], False
    size = len(claim)
    k = size if threshold <= 0 else int((1.0 - threshold) * size / threshold)
    begin = set()
    if k + 1 > size:
        begin = set(range(len(text)))
    for i in range(k + 1 if k + 1 <= size else 0):
        width = size // (k + 1)
        block = claim[i * width : size if i == k else (i + 1) * width]
        at = text.find(block)
        while at >= 0:
            begin |= {s for s in range(at - i * width - k, at - i * width + k + 1) if s >= 0}
            at = text.find(block, at + 1)
    begin = sorted(begin)
    found = []
    for s in begin[:budget]:
        for n in range(max(1, size - k), size + k + 1):
            if s + n <= len(text):
                score = 1 - distance(claim, text[s : s + n]) / max(size, n)
                if score >= threshold and score > 0:
                    found.append((-score, s, n))
    return [(-score, s, s + n) for score, s, n in sorted(found)[:most]], len(begin) > budget


@pytest.mark.parametrize("seed", range(40))
def test_places_are_those_of_all_windows(seed):
    dice = random.Random(seed)
    letters = dice.choice(["ab", "abc ", "aé漢😀 xyz"])
    text = "".join(dice.choice(letters) for _ in range(dice.randint(0, 70)))
    claims = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 24))) for _ in range(6)]
    for _ in range(6):
        a = dice.randrange(len(text) + 1)
        piece = list(text[a : a + dice.randint(1, 30)]) or ["a"]
        for _ in range(dice.randint(0, 3)):
            spot = dice.randint(0, len(piece))
            piece[spot : spot + dice.randint(0, 1)] = dice.choice(letters)
        claims.append("".join(piece))
    threshold, budget = dice.choice([0.0, 0.4, 0.6, 0.75, 0.9]), dice.choice([3, 20, 1500])
    got = N.located(text, claims, threshold, budget, 6)
    for claim, (places, cut) in zip(claims, got, strict=True):
        want = plain(text, claim, threshold, budget, 6)
        assert (places, cut) == want, (text, claim, threshold, budget)


def test_distances_of_long_claims():
    dice = random.Random(1)
    a, b = ("".join(dice.choice("abcd") for _ in range(n)) for n in (300, 200))
    assert N.distances(N.masks(a), len(a), b)[-1] == distance(a, b)
    assert N.distances(N.masks("abc"), 3, "xxabdxx", anywhere=True) == [3, 3, 2, 1, 1, 2, 3]


def test_a_claim_whose_blocks_stand_everywhere_is_soon_found():
    text = "the sum of all the parts is " * 2000
    began = time.perf_counter()
    (places, cut), *_ = N.located(text, ["the sun of all thy parts is ", "the sum of all the parts was much more than this "] * 10, 0.9, 1500, 6)
    assert places and cut
    assert (time.perf_counter() - began) / 20 < 0.1


def test_needles_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 40)
    docs = spark.createDataFrame([(1, "aaaa 漢字漢字漢字 été"), (2, None), (3, ""), (4, "x" * 50 + "aa")], "document_id long, text string")
    needles = [(1, "aa"), (2, "漢字漢字"), (3, ""), (4, None), (5, "é"), (6, "aa"), (7, "not there at all"), *((100 + i, f"x{'x' * (i % 5)}a{i}") for i in range(30))]
    got = D.find(docs, spark.createDataFrame(needles, "needle_id long, needle string"))
    want = {(1, 1, 0, 2), (1, 1, 2, 4), (1, 6, 0, 2), (1, 6, 2, 4), (4, 1, 50, 52), (4, 6, 50, 52), (1, 2, 5, 9), (1, 5, 12, 13), (1, 5, 14, 15)}
    assert {tuple(r) for r in got.collect()} == want
    assert D.find(docs, spark.createDataFrame([], "needle_id long, needle string")).collect() == []
