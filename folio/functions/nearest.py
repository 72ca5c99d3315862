"""Edit distances by bit vectors, and the places of a text that a claim is near to.

A claim with up to k edits leaves one of k + 1 blocks of it unchanged. The blocks of many claims are met with all grams of the text
at once by the grams' hashes. Around the places so found, one pass backwards tells how near any window from each start can come,
and one pass forwards from a start measures its windows of all sizes: bits of a whole column of the distance table move in a few
operations on integers.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np

#: Characters by which blocks and texts are met.
GRAM = 8
SPREAD = 0x9E3779B97F4A7C15


def masks(claim: str) -> dict[str, int]:
    """For each character the bits of its places in the claim."""
    out: dict[str, int] = {}
    for i, c in enumerate(claim):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(claim: dict[str, int], size: int, text: str, anywhere: bool = False) -> list[int]:
    """The claim's edit distance to each prefix of the text from one character on; `anywhere`: to the best piece that ends there."""
    full, last, ends = (1 << size) - 1, 1 << (size - 1), int(not anywhere)
    plus, minus, d, out = full, 0, size, []
    for c in text:
        equal = claim.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        less = plus & across
        if up & last:
            d += 1
        elif less & last:
            d -= 1
        up = (up << 1 | ends) & full
        less = less << 1 & full
        plus = less | (full & ~(down | up))
        minus = up & down
        out.append(d)
    return out


def edits(size: int, threshold: float) -> int:
    """How many edits a claim of this size may have; at threshold 0 as many as it is long."""
    return size if threshold <= 0 else int((1.0 - threshold) * size / threshold)


def blocks(claim: str, k: int) -> list[tuple[int, str]]:
    """k + 1 blocks (offset, text) of the claim, or none if it is too short for them."""
    size = len(claim)
    if k + 1 > size:
        return []
    width = size // (k + 1)
    return [(i * width, claim[i * width : size if i == k else (i + 1) * width]) for i in range(k + 1)]


def occurrences(text: str, wanted: set[str]) -> dict[str, list[int]]:
    """The places of each wanted string in the text, overlapping ones too, in order."""
    out: dict[str, list[int]] = {w: [] for w in wanted}
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    by_gram: dict[int, list[str]] = {}
    for w in wanted:
        by_gram.setdefault(min(len(w), GRAM), []).append(w)
    for gram, words in by_gram.items():
        if len(text) < gram:
            continue
        hashed = np.zeros(len(text) - gram + 1, np.uint64)
        for i in range(gram):
            hashed = hashed * np.uint64(SPREAD) + codes[i : len(text) - gram + 1 + i]
        keyed: dict[int, list[str]] = {}
        for w in words:
            key = 0
            for c in w[:gram]:
                key = (key * SPREAD + ord(c)) & 0xFFFFFFFFFFFFFFFF
            keyed.setdefault(key, []).append(w)
        keys = np.array(sorted(keyed), np.uint64)
        met = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)] == hashed)
        for at, key in zip(met.tolist(), hashed[met].tolist(), strict=True):
            for w in keyed[key]:
                if text.startswith(w, at):
                    out[w].append(at)
    return out


def apart(places: list[int], size: int, most: int) -> list[int]:
    """The first `most` places, each behind the end of the one before."""
    out: list[int] = []
    for at in places:
        if not out or at >= out[-1] + size:
            out.append(at)
            if len(out) == most:
                break
    return out


def starts(found: list[tuple[int, list[int]]], k: int, budget: int) -> tuple[list[tuple[int, int]], bool]:
    """Ranges [a, b) in which windows may begin, from blocks' offsets and places; cut to `budget` starts, and whether that cut any."""
    low = np.sort(np.concatenate([np.array(at, np.int64) - offset - k for offset, at in found if at] or [np.zeros(0, np.int64)]))
    out: list[tuple[int, int]] = []
    left, end = budget, 0
    for a in low.tolist():
        a, b = max(a, end), a + 2 * k + 1
        if a >= b:
            continue
        if left == 0:
            return out, True
        b, cut = min(b, a + left), b - a > left
        left -= b - a
        end = b
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        if cut:
            return out, True
    return out, False


def windows(text: str, claim: str, ranges: list[tuple[int, int]], k: int, threshold: float, most: int) -> list[tuple[float, int, int]]:
    """The `most` best windows (score, start, end) that begin in the ranges: by falling score, start, size."""
    size, forwards, backwards = len(claim), masks(claim), masks(claim[::-1])
    least: dict[int, int] = {}
    for a, b in ranges:
        b = min(b, len(text))
        region = text[a : b + size + k][::-1]
        near = distances(backwards, size, region, anywhere=True)
        for s in range(a, b):
            if near[len(region) - 1 - (s - a)] <= k:
                least[s] = near[len(region) - 1 - (s - a)]
    best: list[tuple[float, int, int]] = []
    for s in sorted(least, key=lambda s: (least[s], s)):
        # What is left has least[s] edits at least, in windows of size + k at most.
        if len(best) == most and -best[-1][0] > 1 - least[s] / (size + k):
            break
        own = distances(forwards, size, text[s : s + size + k])
        for n in range(max(1, size - k), len(own) + 1):
            score = 1 - own[n - 1] / max(size, n)
            if score > 0 and score >= threshold:
                best.append((-score, s, n))
        best = heapq.nsmallest(most, best)
    return [(-score, s, s + n) for score, s, n in best]


def located(text: str, claims: list[str], threshold: float, budget: int, most: int) -> list[tuple[list[tuple[float, int, int]], bool]]:
    """For each claim its best places (score, start, end), exact ones alone if there are any, and whether the budget cut the search."""
    ks = [edits(len(c), threshold) for c in claims]
    parts = [blocks(c, k) for c, k in zip(claims, ks, strict=True)]
    met = occurrences(text, {b for own in parts for _, b in own})
    out = []
    for claim, k, own in zip(claims, ks, parts, strict=True):
        if not claim.strip():
            out.append(([], False))
            continue
        whole = [at for at in met[own[0][1]] if text.startswith(claim, at)] if own else occurrences(text, {claim})[claim]
        if whole:
            out.append(([(1.0, at, at + len(claim)) for at in apart(whole, len(claim), most)], False))
        elif own:
            ranges, cut = starts([(offset, met[b]) for offset, b in own], k, budget)
            out.append((windows(text, claim, ranges, k, threshold, most), cut))
        else:
            out.append((windows(text, claim, [(0, min(len(text), budget))], k, threshold, most), len(text) > budget))
    return out


class Places:
    """Places of a view in its source. Parts are (view start, view size, source start, source size) in order."""

    def __init__(self, parts: list[tuple[int, int, int, int]]):
        self.parts, self.stops = parts, [p[0] + p[1] for p in parts]

    def source(self, place: int, end: bool) -> int:
        after = bisect_right(self.stops, place)
        if after < len(self.parts) and self.parts[after][0] < place:
            part = self.parts[after]
            return part[2] + part[3] if end else part[2]
        behind = after - 1
        while not end and behind >= 0 and self.stops[behind] == place and self.parts[behind][1] == 0:
            behind -= 1
        return place if behind < 0 else place + self.parts[behind][2] + self.parts[behind][3] - self.stops[behind]
