"""The prefix trie, main texts of pages, and exact clusters, each against a plain version."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from folio.llm import centroids, maincontent, prefixes, queries
from tests.compare import agree
from tests.llm.helpers import rows

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_centroids"])
def test_agrees_with_its_sql(spark, name):
    agree(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def plain_trie(turns):
    """Every node by walking all prefixes of all rebuilt conversations."""
    own = {}
    for c, turn, role, text in sorted((r for r in turns if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    base = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    head = lambda c: zlib.crc32(str(c).encode()) % 6
    paths = {c: tuple(own.get(base(c), [])[: head(c)] + t[head(c) :]) for c, t in own.items()}
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(k) == len(q) + 1 and k[: len(q)] == q for k in nodes)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == p)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in under)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids(p), sum(kids(q) == 0 for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def odd_turns():
    dice = random.Random(11)
    out = [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 0, None, None), (7, 1, "user", "é漢😀"), (7, 1, "user", "é漢😀"), (-3, 0, "user", "hi"), (-103, 0, "user", "hi")]
    for c in [0, 1, 2, 3, 100, 101, 150, 205, 299, 300, 1000, 1001, 100_000_000_001]:
        out += [(c, t, dice.choice(["user", "assistant"]), dice.choice(["", "yes", "no", "a long answer"])) for t in range(dice.randint(1, 9))]
    # One conversation in copies over many families, and a long one.
    for c in range(5000, 5900, 7):
        out += [(c, t, "user", f"common {t}") for t in range(9)]
    return out + [(700, t, "tool", f"step {t % 3}") for t in range(400)]


def test_trie_of_odd_conversations(spark):
    turns = odd_turns()
    got = prefixes.trie(spark.createDataFrame(turns, TURNS))
    assert rows(got, *COLUMNS) == plain_trie(turns)


def test_trie_takes_clashing_columns_and_any_order(spark):
    turns = odd_turns()[:60]
    df = spark.createDataFrame(turns[::-1], TURNS).selectExpr("*", "1 AS base", "2 AS node", "3 AS n", "4 AS parent", "5 AS `a.b`").repartition(7)
    assert rows(prefixes.trie(df), *COLUMNS) == plain_trie(turns)


def test_parents_of_many_children_are_found(spark, monkeypatch):
    turns = odd_turns()
    monkeypatch.setattr(prefixes, "HOT", 5)
    monkeypatch.setattr(prefixes, "PACK", 2)
    assert rows(prefixes.trie(spark.createDataFrame(turns, TURNS)), *COLUMNS) == plain_trie(turns)


def test_trie_of_nothing(spark):
    assert prefixes.trie(spark.createDataFrame([], TURNS)).collect() == []


PROSE = "The committee met on Tuesday to discuss the plan for the new bridge. Members agreed that the cost was high."


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_least_and_content_largest(seed):
    dice = random.Random(seed)
    n = dice.randint(1, 9)
    gain = [dice.randint(-6, 6) for _ in range(n)]
    joined = [(i, j, dice.randint(1, 4)) for i, j in itertools.combinations(range(n), 2) if dice.random() < 0.5]

    def cost(side):
        wrong = sum(g for g, s in zip(gain, side, strict=True) if g > 0 and not s) + sum(-g for g, s in zip(gain, side, strict=True) if g < 0 and s)
        return wrong + sum(c for i, j, c in joined if side[i] != side[j])

    best = min(cost(s) for s in itertools.product((False, True), repeat=n))
    largest = [any(col) for col in zip(*(s for s in itertools.product((False, True), repeat=n) if cost(s) == best), strict=True)]
    got = maincontent.content_side(gain, joined)
    assert cost(got) == best
    assert got == largest


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("<script>if (a<b) x='</p>'</script>", ""),
        (f"<nav><a href=/>Home</a></nav><main><h1>A &lt;b&gt; &eacute;&nbsp;&#x41;</h1><p>{PROSE}<p>x<br>y\n\t z</main><footer>&copy; us</footer>", f"A <b> é A\n{PROSE}\nx y z"),
        (f"<article><header><h1>T</h1></header><p>{PROSE}</p><aside>Related</aside><form>mail</form><section class='comments'><article><p>{PROSE}</p></article></section></article>", f"T\n{PROSE}"),
        (f"<div id=topMenu><p>{PROSE}</p></div><div class='post-content'><p>{PROSE}</p><p>Short.</p></div><div class='cookie-notice'>{PROSE}</div><div class='sponsored'>{PROSE}</div>", f"{PROSE}\nShort."),
        (f"<body class='has-sidebar nav-open'><div class='with-sidebar'><article><p>{PROSE}</p></article><div class='sidebar'><p>{PROSE}</p></div></div>", PROSE),
        (f"<div><a href=/>Home</a><a href=/x>News</a></div><div><h1>Bridge</h1><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div><div>Copyright © 2020 | Foo</div>", f"Bridge\n{PROSE}\nYes.\n{PROSE}"),
        (f"<article><p>{PROSE}</p><p hidden>no</p><pre>a\n  b</pre><table><tr><td>c<td>d</table><ul><li>e<li>f</ul><blockquote>g</blockquote>", f"{PROSE}\na b\nc\nd\ne\nf\ng"),
        (f"<article><p title='a > b'>{PROSE}</p><p>1 < 2 &amp;amp; <3</p><!-- no --><p>cut &am", f"{PROSE}\n1 < 2 &amp; <3\ncut &am"),
    ],
)
def test_main_text_of_pages(page, text):
    assert maincontent.main_text(page, maincontent.PRIOR) == text


def test_unclear_blocks_follow_their_neighbours():
    gain = [10, -1, 10, -10, 1, -10]
    chain = [(i, i + 1, 2) for i in range(5)]
    assert maincontent.content_side(gain, chain) == [True, True, True, False, False, False]


@pytest.mark.parametrize("page", ['<a href="' * 100_000, "<a b='" * 50_000 + "<" * 100_000, "<div>" * 100_000 + "x", "<!--" * 50_000, "<!" * 100_000, "<li>x" * 50_000 + "</ul>" * 50_000])
def test_broken_pages_are_read_once(page):
    assert len(maincontent.blocks(page)) <= 50_001


def test_pages_of_every_kind(spark):
    page = f"<body><nav><a>m</a></nav><article><p>{PROSE}</p></article><footer>f</footer></body>"
    rows_ = [(1, "u", page), (1, "u", page), (None, None, None), (2, None, ""), (3, "v", f"<article><p>{PROSE}</p>" + f"<p>{PROSE}</p>" * 20_000)]
    df = spark.createDataFrame(rows_, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS label", "3 AS `a.b`")
    got = rows(maincontent.extract(df), "page_id", "url", "text", "n_chars")
    long = "\n".join([PROSE] * 20_001)
    assert got == sorted([(1, "u", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, None, "", 0), (3, "v", long, len(long))], key=repr)
    assert maincontent.extract(df.limit(0)).collect() == []


def test_whole_pages_of_the_table(spark):
    import html
    import re

    got = {r["page_id"]: r["text"] for r in queries.op12_html(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        lines = (" ".join(html.unescape(re.sub("<[^>]*>", "", part.replace("<br>", " "))).split()) for part in re.split("</?(?:p|h1)>", inner))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def plain_clusters(pairs):
    x = [[int(np.floor(256 * float(e))) for e in v] for _, v in pairs]
    by = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"2:{pairs[i][0]}".encode()).hexdigest() if pairs[i][0] is not None else "~", pairs[i][1]))
    c = [x[i] for i in by[:40]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c)) for v in x]
    for _ in range(5):
        of = [k for _, k in assign()]
        c = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [v for v, o in zip(x, of, strict=True) if o == k]) else m for k, m in enumerate(c)]
    last = assign()
    inertia = [sum(d for d, o in last if o == k) for k in range(len(c))]
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, k, d, inertia[k], sum(inertia), names[k]) for (i, _), (d, k) in zip(pairs, last, strict=True)), key=repr)


CLUSTER_COLUMNS = "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"


def test_clusters_of_odd_vectors(spark):
    dice = np.random.default_rng(13)
    good = [(i, dice.normal(size=64).round(2).tolist()) for i in range(150)]
    good += [(200, [0.0] * 64), (201, [0.0] * 64), (201, [0.0] * 64), (202, [-1.0] * 64), (None, [0.5] * 64), (5, [0.25] * 64)] + [(300 + i, good[3][1]) for i in range(80)]
    bad = [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [float("nan")] + [1.0] * 63), (1006, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS cluster", "3 AS `a.b`").repartition(5)
    assert rows(centroids.clusters(df), *CLUSTER_COLUMNS) == plain_clusters(good)


def test_few_huge_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    schema = "vec_id long, embedding array<double>"
    assert rows(centroids.clusters(spark.createDataFrame(few, schema)), *CLUSTER_COLUMNS) == plain_clusters(few)
    assert centroids.clusters(spark.createDataFrame([], schema)).collect() == []
    huge = centroids.clusters(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], schema)).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in huge) == [(1, 0), (2, 0)]


def test_partial_distances_end_as_whole_ones():
    dice = np.random.default_rng(5)
    x = dice.integers(-300, 300, size=(500, 64)) * (np.arange(64) % 9 == 0)
    c = x[:40] + dice.integers(-3, 3, size=(40, 64))
    whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    of, distance, work = centroids.nearest(x, c, np.argsort(-x.var(axis=0), kind="stable"))
    assert (of == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    assert work < whole.size * 64 / 2
