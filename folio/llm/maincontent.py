"""Main text of web pages by a minimum cut over their blocks of text.

A page is read once, tag by tag, into blocks: the text between two boundaries of block elements. Each block has a cost for each of
the two labels, content and boilerplate: what its containers declare (an article, a menu, a sidebar, readers' comments) and the
log-odds of a logistic classifier of its text. The classifier is learned here, from blocks whose containers are plain about what
they hold. Costs are the capacities between a block and the two terminals; neighbours in page order, and neighbours among the
blocks of one parent and of one grandparent, are joined by edges of smoothness. The maximum flow's minimum cut gives the labels:
clear blocks decide themselves, unclear ones follow their neighbours.

Pages are independent, so there is no shuffle; a task holds one batch of pages. The classifier sees SAMPLE pages of least hash
and LABELLED blocks of each at most; all blocks of all pages are labelled by it.

Cases: missing or empty html gives an empty text, as does a page without content; page_id and url are passed on as they are, missing or
repeated; broken markup is read as far as it goes (an unclosed tag is text, an unclosed script runs to the end, a missing end tag
closes with its parent); a line break inside a paragraph is white space; ties of costs are content; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import least_hashed

#: Pages and blocks of a page that the classifier learns from, at most.
SAMPLE = 2_000
LABELLED = 64
SEED = 12
#: Costs are whole quarters: a text's log-odds count 3 at most, a container's word 4 to 8.
UNIT = 4
TEXT = 3 * UNIT
ADJACENT, SAME_PARENT, SAME_GRANDPARENT = 2, 3, 1

# Names of elements by what HTML means by them.
RAW = {"script", "style", "title", "noscript", "template", "iframe", "textarea", "svg", "math", "object", "select", "datalist", "audio", "video", "canvas", "noframes", "xmp"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "br"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: An element that its own kind, or another block, ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# What containers are for, by element, role, and words of class and id.
CONTENT, KEEPS, PLAIN, OFF, GONE = 4 * UNIT, 2 * UNIT, 0, -8 * UNIT, -9 * UNIT
ELEMENTS = {"article": CONTENT, "main": CONTENT, "nav": OFF, "header": OFF, "footer": OFF, "aside": OFF, "form": OFF, "dialog": OFF, "menu": OFF, "search": OFF, "button": OFF, "fieldset": OFF, "head": GONE}
ROLES = {
    "main": CONTENT, "article": CONTENT, "navigation": OFF, "banner": OFF, "contentinfo": OFF, "complementary": OFF, "search": OFF, "dialog": OFF, "alertdialog": OFF, "alert": OFF, "menu": OFF, "menubar": OFF,
    "form": OFF, "toolbar": OFF, "tablist": OFF,
}
COMMENTS = re.compile(r"comments?|commentlist|respond|replies|reply|disqus|discussion|guestbook")
BOILERPLATE = re.compile(
    r"ads?|adv|advert\w*|adsense|adbox|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|crumbs|pagination|pager|header|masthead|topbar|footer|foot|bottombar|sidebar|side|aside|widgets?|rail|"
    r"cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|signin|search\w*|form|share|sharing|social|related|recommended|recommendations|trending|"
    r"popular|copyright|legal|disclaimer|toolbar|skip|toc|tags|outbrain|taboola|paywall"
)
MAIN = re.compile(r"article|articlebody|content|post|entry|story|text|prose|main|body")
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

NO_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>?", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAMED = re.compile(r"</?[a-zA-Z]")
#: Where quotes are not balanced to the end of the page: a tag without any sign of another inside.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?。！？…](?:\s|$)")


@dataclass
class Block:
    text: str
    kind: str
    hint: int
    parent: int
    grandparent: int
    links: int = 0


@dataclass
class Open:
    """An open block element: its number, its parent's, and what it says of the texts in it."""

    name: str
    number: int
    parent: int
    hint: int


@dataclass
class Reader:
    """Reads one page; `blocks` are its texts in page order."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Open] = field(default_factory=lambda: [Open("", 0, 0, PLAIN)])
    names: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0
    count: int = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.name, top.hint, top.number, top.parent, self.linked))
            self.parts.clear()
        self.linked = 0

    def say(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.in_link:
                self.linked += len(text)

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        if name in CLOSES:
            # Only up to the list or table that the element belongs to.
            while self.stack[-1].name in CLOSES[name] or self.stack[-1].name == "p":
                self.pop()
        elif self.stack[-1].name == "p":
            self.pop()
        if name in VOID:
            return
        top = self.stack[-1]
        self.count += 1
        self.stack.append(Open(name, self.count, top.number, said(name, attributes, top.hint, bool(self.names.get("article") or self.names.get("main")))))
        self.names[name] = self.names.get(name, 0) + 1

    def pop(self) -> None:
        self.names[self.stack.pop().name] -= 1

    def close(self, name: str) -> None:
        self.flush()
        if self.names.get(name):
            while self.stack[-1].name != name:
                self.pop()
            self.pop()


def said(name: str, attributes: str, outer: int, in_article: bool) -> int:
    """What an element says of its texts, inside one that said `outer`."""
    if outer == GONE:
        return GONE
    hint = ELEMENTS.get(name, PLAIN)
    if name == "header" and in_article:
        hint = PLAIN
    if attributes and name not in ("html", "body"):
        if HIDDEN.search(attributes):
            return GONE
        words = set()
        for key, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            if key.lower() == "role":
                hint = ROLES.get(value.strip().lower(), hint)
            else:
                words |= {w.lower() for w in PART.findall(value)}
        if any(COMMENTS.fullmatch(w) for w in words):
            return GONE
        if hint != CONTENT or name not in ("article", "main"):
            if any(BOILERPLATE.fullmatch(w) for w in words):
                hint = OFF
            elif hint == PLAIN and any(MAIN.fullmatch(w) for w in words):
                hint = KEEPS
    if hint == PLAIN or (hint == KEEPS and outer in (OFF, CONTENT)):
        return outer
    return hint


def blocks(page: str) -> list[Block]:
    """The blocks of text of one page."""
    reader, at, end, pattern = Reader(), 0, len(page), TAG
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            reader.say(page[at:])
            break
        reader.say(page[at:lt])
        no_tag = NO_TAG.match(page, lt)
        if no_tag:
            at = no_tag.end()
            continue
        tag = pattern.match(page, lt)
        if tag is None and pattern is TAG and NAMED.match(page, lt):
            # Read to the end without finding the tag's: from here on the looser pattern, so that no page is read twice.
            pattern = LOOSE
            tag = pattern.match(page, lt)
        if tag is None:
            reader.say("<")
            at = lt + 1
            continue
        at = tag.end()
        name, closing = tag.group(2).lower(), bool(tag.group(1))
        if name in RAW:
            if not closing and not tag.group(3).endswith("/"):
                last = re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(page, at)
                at = last.end() if last else end
            if name == "title":
                reader.flush()
        elif name in BLOCK:
            if closing:
                reader.close(name)
            else:
                reader.open(name, tag.group(3))
        elif name == "br":
            reader.say(" ")
        elif name == "a":
            reader.in_link = 0 if closing else 1
    reader.flush()
    return reader.blocks


def features(block: Block) -> list[float]:
    """What the classifier sees of a block: its text and links, nothing of its containers."""
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    return [
        1.0,
        min(np.log1p(words), 6.0),
        min(1.0, block.links / size),
        min(1.0, len(SENTENCE.findall(text)) * 8 / words),
        float(block.kind in HEADINGS),
        float(block.kind == "li"),
        float("©" in text or "@" in text or "|" in text or "»" in text),
    ]


FEATURES = 7
#: Before anything is learned: long texts with sentences are content, links are not.
PRIOR = np.array([-2.2, 1.3, -5.0, 0.5, 1.5, -0.5, -2.0])


def fit(labels: np.ndarray, x: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic classifier, pulled towards PRIOR, both labels weighing the same; Newton's steps."""
    if not (labels == 1).any() or not (labels == 0).any():
        return PRIOR
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean()) / len(labels)
    w, pull = PRIOR.copy(), 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + pull * (w - PRIOR)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def labelled(pages: pd.Series) -> pd.DataFrame:
    """(label, x) of blocks whose containers say what they hold: 1 in an article, 0 in menus, footers and the like."""
    out = []
    for page in pages:
        plain = [b for b in blocks(page or "") if b.hint in (CONTENT, OFF, GONE)]
        for b in plain[:: max(1, -(-len(plain) // LABELLED))]:
            out.append((int(b.hint == CONTENT), features(b)))
    return pd.DataFrame(out, columns=["label", "x"])


def learned(pages: DataFrame) -> np.ndarray:
    """The classifier's weights from the sample of pages."""
    sample = least_hashed(pages.select("html").where("html IS NOT NULL"), SAMPLE, SEED, "html").distinct()
    rows = sample.mapInPandas(lambda batches: (labelled(b["html"]) for b in batches), "label int, x array<double>")
    got = rows.orderBy("label", "x").toPandas()  # SAMPLE * LABELLED rows of FEATURES numbers
    if got.empty:
        return PRIOR
    return fit(got["label"].to_numpy(float), np.array(got["x"].tolist(), float))


def gains(page: list[Block], weights: np.ndarray) -> list[int]:
    """What each block gains as content: the cost of the label boilerplate less that of content."""
    if not page:
        return []
    odds = np.array([features(b) for b in page]) @ weights
    text = np.clip(np.rint(odds * UNIT), -TEXT, TEXT).astype(int).tolist()
    return [t + b.hint for t, b in zip(text, page, strict=True)]


def edges(page: list[Block]) -> list[tuple[int, int, int]]:
    """Edges of smoothness (block, block, capacity): in page order, and chains through each parent and grandparent."""
    out = [(i, i + 1, ADJACENT) for i in range(len(page) - 1)]
    for near, capacity in (("parent", SAME_PARENT), ("grandparent", SAME_GRANDPARENT)):
        last: dict[int, int] = {}
        for i, b in enumerate(page):
            key = getattr(b, near)
            if key in last:
                out.append((last[key], i, capacity))
            last[key] = i
    return out


def content_side(gain: list[int], joined: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each block is on the content side of the minimum cut; where several cuts are least, the largest such side.

    Maximum flow by blocking flows along shortest paths. A positive gain is the capacity from the source, a negative one that to
    the sink; both terminals stay implicit.
    """
    supply, demand = [max(0, g) for g in gain], [max(0, -g) for g in gain]
    to, cap, arcs = [], [], [[] for _ in gain]
    for i, j, c in joined:
        arcs[i].append(len(to))
        arcs[j].append(len(to) + 1)
        to += (j, i)
        cap += (c, c)
    while True:
        level = [0 if s else -1 for s in supply]
        queue = [i for i, s in enumerate(supply) if s]
        met = False
        for i in queue:
            met = met or demand[i] > 0
            for a in arcs[i]:
                if cap[a] and level[to[a]] < 0:
                    level[to[a]] = level[i] + 1
                    queue.append(to[a])
        if not met:
            break
        turn = [0] * len(gain)
        for start in [i for i, s in enumerate(supply) if s]:
            path: list[int] = []
            at = start
            while supply[start]:
                if demand[at]:
                    flow = min([supply[start], demand[at], *(cap[a] for a in path)])
                    supply[start] -= flow
                    demand[at] -= flow
                    for a in path:
                        cap[a] -= flow
                        cap[a ^ 1] += flow
                    path, at = [], start
                    continue
                while turn[at] < len(arcs[at]):
                    a = arcs[at][turn[at]]
                    if cap[a] and level[to[a]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(arcs[at]):
                    path.append(arcs[at][turn[at]])
                    at = to[path[-1]]
                elif path:
                    at = to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
    # Boilerplate is what still reaches the sink.
    boilerplate = [d > 0 for d in demand]
    queue = [i for i, b in enumerate(boilerplate) if b]
    for i in queue:
        for a in arcs[i]:
            if cap[a ^ 1] and not boilerplate[to[a]]:
                boilerplate[to[a]] = True
                queue.append(to[a])
    return [not b for b in boilerplate]


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The page's content, block by block."""
    found = blocks(page or "")
    kept = content_side(gains(found, weights), edges(found))
    return "\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    weights = learned(rows)

    def run(batches):
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
