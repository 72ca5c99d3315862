"""Substring dedup: FM-indexes of bounded shards, searched backwards over wavelet matrices.

A window is WINDOW consecutive words of a document; a word is removed if a window covers it whose words also start
earlier. Windows are brought together by anchors: a window's anchor is the least hash of its GRAM-word sequences, so equal
windows have equal anchors.

1. Every document gives its distinct anchors. An anchor that stands once in the corpus has no repeated window; only
   repeated ones go on (a count and a semi-join that read one exchange).
2. Runs of windows with one repeated anchor are segments. Equal segments are one row with the place of the first copy; all
   windows of later copies are repeated. An anchor with more than SHARD distinct segments is hot (a passage in many
   contexts): each of its windows is a segment of its own, met by the hash of the whole window instead of the anchor, and
   needs no index.
3. Distinct segments are dealt to shards by their anchor. A shard builds an FM-index of its segments: a suffix array by
   prefix doubling, the Burrows-Wheeler transform, a wavelet matrix with packed bits and block counts. The segments are
   streamed through it from their last word backwards, all at once: a step takes the interval of the words matched so far
   to that of one word more, and an interval of more than WINDOW words is widened to the suffixes that share WINDOW words.
   The match length at each place is the matching statistic; where it reaches WINDOW, the least place within the interval
   says whether the window starts earlier too.
4. The repeated windows come back to their documents, whose words are cut.

Anchors and segments only decide what meets; whether windows are equal is decided on the words themselves. Segments that
meet in step 2 have equal 64-bit hashes and equal anchors, 128 bits together.

Cases: a missing or empty text has no words; documents are ordered by doc_id (a missing one first), then the text's hash;
rows that repeat in doc_id and text are one document twice and lose the same words; texts shorter than a window lose
nothing; an empty table gives an empty result; other columns are ignored by `substring_report` and kept by
`substring_dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, keyed, mark, real_id

WINDOW = 20
GRAM = 5
#: Windows of a segment at most; longer runs are cut.
SEGMENT = 64
#: Segments of a shard, about, and of one anchor at most.
SHARD = 20_000
#: Bytes of text that are taken at once, about; a longer text is taken alone.
PART = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The six separators of the contract.
SEPARATOR = np.isin(np.arange(256), list(b" \t\n\v\f\r"))

# Hashes of word sequences are polynomials of their bytes' random numbers modulo 2^64; a power is a product of two tabled ones.
BASE, BLOCK = 0xD6E8FEB86659FD93, 1 << 16
BYTE = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.array([1] + [base % 2**64] * (n - 1), np.uint64))


UP, DOWN = powers(BASE, BLOCK), powers(pow(BASE, -1, 2**64), BLOCK)


class Words:
    """The words of several texts, each followed by one space.

    data: their bytes; begin: where each word begins, and the end; first: each text's first word, and the end.
    """

    def __init__(self, texts: pa.Array):
        nothing = pa.scalar(b"", pa.large_binary())
        # Each text with a space at its end, so that no word goes on in the next text.
        spaced = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_binary()), nothing), nothing, pa.scalar(b" ", pa.large_binary()))
        offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, 8 * spaced.offset)
        raw = np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        separator = SEPARATOR[raw]
        stop = separator.copy()
        stop[:1] = False
        stop[1:] &= ~separator[:-1]
        self.first = np.searchsorted(np.flatnonzero(stop), offsets - offsets[0])
        keep = ~separator | stop
        self.data, stop = raw[keep], stop[keep]
        self.data[stop] = 32
        self.begin = np.concatenate(([0], np.flatnonzero(stop) + 1))

    def __len__(self) -> int:
        return len(self.begin) - 1

    def ready(self) -> None:
        """Sums of the polynomial up to each word, and what takes a sum from a word on down to the same power."""
        terms = BYTE[self.data]
        for at in range(0, len(terms), BLOCK):
            block = terms[at : at + BLOCK]
            block *= UP[: len(block)] * np.uint64(pow(BASE, at, 2**64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))[self.begin]
        far = powers(pow(BASE, -BLOCK, 2**64), (len(terms) >> 16) + 1)
        self.down = DOWN[self.begin & (BLOCK - 1)] * far[self.begin >> 16]

    def hashes(self, low, high) -> np.ndarray:
        """Hashes of the sequences from words `low` up to words `high`."""
        x = (self.sums[high] - self.sums[low]) * self.down[low]
        x ^= x >> np.uint64(32)
        x *= MIX
        x ^= x >> np.uint64(29)
        x *= MIX
        return x ^ (x >> np.uint64(32))

    def sequences(self, low: np.ndarray, high: np.ndarray) -> list[bytes]:
        """The words from each `low` up to each `high`, joined by one space."""
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.begin[low].tolist(), (self.begin[high] - 1).tolist(), strict=True)]

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each word, equal for equal words only, and how many there are."""
        at = np.ascontiguousarray(self.begin - np.arange(len(self.begin)), np.int64)
        told = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(at), pa.py_buffer(self.data[self.data != 32])]).dictionary_encode()
        return told.indices.to_numpy(), len(told.dictionary)


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about PART bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // PART
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def arrow_step(docs: DataFrame, step, schema: str) -> DataFrame:
    """Apply `step`, from a batch to a list of columns, to the batches of `docs` within its partitions."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in step(batch)], names=names)

    return docs.mapInArrow(run, schema)


def flat(found: list[tuple], *kinds) -> list[np.ndarray]:
    """Columns of several parts, one after another."""
    return [np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]).astype(kind) for i, kind in enumerate(kinds)]


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def anchors(g: np.ndarray) -> np.ndarray:
    """The least hash of each window's sequences."""
    width, have = WINDOW - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:])
        have += step
    return g


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's text, first word, anchor, and whether its first GRAM words are the anchor's."""
    counts = np.maximum(np.diff(words.first) - (WINDOW - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return text, text, np.zeros(0, np.int64), np.zeros(0, bool)
    words.ready()
    at = np.arange(len(text)) + np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts)
    g = words.hashes(slice(0, len(words) - GRAM + 1), slice(GRAM, None))
    least = anchors(g)[at]
    return text, at, least.view(np.int64), g[at] == least


def runs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments: each one's text, first word, number of windows and anchor, and at how many new places the anchor stands.

    A segment begins at each change of the windows' anchor, and after SEGMENT windows of one. A window's anchor stands at a new
    place where a run begins, and where the window before began with the anchor.
    """
    text, at, least, leads = windows(words)
    if not len(text):
        return text, at, at, least, at
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])))
    starts = np.flatnonzero(new)
    into = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    low = np.flatnonzero(into % SEGMENT == 0)
    moved = new.copy()
    moved[1:] |= leads[:-1]
    return text[low], at[low], np.diff(np.append(low, len(at))), least[low], np.add.reduceat(moved.astype(np.int64), low)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, s, _k): each document's anchors with a hash of each distinct segment, its complement where the anchor's words stand twice in the document."""

    def step(batch: pa.RecordBatch) -> list[np.ndarray]:
        found = []
        for part in parts(batch):
            words = Words(part.column("text"))
            text, at, n, h, places = runs_of(words)
            if not len(text):
                continue
            s = (words.hashes(at, at + n + WINDOW - 1) >> np.uint64(33)).astype(np.int32)
            order = np.lexsort((s, h, text))
            text, h, s, places = text[order], h[order], s[order], places[order]
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
            begins = np.flatnonzero(first)
            twice = np.repeat(np.add.reduceat(places, begins) > 1, np.diff(np.append(begins, len(h))))
            first[1:] |= s[1:] != s[:-1]
            found.append((h[first], np.where(twice, ~s, s)[first], ints(part.column("_k"))[text[first]]))
        return flat(found, np.int64, np.int32, np.int64)

    return arrow_step(docs.select("_k", "text"), step, "h long, s int, _k long")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(_k, hs, hot, segments): the anchors of each document that stand more than once in the corpus; those with more than SHARD
    distinct segments apart, and how many segments the others have.
    """
    # Made and dealt once, by anchor, for both counts and the join: both sides read all three columns, or they would be two
    # exchanges and every text would be hashed twice. Anchors stay rows: no list of them is gathered.
    rows = anchor_rows(docs).repartition("h")
    by_segment = rows.groupBy("h", F.greatest("s", F.bitwise_not("s")).alias("_s")).agg(F.count("_k").alias("_n"), F.min("s").alias("_least"))
    counts = by_segment.groupBy("h").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.count("*").alias("_s"))
    many = counts.where("_n > 1 OR _least < 0").select("h", (F.col("_s") > SHARD).alias("_hot"))
    cool, hot = F.when(~F.col("_hot"), F.col("h")), F.when(F.col("_hot"), F.col("h"))
    return rows.join(many, "h").groupBy("_k").agg(F.collect_set(cool).alias("hs"), F.collect_set(hot).alias("hot"), F.count(F.when(~F.col("_hot"), F.col("s"))).alias("segments"))


PLACE = ["_id", "_th", "start"]


def key() -> Column:
    """A document's key: rows without doc_id have keys of their own, by their texts."""
    return F.xxhash64("_id", "_th").alias("_k")


def segments(docs: DataFrame, content: bool) -> DataFrame:
    """The segments of documents with their repeated anchors (hs): h, c (the content's hash), n, _id, _th, start.

    With the content, only the first copy within a batch is given: a common segment has a row for each batch at most.
    """

    def step(batch: pa.RecordBatch) -> list:
        found, joined = [], []
        for part in parts(batch):
            words = Words(part.column("text"))
            text, at, n, h, _ = runs_of(words)
            # Whether an anchor is repeated doesn't depend on the document.
            own = np.isin(h, ints(part.column("hs").flatten()))
            text, at, n, h = text[own], at[own], n[own], h[own]
            said = words.sequences(at, at + n + WINDOW - 1)
            found.append((h, digests(said), n, ints(part.column("_id"))[text], ints(part.column("_th"))[text], at - words.first[text]))
            if content:
                joined.extend(said)
        columns = flat(found, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32)
        if not content:
            return columns
        h, c, _, key, th, start = columns
        order = np.lexsort((start, th, key, h, c))
        h, c = h[order], c[order]
        first = order[np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])))[: len(h)]]
        return [*(x[first] for x in columns), pa.array([joined[i] for i in first.tolist()], pa.binary())]

    return arrow_step(docs.select("_id", "_th", "text", "hs"), step, "h long, c long, n int, _id long, _th long, start int" + ", content binary" * content)


def digests(said: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in said), np.uint64, len(said)).view(np.int64)


def hot_windows(docs: DataFrame) -> DataFrame:
    """The windows with an anchor that is hot in their document, as segments of one window: h is a second hash of the window's words."""

    def step(batch: pa.RecordBatch) -> list:
        found = []
        for part in parts(batch):
            words = Words(part.column("text"))
            text, at, least, _ = windows(words)
            own = np.isin(least, ints(part.column("hot").flatten()))
            text, at = text[own], at[own]
            said = words.sequences(at, at + WINDOW)
            found.append((digests(said, 1), digests(said), np.ones(len(at), np.int32), ints(part.column("_id"))[text], ints(part.column("_th"))[text], at - words.first[text]))
        return flat(found, np.int64, np.int64, np.int32, np.int64, np.int64, np.int32)

    return arrow_step(docs.select("_id", "_th", "text", "hot"), step, "h long, c long, n int, _id long, _th long, start int")


class WaveletMatrix:
    """Ranks of symbols in a sequence; a level's bits are packed in words of 64 with a count before each."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.depth, self.levels = max(1, (sigma - 1).bit_length()), []
        for level in range(self.depth - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(seq) + 1) // 64) * 64, bool)
            padded[: len(seq)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1])).astype(np.int32)
            self.levels.append((level, packed, counts, int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.start = self.walk(np.arange(sigma), np.zeros(sigma, np.int32))

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, packed, counts, zeros in self.levels:
            word, mask = packed[at >> 6], (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[at >> 6] + np.bitwise_count(word & mask).astype(np.int32)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self.walk(symbols, at) - self.start[symbols]


class FMIndex:
    """The segments of a shard: symbols 1, 2, ... are words, 0 ends a segment."""

    def __init__(self, text: np.ndarray, sigma: int):
        self.n, ends = len(text), np.flatnonzero(text == 0)
        # Ends count as different, in order of place; so no comparison runs past one.
        rank = np.where(text == 0, 0, text.astype(np.int64) + len(ends) - 1)
        rank[ends] = np.arange(len(ends))
        reach, half = 1, None
        while reach < 32:
            if reach == 16:
                half = rank
            ahead = np.concatenate([rank[reach:], np.zeros(min(reach, self.n), np.int64)])[: self.n]
            key = rank * (int(rank.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = np.empty(self.n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            reach *= 2
        self.order = order
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int32)
        self.matrix = WaveletMatrix(text[order - 1], sigma)
        # Suffixes that share WINDOW words: equal in the first 16 and in the 16 that end with the WINDOW-th.
        rest = half[np.minimum(order + WINDOW - 16, self.n - 1)]
        first = np.concatenate(([True], (np.diff(half[order]) != 0) | (np.diff(rest) != 0)))
        self.low = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.high = np.append(self.low[1:], self.n)

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of one word more at the front."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.counts[symbols]
        return base + both[: len(low)], base + both[len(low) :]


def search(shard: pd.DataFrame) -> pd.DataFrame:
    """Each distinct segment of a shard: h, c, its first copy's place, and that copy's windows that start earlier in another
    segment as runs (at, many).
    """
    shard = shard.sort_values([*PLACE, "h", "c"]).reset_index(drop=True)
    words = Words(pa.array(shard["content"], pa.large_binary()))
    sizes = np.diff(words.first)
    codes, names = words.codes()
    text = np.zeros(len(words) + len(shard), np.int32)
    ends = np.cumsum(sizes + 1) - 1
    keep = np.ones(len(text), bool)
    keep[ends] = False
    text[keep] = codes + 1
    index = FMIndex(text, names + 1)
    # A place's order: its document's, then its word's.
    _, document = np.unique(np.stack([shard["_id"], shard["_th"]], 1), axis=0, return_inverse=True)
    owner = np.repeat(np.arange(len(shard)), sizes + 1)
    offset = np.arange(len(text)) - (ends - sizes)[owner]
    place = (document.reshape(-1)[owner].astype(np.int64) << 32) | (shard["start"].to_numpy(np.int64)[owner] + offset)
    first = np.minimum.reduceat(place[index.order], index.low)
    earlier = np.zeros(len(text), bool)
    by_size = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(shard), np.int32), np.full(len(shard), index.n, np.int32)
    for step in range(int(sizes.max(initial=0))):
        now = by_size[: np.searchsorted(-sizes[by_size], -step, side="left")]
        at = ends[now] - 1 - step
        low[now], high[now] = index.extend(text[at], low[now], high[now])
        if step + 1 >= WINDOW:  # the matching statistic reaches the threshold: widen to what shares WINDOW words
            group = index.group[low[now]]
            low[now], high[now] = index.low[group], index.high[group]
            earlier[at] = first[group] < place[at]
    edges = np.diff(np.concatenate(([0], earlier.astype(np.int8), [0])))
    begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    found: dict[int, list] = {}
    for a, b in zip(begins.tolist(), stops.tolist(), strict=True):
        found.setdefault(int(owner[a]), []).append({"at": int(offset[a]), "many": b - a})
    return shard[["h", "c", *PLACE]].assign(runs=[found.get(i, []) for i in range(len(shard))])


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents dealt by _k, and (_k, cuts): their repeated windows as structs (_th, at, many)."""
    anchored = checkpoint(repeated_anchors(docs))
    total = anchored.agg(F.sum("segments")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    # Dealt by _k once; the joins below and the last one read the same exchange.
    dealt = docs.repartition("_k")
    hot = anchored.where(F.size("hot") > 0).select("_k", "hot")
    some = not hot.isEmpty()
    with_anchors = dealt.join(anchored.select("_k", "hs"), "_k")
    place = F.struct(*PLACE)
    # Dealt by shard once. Equal segments of many batches become one row there before a shard is gathered.
    copies = segments(with_anchors, True).withColumn("shard", F.pmod("h", F.lit(shards))).repartition("shard")
    once = copies.groupBy("shard", "h", "c").agg(F.min(F.struct(*PLACE, "content")).alias("_s")).select("shard", "h", "c", "_s.*")
    heads = once.groupBy("shard").applyInPandas(lambda pdf: search(pdf), "h long, c long, _id long, _th long, start int, runs array<struct<at:int,many:int>>")
    heads, rows = heads.select("h", "c", place.alias("_first"), "runs"), segments(with_anchors, False)
    if some:
        windows = hot_windows(dealt.join(hot, "_k"))
        firsts = windows.groupBy("h", "c").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
        heads = heads.unionByName(firsts.select("h", "c", "_first", F.array().cast("array<struct<at:int,many:int>>").alias("runs")))
        rows = rows.unionByName(windows)
    later = rows.join(heads, ["h", "c"])
    runs = F.when(place == F.col("_first"), F.col("runs")).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.col("n").alias("many"))))
    cuts = later.select("_id", "_th", "start", F.explode(runs).alias("_r")).select(key(), F.struct("_th", (F.col("start") + F.col("_r.at")).alias("at"), F.col("_r.many").alias("many")).alias("_c"))
    return dealt, cuts.groupBy("_k").agg(F.collect_set("_c").alias("cuts"))


def rest(words: Words, th: np.ndarray, cuts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Each text's number of removed words, and its words left, joined by one space."""
    runs, text = cuts.flatten(), ints(pc.list_parent_indices(cuts))
    own = ints(runs.field("_th")) == th[text]
    low = words.first[text[own]] + ints(runs.field("at"))[own]
    high = low + ints(runs.field("many"))[own] + WINDOW - 1
    n = len(words) + 1
    gone = np.cumsum(np.bincount(low, minlength=n) - np.bincount(high, minlength=n))[:-1] > 0
    sizes = np.diff(words.begin)
    data = words.data[np.repeat(~gone, sizes)].tobytes()
    ends = np.concatenate(([0], np.cumsum(np.where(gone, 0, sizes))))[words.first].tolist()
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
    return removed, [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:], strict=False)]


def substring_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space)."""
    dealt, cuts = repeated_windows(keyed(docs).select("_id", "_th", key(), "text"))

    def step(batch: pa.RecordBatch) -> list:
        found, sums = [], []
        for part in parts(batch):
            words = Words(part.column("text"))
            removed, left = rest(words, ints(part.column("_th")), part.column("cuts"))
            found.append((ints(part.column("_id")), np.diff(words.first), removed))
            sums.extend(hashlib.sha256(x).hexdigest() for x in left)
        return [*flat(found, np.int64, np.int64, np.int64), pa.array(sums, pa.string())]

    out = arrow_step(dealt.join(cuts, "_k", "left").select("_id", "_th", "text", "cuts"), step, "_id long, n_words long, n_removed long, kept_sha256 string")
    return out.select(real_id("_id"), "n_words", "n_removed", "kept_sha256")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the words of repeated windows cut from their texts; a text that loses nothing stays as it is."""
    _, cuts = repeated_windows(keyed(docs).select("_id", "_th", key(), "text"))

    @F.arrow_udf("string")
    def cut(text: pa.Array, th: pa.Array, found: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        for part in parts(pa.RecordBatch.from_arrays([text, th, found], names=["text", "_th", "cuts"])):
            removed, left = rest(Words(part.column("text")), ints(part.column("_th")), part.column("cuts"))
            out.extend(x if n else None for n, x in zip(removed.tolist(), left, strict=True))
        return pa.array(out, pa.binary()).cast(pa.string())

    kind = docs.schema["text"].dataType
    rows = mark(docs).withColumn("_k", key()).join(cuts, "_k", "left")
    rows = rows.withColumn("_text", F.coalesce(cut(F.col("_row.text").cast("string"), "_th", "cuts").cast(kind), F.col("_row.text")))
    return rows.select(*(F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


#: The same report in DuckDB's SQL, for tables without repeated doc_ids.
REPORT_SQL = f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS k FROM doc, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM ranked, unnest(range({WINDOW})) AS u(j) WHERE r > 1),
lost AS (SELECT doc_id, list(pos) AS ats FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ats), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ats IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ats, i)) END, ' ')) AS kept_sha256
FROM doc d LEFT JOIN lost USING (doc_id)
"""
