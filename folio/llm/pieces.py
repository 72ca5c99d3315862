"""SentencePiece encoding and decoding over a relational lattice.

A text is escaped as SentencePiece does (a space before it, spaces as U+2581) and cut into units where no piece can reach
across. Each distinct unit of the corpus is encoded once: its substrings of at most the longest piece's length are
exploded and joined with the piece table on equality, the edges are grouped by unit, and a higher-order `aggregate` folds
them to one path. For a unigram vocabulary that is the Viterbi path: the largest sum of scores, of level ones the one whose
last piece begins earlier. A vocabulary trained by merging (the public 32k one) has merge ranks for scores, and the largest
sum isn't SentencePiece's result; there the fold merges over the same lattice, step by step the neighbours whose edge has
the best score. Either way the ids are SentencePiece's own. A character that is no piece is written as byte pieces.

The texts are cut once. A unit that stands in the dictionary (the DICTIONARY most frequent units of some SAMPLE rows,
encoded by the same lattice and sent to every task) is written as its number there; the others are gaps. Every row's
numbers and the units in its gaps go through one exchange, by row: the distinct units of all gaps are encoded by the
lattice, joined with the gaps, and the gaps filled. The dictionary saves shuffling and decides no result.

Decoding gives back the text exactly, but for U+2581, which stands for a space.

Cases: a missing or empty text has no pieces; repeated rows give equal results; a missing doc_id stays missing; units
longer than LONG characters are encoded by the same rules in Python, as the fold keeps a unit's places in the bits of one
number; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import checkpoint, dealt, keyed, real_id

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY = 500_000
#: Rows whose units the dictionary is chosen from, about.
SAMPLE = 50_000
LONG = 61
#: Units that one task folds, about, and rows of one task between the passes over texts.
TASK_UNITS = 40_000
TASK_ROWS = 4096
#: Rows of a batch that are worked off at once, and bytes of their packed units.
ROWS = 256
PACKED = 1 << 20
#: Units whose ids are put together at once, unless one row has more.
FILLED = 1 << 17
#: Distinct units that a task counts before it passes them on.
COUNTED = 150_000
SPACE = "▁"
PENALTY = 10.0


@dataclass(frozen=True)
class Ids:
    """The ids of some rows, one after the other: row i has those from starts[i] to starts[i + 1]."""

    values: np.ndarray
    starts: np.ndarray

    def joined(self, spelling: pa.Array) -> Iterator[memoryview]:
        """Each row's ids spelled out, without anything between them."""
        # What is taken lies in one buffer in the rows' order, so a row is a part of it.
        _, ends, raw = spelling.take(pa.array(self.values)).buffers()
        at = np.frombuffer(ends, np.int64)[self.starts].tolist()
        raw = memoryview(raw or b"")
        return (raw[a:b] for a, b in pairwise(at))


@dataclass(frozen=True)
class Vocabulary:
    pieces: dict[str, tuple[int, float]]
    texts: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    cut: str
    longest: int
    penalty: float
    merging: bool

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, texts, by_byte = {}, [], {}
        for i in range(p.get_piece_size()):
            name = p.id_to_piece(i)
            if p.is_byte(i):
                by_byte[int(name[3:5], 16)] = i
                texts.append(bytes([int(name[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                texts.append(b" \xe2\x81\x87 " if p.is_unknown(i) else b"")
            else:
                pieces[name] = (i, p.get_score(i))
                texts.append(name.replace(SPACE, " ").encode())
        longest, worst = max(map(len, pieces), default=1), min((s for _, s in pieces.values()), default=0.0)
        return cls(pieces, tuple(texts), tuple(by_byte.get(b, p.unk_id()) for b in range(256)), cuts(pieces), longest, worst - PENALTY, spec.trainer_spec.model_type == 2)

    def units(self, text: str) -> list[str]:
        return re.findall(self.cut, SPACE + text.replace(" ", SPACE)) if text else []

    def spaced_units(self, text: str) -> list[str]:
        """The same with plain spaces, which keeps strings small; U+2581 counts as a space."""
        return re.findall(self.cut.replace(SPACE, " "), " " + text.replace(SPACE, " ")) if text else []

    def encode_unit(self, unit: str) -> list[int]:
        """A unit's ids, in plain Python: for long units, and what the fold is tested against."""
        parts = self.merged(unit) if self.merging else self.best(unit)
        ids = ([self.pieces[p][0]] if p in self.pieces else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")] for p in parts)
        return [i for part in ids for i in part]

    def best(self, unit: str) -> list[str]:
        """The pieces of the path with the largest sum of scores."""
        best: list = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            found = None
            for start in range(max(0, end - self.longest), end):
                score = self.pieces[unit[start:end]][1] if unit[start:end] in self.pieces else self.penalty if end - start == 1 else None
                if score is not None and (found is None or best[start][0] + score > found[0]):
                    found = (best[start][0] + score, start)
            best.append(found)
        out, at = [], len(unit)
        while at:
            out.append(unit[best[at][1] : at])
            at = best[at][1]
        return out[::-1]

    def merged(self, unit: str) -> list[str]:
        """The pieces left when neighbours are merged, best score first and leftmost of level ones."""
        stop, back = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        queue: list = []

        def offer(a: int) -> None:
            if 0 <= a and stop[a] < len(unit):
                piece = unit[a : stop[stop[a]]]
                if piece in self.pieces:
                    heapq.heappush(queue, (-self.pieces[piece][1], a, stop[a], stop[stop[a]]))

        for i in range(len(unit)):
            offer(i)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if stop[a] == b and stop[b] == c:
                stop[a], stop[b] = c, -1
                if c < len(unit):
                    back[c] = a
                offer(back[a])
                offer(a)
        out, at = [], 0
        while at < len(unit):
            out.append(unit[at : stop[at]])
            at = stop[at]
        return out

    @cached_property
    def spellings(self) -> tuple[pa.Array, pa.Array]:
        """What every id stands for, and every id in decimal with a comma."""
        return pa.array(self.texts, pa.large_binary()), pa.array([f"{i}," for i in range(len(self.texts))]).cast(pa.large_binary())

    def decode(self, ids) -> str:
        return b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")[1:]

    def decoded(self, ids: Ids) -> Iterator[str]:
        """`decode` of every row."""
        return (bytes(raw).decode("utf-8", "replace")[1:] for raw in ids.joined(self.spellings[0]))


def cuts(pieces) -> str:
    """A pattern of units: runs of letters or of marks with the spaces before them, single digits, spaces before nothing.

    Characters that some piece joins to another class are counted as marks; if pieces still reach across, units are whole
    words (spaces and what follows), across which no piece reaches unless it has a space inside.
    """
    letter, odd = re.compile(r"[^\W\d_]"), set()
    kind = lambda c: "S" if c == SPACE else "A" if letter.match(c) and c not in odd else "P"
    for p in pieces:
        for a, b in zip(p, p[1:], strict=False):
            if {kind(a), kind(b)} == {"A", "P"}:
                odd |= {c for c in (a, b) if kind(c) == "A"}
    across = {(kind(a), kind(b)) for p in pieces for a, b in zip(p, p[1:], strict=False)} - {("A", "A"), ("S", "A"), ("S", "S"), ("S", "P"), ("P", "P")}
    if any(p == (x, "S") for p in across for x in "AP"):
        return r"(?s).+"
    if across or len(odd) > 200:
        return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"
    odd_chars = "".join(map(re.escape, sorted(odd)))
    return rf"{SPACE}*[^\W\d_{odd_chars}]+|{SPACE}*(?:[^\w{SPACE}]|[\d_{odd_chars}])+|{SPACE}+" if odd else rf"{SPACE}*[^\W\d_]+|{SPACE}*[^\w{SPACE}\d]+|{SPACE}*[\d_]+|{SPACE}+"


def counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, n): how often each unit of at most LONG characters stands in the corpus; counted by COUNTED units at a time first."""

    def flushed(counts: Counter) -> pd.DataFrame:
        rows = [(u.replace(" ", SPACE), n) for u, n in counts.items() if len(u) <= LONG]
        return pd.DataFrame(rows, columns=["unit", "n"])

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(vocabulary.spaced_units(text))
                if len(counts) > COUNTED:
                    yield flushed(counts)
                    counts = Counter()
        yield flushed(counts)

    return docs.select("text").mapInPandas(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_table(spark, vocabulary: Vocabulary) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([(p, i, s) for p, (i, s) in vocabulary.pieces.items()], columns=["piece", "id", "score"]), "piece string, id int, score double")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def viterbi(edges: Column) -> Column:
    """The places on the path with the largest sum of scores, as bits. Edges are sorted by stop, then start."""
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("places"))
    # stop: the place that is being settled; best: the best path to it so far; done: the settled places from 0 on.
    start = F.struct(F.lit(0).alias("stop"), none.alias("best"), F.array().cast("array<struct<sum:double,places:bigint>>").alias("done"))

    def add(state: Column, e: Column) -> Column:
        new = e["stop"] > state["stop"]
        before = F.when(e["start"] == state["stop"], state["best"]).otherwise(F.get(state["done"], e["start"]))
        mine = F.struct((before["sum"] + e["score"]).alias("sum"), before["places"].bitwiseOR(bit(e["stop"])).alias("places"))
        return F.struct(
            e["stop"].alias("stop"),
            F.when(new | (before["sum"] + e["score"] > state["best"]["sum"]), mine).otherwise(state["best"]).alias("best"),
            F.when(new, F.concat(state["done"], F.array(state["best"]))).otherwise(state["done"]).alias("done"),
        )

    return F.aggregate(edges, start, add, lambda s: s["best"]["places"])


def merging(size: Column) -> Column:
    """The places left when neighbours are merged, as bits, by the edges in _long: their inner places, best score first, then start."""
    zero = F.lit(0).cast("long")

    def merge(places: Column, _: Column) -> Column:
        # The first edge between two places with one place within: that place goes. Without such an edge the places are
        # settled: they are kept inverted, below 0, so that the steps left pass over no edges.
        def first(found: Column, inner: Column) -> Column:
            whole = inner.bitwiseOR(F.shiftleft(inner, 1)).bitwiseOR(F.shiftright(inner, 1))
            fits = (F.bit_count(places.bitwiseAND(inner)) == 1) & (F.bit_count(places.bitwiseAND(whole)) == 3)
            return F.when(found != 0, found).when(fits, inner).otherwise(zero)

        def without(found: Column) -> Column:
            return F.when(found == 0, F.bitwise_not(places)).otherwise(places.bitwiseAND(F.bitwise_not(found)))

        return F.when(places < 0, places).otherwise(F.aggregate("_long", zero, first, without))

    steps = F.slice(F.sequence(F.lit(1), size), F.lit(1), F.least(size - 1, F.size("_long")))
    return F.aggregate(steps, bit(size + 1) - 1, merge, lambda places: F.when(places < 0, F.bitwise_not(places)).otherwise(places))


def encoded_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, ids): the relational lattice. `units` are distinct and dealt by unit, so grouping deals nothing again."""
    size = F.length("unit")
    lattice = units.select("unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    lattice = lattice.select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(vocabulary.longest), size - F.col("start")))).alias("_n"))
    lattice = lattice.select("unit", "start", (F.col("start") + F.col("_n")).alias("stop"), F.substring(F.col("unit"), F.col("start") + 1, F.col("_n")).alias("piece"))
    # The piece table is the vocabulary: a fixed size, whatever the input.
    lattice = lattice.join(F.broadcast(piece_table(units.sparkSession, vocabulary)), "piece", "left").where("id IS NOT NULL OR stop = start + 1")
    key = ["stop", "start"] if not vocabulary.merging else [(-F.col("score")).alias("rank"), "start", "stop"]
    masks = (bit(F.col("start")) + bit(F.col("stop"))).alias("ends"), (bit(F.col("stop")) - bit(F.col("start") + 1)).alias("inner")
    edge = F.struct(*key, F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocabulary.penalty)).alias("score"), *masks)
    edges = lattice.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("_edges"))
    edges = edges.withColumn("_long", F.filter(F.transform("_edges", lambda e: e["inner"]), lambda inner: inner != 0))
    found = edges.withColumn("_places", merging(F.length("unit")) if vocabulary.merging else viterbi(F.col("_edges")))
    on = F.filter("_edges", lambda e: (F.col("_places").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("_places").bitwiseAND(e["inner"]) == 0))
    ordered = F.sort_array(F.transform(on, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id"))))
    # Below 0: a character that is no piece, by its place from 1.
    found = found.select("unit", F.transform(ordered, lambda e: F.when(e["id"] < 0, -e["start"] - 1).otherwise(e["id"])).alias("_ids"))
    bytes_of = F.array(*(F.lit(i) for i in vocabulary.byte_ids))

    def spelled(i: Column) -> Column:
        raw = F.hex(F.encode(F.substring(F.col("unit"), -i, F.lit(1)), "UTF-8"))
        return F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), lambda k: F.get(bytes_of, F.conv(F.substring(raw, k * 2 + 1, F.lit(2)), 16, 10).cast("int")))

    plain = F.forall("_ids", lambda i: i >= 0)
    ids = F.when(plain, F.col("_ids")).otherwise(F.flatten(F.transform("_ids", lambda i: F.when(i >= 0, F.array(i)).otherwise(spelled(i)))))
    return found.select("unit", ids.alias("ids"))


@dataclass
class Names:
    """The dictionary's units, the most frequent first, with plain spaces; an Arrow column, so that the driver makes no object of each."""

    units: pa.Array

    @cached_property
    def numbers(self) -> dict[str, int]:
        """Each unit's number, from 1."""
        return {u: i for i, u in enumerate(self.units.to_pylist(), 1)}

    def __getstate__(self):
        return {"units": self.units}


@dataclass
class Dictionary:
    """The dictionary's ids: unit i has those from starts[i] on."""

    starts: np.ndarray
    ids: np.ndarray


def dictionary(rows: DataFrame, vocabulary: Vocabulary, most: int) -> tuple[Names, Dictionary]:
    """The `most` units that stand most often in the sample, and their ids."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(8), "_id", "_th"), 32) <= int(share * (1 << 32)))
    # The units are written where executors read them again: rows made from the driver's would be objects in its heap.
    kept = checkpoint(counted(sample, vocabulary).orderBy(F.desc("n"), "unit").limit(most))
    # At most `most` rows of some 30 bytes each, as Arrow columns; frequent units get small numbers.
    top = kept.toArrow().sort_by([("n", "descending"), ("unit", "ascending")]).select(["unit"])
    got = encoded_units(kept.select("unit").repartition(max(1, -(-top.num_rows // TASK_UNITS)), "unit"), vocabulary).toArrow().sort_by("unit")
    back = np.empty(top.num_rows, np.int64)
    back[pc.sort_indices(top, [("unit", "ascending")]).to_numpy()] = np.arange(top.num_rows)
    ids = got["ids"].take(pa.array(back)).combine_chunks()
    return Names(pc.replace_substring(top["unit"], SPACE, " ").combine_chunks()), Dictionary(ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy())


def packed(key: int, text: str, vocabulary: Vocabulary, numbers: dict[str, int], pack) -> list[bytes]:
    """A row as its _id, its text's SHA-256 and its units' numbers, the ids of its long units, and the units in its gaps.

    Numbers above the dictionary's stand for the gaps: its first unit, its second, and so on. A long unit's place among
    the gaps is empty; its ids are in the second part, after its place and their number.
    """
    units = vocabulary.spaced_units(text)
    codes = np.fromiter(map(numbers.get, units, repeat(0)), np.uint32, len(units))
    at = np.flatnonzero(codes == 0)
    gaps: dict[str, int] = {}
    codes[at] = [len(numbers) + 1 + gaps.setdefault(units[i], len(gaps)) for i in at.tolist()]
    own: list[int] = []
    for u in gaps:
        if len(u) > LONG:
            ids = vocabulary.encode_unit(u.replace(" ", SPACE))
            own += [gaps[u], len(ids), *ids]
    # First all low bytes, then the next: frequent units have small numbers, so the higher bytes are mostly zero.
    body = codes.view(np.uint8).reshape(-1, 4).T.tobytes()
    return [key.to_bytes(8, "little", signed=True) + hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest() + pack(body), np.array(own, np.int32).tobytes(), *(b"" if len(u) > LONG else u.replace(" ", SPACE).encode() for u in gaps)]


def answered(parts: list[list[bytes]], found: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where in them those of each gap begin and how many they are; each row's first gap. `found` holds lists of a gap's place and its ids."""
    n_gaps = np.fromiter((len(p) - 2 for p in parts), np.int64, len(parts))
    first = np.cumsum(n_gaps) - n_gaps
    answers = found.flatten()
    lengths = pc.list_value_length(answers).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, at = answers.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(parts)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    fits = ids[at] < n_gaps[row]
    gap = (first[row] + ids[at])[fits]
    starts, sizes = np.zeros((2, int(n_gaps.sum())), np.int64)
    starts[gap], sizes[gap] = at[fits] + 1, lengths[fits] - 1
    # Two rows of one key would find each other's units too: then a gap has two answers, or one too many.
    sizes[np.bincount(gap, minlength=len(sizes)) > 1] = 0
    own: dict[int, np.ndarray] = {}
    for p, g in zip(parts, first.tolist(), strict=True):
        long, k = np.frombuffer(p[1], np.int32), 0
        while k < len(long):
            own[g + int(long[k])] = long[k + 2 : k + 2 + long[k + 1]]
            k += 2 + int(long[k + 1])
    sizes[list(own)] = 0
    left = np.flatnonzero(sizes == 0)
    more = [own[g] if g in own else np.array(vocabulary.encode_unit(parts[r][2 + g - first[r]].decode()), np.int32) for g, r in zip(left.tolist(), (np.searchsorted(first, left, "right") - 1).tolist(), strict=True)]
    sizes[left] = [len(m) for m in more]
    starts[left] = len(ids) + np.cumsum(sizes[left]) - sizes[left]
    return np.concatenate([ids, *more]), starts, sizes, first


def filled(parts: list[list[bytes]], found: pa.Array, vocabulary: Vocabulary, d: Dictionary) -> Iterator[tuple[list[list[bytes]], Ids]]:
    """Rows and their ids, some at a time, from their parts and what the join found for their gaps."""
    unpack, n_known = zstandard.ZstdDecompressor().decompress, len(d.starts) - 1
    ids, gap_starts, gap_sizes, first = answered(parts, found, vocabulary)
    table = np.concatenate([d.ids, ids])

    def put(codes: list[np.ndarray]) -> Ids:
        mine = np.concatenate(codes)
        gaps = np.flatnonzero(mine >= n_known)
        known = np.minimum(mine, n_known - 1) if n_known else np.zeros_like(mine)
        starts, n = (d.starts[known], d.starts[known + 1] - d.starts[known]) if n_known else (known, known.copy())
        starts[gaps], n[gaps] = len(d.ids) + gap_starts[mine[gaps] - n_known], gap_sizes[mine[gaps] - n_known]
        ends = np.concatenate([[0], np.cumsum(n)])
        values = table[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        return Ids(values, ends[np.cumsum([0, *map(len, codes)])])

    done, codes, size = 0, [], 0
    for i, p in enumerate(parts):
        mine = np.frombuffer(unpack(p[0][40:]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64) - 1
        mine[mine >= n_known] += first[i]
        if codes and size + len(mine) > FILLED:
            yield parts[done:i], put(codes)
            done, codes, size = i, [], 0
        codes.append(mine)
        size += len(mine)
    if codes:
        yield parts[done:], put(codes)


def row_key() -> Column:
    """A row's key, by which its gaps come back to it; repeated rows are told apart by their partition, so no key gathers them."""
    return F.xxhash64(F.spark_partition_id(), "_id", "_th")


def runs(batch: pa.RecordBatch):
    """A batch in runs of at most ROWS rows and about PACKED bytes of parts."""
    at = 0
    while at < batch.num_rows:
        n = min(ROWS, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > PACKED:
            n //= 2
        yield batch.slice(at, n)
        at += n


def encoded(docs: DataFrame, model: str = MODEL, most: int = DICTIONARY, step=lambda ids, shas, vocabulary: ([ids.values[a:b].tobytes() for a, b in pairwise(ids.starts)],), columns: str = "ids binary") -> DataFrame:
    """_id and the columns that `step` makes of rows' ids and their texts' SHA-256; by itself the ids as little-endian 32-bit numbers."""
    vocabulary, spark = Vocabulary.load(model), docs.sparkSession
    rows = keyed(docs).select("_id", "_th", "text")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    # Two broadcasts of a fixed size: a task keeps only the one that it uses.
    names_, d = map(spark.sparkContext.broadcast, dictionary(rows, vocabulary, most))

    def first(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for run in runs(batch):
                parts = [packed(i, t, vocabulary, names_.value.numbers, pack) for i, t in zip(run["_id"].to_pylist(), run["text"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([run["_key"], pa.array(parts, pa.list_(pa.binary()))], ["_key", "parts"])

    names = [c.split()[0] for c in columns.split(", ")]

    def last(batches):
        for batch in batches:
            for run in runs(batch):
                for parts, ids in filled(run["parts"].to_pylist(), run["found"], vocabulary, d.value):
                    made = step(ids, [p[0][8:40] for p in parts], vocabulary)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, ([int.from_bytes(p[0][:8], "little", signed=True) for p in parts], *made))), ["_id", *names])

    keys = rows.withColumn("_key", row_key()).select("_key", "_id", "text")
    # One column has all parts, the key is declared as never missing, and gaps are exploded with their empties, so that both
    # readers read the same exchange: otherwise columns and filters would be pushed below it for one of them, and the texts
    # cut twice.
    begun = keys.mapInArrow(first, "_key long NOT NULL, parts array<binary>").repartition(tasks, "_key")
    gaps = begun.select("_key", F.posexplode_outer(F.slice("parts", 3, F.greatest(F.size("parts") - 2, F.lit(0)))).alias("k", "_u"))
    gaps = gaps.select("_key", "k", F.col("_u").cast("string").alias("unit")).where("length(unit) > 0").repartition(tasks, "unit")
    # The maxima only keep all columns, so that the distinct units are read from the same exchange as the gaps.
    units = gaps.groupBy("unit").agg(F.max("_key").alias("_k"), F.max("k").alias("_n")).where((F.col("_k") >= -(2**63)) & (F.col("_n") >= 0)).select("unit")
    answers = gaps.join(dealt(encoded_units(units, vocabulary)), "unit").select("_key", F.concat(F.array("k"), "ids").alias("_a"))
    answers = answers.repartition(tasks, "_key").groupBy("_key").agg(F.collect_set("_a").alias("found"))
    return begun.join(dealt(answers), "_key", "left").select("parts", "found").mapInArrow(last, f"_id long, {columns}").select("_id", *names)


def piece_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids_sha256 (of the ids in decimal, comma-joined), decoded_sha256, exact (decoding gives the text)."""

    def step(ids: Ids, shas: list[bytes], vocabulary: Vocabulary) -> tuple:
        decimal = [hashlib.sha256(raw[:-1]).hexdigest() for raw in ids.joined(vocabulary.spellings[1])]
        decoded = [hashlib.sha256(text.encode("utf-8", "surrogatepass")) for text in vocabulary.decoded(ids)]
        return np.diff(ids.starts), decimal, [h.hexdigest() for h in decoded], [h.digest() == sha for h, sha in zip(decoded, shas, strict=True)]

    out = encoded(docs, model, step=step, columns="n_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean")
    return out.select(real_id("_id"), "n_pieces", "ids_sha256", "decoded_sha256", "exact")


def tokenised(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids, text (decoded from the ids)."""

    def step(ids: Ids, shas: list[bytes], vocabulary: Vocabulary) -> tuple:
        return np.diff(ids.starts), [ids.values[a:b] for a, b in pairwise(ids.starts)], list(vocabulary.decoded(ids))

    out = encoded(docs, model, step=step, columns="n_pieces long, ids array<int>, text string")
    return out.select(real_id("_id"), "n_pieces", "ids", "text")
