"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes that together cover its whole text. A passage is encoded by a small
layer over what its characters are (shares of byte classes, of class transitions, of repeated words), gated attention
weighs the passages, and the document's score is a logistic function of the weighted mean of their codes. All weights are
learned together, from document labels alone.

The training sample is bounded: labelled rows outside the held-out fold in the order of a keyed hash, TRAIN_DOCS of them and
TRAIN_PASSAGES passages together at most; each gives all its passages, and one that would go beyond the bound is left out
as a whole. Scoring reads every passage of every document.

Cases: a missing or empty text is one empty passage and gets a score; repeated rows get repeated results; a missing
doc_id is not held out; without any usable label every score is 0.5; an empty table gives an empty result; other columns
are ignored by `scores` and kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import each_batch, text_of

PASSAGE = 512
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 60_000
FOLDS = 5
CUT = 0.3
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 40, 128, 0.01
SEED = 7
#: Bytes of text whose features are computed at once.
CHUNK = 1 << 20


def byte_classes() -> np.ndarray:
    """Lower, upper, digit, blank, line end, each ASCII mark, leading and following bytes of longer characters."""
    table = np.full(256, 5, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[ord(" ")] = 3
    table[[10, 13]] = 4
    marks = [b for b in range(33, 127) if not chr(b).isalnum()]
    table[marks] = 6 + np.arange(len(marks))
    table[0x80:0xC0] = 6 + len(marks)
    table[0xC0:] = 7 + len(marks)
    return table


CLASSES = byte_classes()
N_CLASSES = int(CLASSES.max()) + 1
COARSE = np.minimum(np.arange(N_CLASSES), 6)
COARSE[-2:] = 7
N_FEATURES = N_CLASSES + 64 + 5
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of passages of texts of these sizes, and the size of each passage. Passages of a text are of even size."""
    many = np.maximum(1, -(-sizes // PASSAGE))
    bag = np.repeat(np.arange(len(sizes)), many)
    k = np.arange(len(bag)) - np.repeat(np.cumsum(many) - many, many)
    return many, (k + 1) * sizes[bag] // many[bag] - k * sizes[bag] // many[bag]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The passages' features, text after text, and the number of passages of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    many, lengths = passages(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n, where = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    share = np.maximum(lengths, 1)[:, None]
    kinds = CLASSES[data]
    single = np.bincount(where * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / share
    coarse = COARSE[kinds]
    pair = np.bincount(where[1:] * 64 + coarse[:-1] * 8 + coarse[1:], minlength=n * 64).reshape(n, 64) / share
    rest = np.zeros((n, 5))
    space = SPACES[data]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if len(first):
        # A word's hash: the sum of its bytes times powers of an odd number, by place.
        word = np.cumsum(np.bincount(first, minlength=len(data))) - 1
        place = np.arange(len(data)) - first[np.maximum(word, 0)]
        mixed = np.where(space | (word < 0), 0, (data.astype(np.uint64) + 1) * (np.uint64(0x9E3779B97F4A7C15) * (2 * place.astype(np.uint64) + 1)))
        hashes = np.add.reduceat(mixed, first)
        owner = where[first]
        words = np.maximum(np.bincount(owner, minlength=n), 1)
        for lag in (1, 2, 3):
            again = np.concatenate((np.zeros(min(lag, len(first)), bool), (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])))
            rest[:, lag - 1] = np.bincount(owner, weights=again, minlength=n) / words
        rest[:, 3] = np.minimum(lengths / words, 40) / 40
    rest[:, 4] = np.minimum(lengths, PASSAGE) / PASSAGE
    return np.hstack([single, pair, rest]).astype(np.float32), many


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, dict]:
        """The bags' logits and what the gradient needs. x: passages, bag after bag; many: passages of each bag."""
        w, starts = self.w, np.cumsum(many) - many
        code = np.maximum(x @ w["encode"] + w["encode_b"], 0)
        tanh, gate = np.tanh(code @ w["v"] + w["v_b"]), 1 / (1 + np.exp(-(code @ w["u"] + w["u_b"])))
        weight = (tanh * gate) @ w["a"]
        weight = np.exp(weight - np.repeat(np.maximum.reduceat(weight, starts), many))
        weight /= np.repeat(np.add.reduceat(weight, starts), many)
        bag = np.add.reduceat(weight[:, None] * code, starts)
        return bag @ w["out"] + w["out_b"], {"code": code, "tanh": tanh, "gate": gate, "weight": weight, "bag": bag, "starts": starts}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, many = features(texts)
        return 1 / (1 + np.exp(-self.forward(((x - self.mean) / self.scale).clip(-8, 8), many)[0]))


def gradient(model: Model, x: np.ndarray, many: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    logit, s = model.forward(x, many)
    w, g = model.w, {}
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    g["out"], g["out_b"] = s["bag"].T @ d, d.sum()
    d_bag = np.repeat(d[:, None] * w["out"][None], many, axis=0)
    d_weight = (d_bag * s["code"]).sum(1)
    mean = np.repeat(np.add.reduceat(s["weight"] * d_weight, s["starts"]), many)
    d_logit = s["weight"] * (d_weight - mean)
    g["a"] = (s["tanh"] * s["gate"]).T @ d_logit
    d_tanh = d_logit[:, None] * w["a"] * s["gate"] * (1 - s["tanh"] ** 2)
    d_gate = d_logit[:, None] * w["a"] * s["tanh"] * s["gate"] * (1 - s["gate"])
    g["v"], g["v_b"], g["u"], g["u_b"] = s["code"].T @ d_tanh, d_tanh.sum(0), s["code"].T @ d_gate, d_gate.sum(0)
    d_code = (s["weight"][:, None] * d_bag + d_tanh @ w["v"].T + d_gate @ w["u"].T) * (s["code"] > 0)
    g["encode"], g["encode_b"] = x.T @ d_code, d_code.sum(0)
    return g


def train(x: np.ndarray, many: np.ndarray, y: np.ndarray) -> Model:
    """Learn all weights by Adam on the logistic loss; deterministic for a given sample."""
    rng = np.random.default_rng(SEED)
    sizes = {"encode": (x.shape[1], HIDDEN), "encode_b": (HIDDEN,), "v": (HIDDEN, GATE), "v_b": (GATE,), "u": (HIDDEN, GATE), "u_b": (GATE,), "a": (GATE,), "out": (HIDDEN,), "out_b": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(max(1, n[0] if len(n) > 1 else 4)), n) if not k.endswith("_b") else np.zeros(n) for k, n in sizes.items()}
    model = Model(x.mean(0), x.std(0) + 1e-3, w)
    x = ((x - model.mean) / model.scale).clip(-8, 8).astype(np.float64)
    starts, (m1, m2), step = np.cumsum(many) - many, ({k: np.zeros(n) for k, n in sizes.items()} for _ in range(2)), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(many))
        for at in range(0, len(order), BATCH):
            own, step = order[at : at + BATCH], step + 1
            rows = np.concatenate([np.arange(starts[i], starts[i] + many[i]) for i in own])
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in gradient(model, x[rows], many[own], y[own]).items():
                g = g + 1e-4 * w[k]
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g**2
                w[k] = w[k] - rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)
    return model


def fold(docs: DataFrame) -> Column:
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS


def sample(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """The training sample, within its bounds: rows (_h, doc_id, label, text) of labelled documents outside the held-out fold."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[target].cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(fold(known) != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    # Twice as many labels as wanted rows, as some may have no document; at most 2 * TRAIN_DOCS rows of 12 bytes.
    known = known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(2 * TRAIN_DOCS)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").withColumns({"_h": F.xxhash64(F.lit(SEED), "doc_id"), "_th": F.xxhash64("text")})
    # Three numbers a row, for 2 * TRAIN_DOCS rows (and rows that repeat a doc_id, of which one is taken).
    sizes = found.select("_h", "doc_id", "_th", F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1)).alias("n"))
    sizes = sizes.groupBy("_h", "doc_id").agg(F.min(F.struct("_th", "n")).alias("_s")).orderBy("_h", "doc_id").limit(2 * TRAIN_DOCS)
    taken, room = [], TRAIN_PASSAGES
    for r in sizes.collect():
        if len(taken) < TRAIN_DOCS and r["_s"]["n"] <= room:
            taken.append((r["doc_id"], r["_s"]["_th"]))
            room -= r["_s"]["n"]
    wanted = docs.sparkSession.createDataFrame(taken, "doc_id long, _th long")
    return found.join(F.broadcast(wanted), ["doc_id", "_th"]).dropDuplicates(["doc_id", "_th"]).select("_h", "doc_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality") -> Model | None:
    def step(batch: pd.DataFrame) -> pd.DataFrame:
        x = [features([text.encode("utf-8", "surrogatepass")])[0].tobytes() for text in batch["text"]]
        return batch[["_h", "doc_id", "label"]].assign(x=x)

    bags = each_batch(sample(docs, labels, target), step, "_h long, doc_id long, label int, x binary")
    # The bound: TRAIN_PASSAGES times N_FEATURES floats.
    got = sorted(bags.collect(), key=lambda r: (r["_h"], r["doc_id"]))
    if not got:
        return None
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in got]
    return train(np.concatenate(x), np.array([len(b) for b in x]), np.array([r["label"] for r in got], float))


def apply(model: Model | None, texts: pd.Series) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out, at = np.full(len(raw), 0.5), 0
    while model is not None and at < len(raw):
        end, room = at, CHUNK
        while end < len(raw) and (end == at or room >= len(raw[end])):
            room -= len(raw[end])
            end += 1
        out[at:end] = model.score(raw[at:end])
        at = end
    return out


def scored(docs: DataFrame, labels: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep` and the score of every row."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(apply(model, texts))

    return docs.select(*keep, score(text_of(docs)).alias("score"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, score (0 to 1, higher: better), predicted (1 if score >= CUT)."""
    keep = [docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(fold(docs) == 0, F.lit(False)).alias("held_out")]
    return scored(docs, labels, keep).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents that score below CUT."""
    whole = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row")
    return scored(docs, labels, [whole]).where(F.col("score") >= CUT).select("_row.*")
