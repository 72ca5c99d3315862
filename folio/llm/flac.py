"""FLAC streams of 8-bit mono samples: writing, reading with all checks, and PCM blocks with sample offsets.

The format is the public one (RFC 9639): a STREAMINFO block with the samples' MD5, a SEEKTABLE with a point for every
frame, then frames of BLOCK samples. The writer picks, frame by frame, the shortest of a constant, the fixed predictor of
order 0, a linear predictor of order ORDER fitted to the frame, or plain samples. The reader verifies the CRC-8 of
headers, the CRC-16 of frames and the MD5, decodes Rice residuals (any partition order, both parameter sizes, escapes)
and constant, plain, fixed and linear subframes.

Work is vectorised over frames: the n-th residual of FRAMES frames is read in one step, so Python runs BLOCK steps for
them and not one a sample. Texts are worked off in pieces of CHUNK bytes, and frames FRAMES at a time, so that a long
text needs no more than its own size, its stream's and some 60 times CHUNK. The format's seek table holds 932,067 points,
so a text may have 954 MB; a row of twice that is beyond what Spark and Arrow pass on.

Cases: a missing or empty text is 64 zero bytes; repeated rows give equal values; a missing doc_id stays missing; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import each_batch, keyed, real_id

UNIT = 64
BLOCK = 1024
RATE = 8000
ORDER = 4
PRECISION = 12
CHUNK = 1 << 22
FRAMES = CHUNK // BLOCK
HEAD = 4 + 4 + 34 + 4  # marker, STREAMINFO with its header, the seek table's header
NUMBERED = (0x80, 0x800, 0x10000, 0x200000, 0x4000000)  # fixed values: from here on a frame's number takes a byte more
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values: the format's predictors


def crc_table(poly: int, bits: int) -> np.ndarray:
    table, top = [], 1 << (bits - 1)
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & ((1 << bits) - 1)
        table.append(r)
    return np.array(table, np.uint32)


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksums of many ranges at once: step n takes the n-th byte of every range that has one."""
    order = np.argsort(-sizes, kind="stable")
    at, r = starts[order], np.zeros(len(starts), np.uint32)
    alive = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")
    mask = np.uint32((1 << bits) - 1)
    for n, k in enumerate(alive):
        r[:k] = ((r[:k] << np.uint32(8)) & mask) ^ table[(r[:k] >> np.uint32(bits - 8)) ^ data[at[:k] + n]]
    out = np.empty_like(r)
    out[order] = r
    return out


# Writing


def packed(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes of fields, each a value right-aligned in its width, one after another."""
    ends = np.cumsum(widths, dtype=np.int64)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for j in range(int(values.max(initial=0)).bit_length()):
        on = np.flatnonzero((values & (1 << j)) != 0)
        bits[ends[on] - 1 - j] = 1
    return np.packbits(bits)


def linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised coefficients and shift of a linear predictor for every frame, by Levinson-Durbin on autocorrelations, and
    about how many bits it saves a sample.
    """
    y = x.astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, lag:], y[:, : y.shape[1] - lag]) for lag in range(ORDER + 1)], 1).astype(np.float64)
    err, a = r[:, 0] + 1.0, np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        old = a[:, :i].copy()
        a[:, :i], a[:, i] = old - k[:, None] * old[:, ::-1], k
        err = np.maximum(err * (1 - k**2), 1e-6)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.frexp(np.maximum(top, 1e-9))[1], 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift.astype(np.int32), 0.5 * np.log2((r[:, 0] + 1.0) / err)


def folded(x: np.ndarray, valid: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The residuals of every frame under its predictor, folded to whole numbers from 0; 0 where there is none."""
    order = coefs.shape[1]
    out = np.zeros_like(x)
    for j in range(order):
        out[:, order:] += coefs[:, j, None] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    res = x - (out >> shift[:, None])
    res = (res << 1) ^ (res >> 31)
    res[:, :order] = 0
    return np.where(valid, res, 0)


def rough(u: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A near best Rice parameter for each frame."""
    return np.clip(np.frexp(np.maximum(u.sum(1, dtype=np.int64) * 0.6931 / n, 0.5))[1], 0, 13)


def frames(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all frames and the size of each. x: a row of samples a frame, 0 beyond those that count."""
    n, width = x.shape
    column = np.arange(width)
    valid = column[None] < sizes[:, None]
    constant = ((x == x[:, :1]) | ~valid).all(1)
    coefs, shift, gain = linear(x)
    lin = (gain * (sizes - ORDER) > ORDER * PRECISION + 9) & (sizes > ORDER)
    u = folded(x, valid, np.zeros((n, 0), np.int32), np.zeros(n, np.int32))
    u[lin] = folded(x[lin], valid[lin], coefs[lin], shift[lin])
    k = rough(u, sizes)
    exact = np.stack([(u >> j[:, None]).sum(1, dtype=np.int64) + sizes * (1 + j) for j in (np.maximum(k - 1, 0), k, k + 1)], 1)
    k, cost = np.maximum(k - 1 + exact.argmin(1), 0).astype(np.int32), exact.min(1) + lin * (ORDER * PRECISION + 9) + 10
    plain = (cost >= sizes * 8) & ~constant
    coded = ~plain & ~constant
    lin &= coded
    warm = np.where(lin, ORDER, 0)
    # Header fields of 8 bits, then the subframe's, then the samples', then padding and the checksum.
    lead = [np.full(n, 0xFF), np.full(n, 0xF8), np.full(n, 0x70), np.full(n, 0x02)]
    # The number's bytes as in UTF-8, up to six: so many lie after the first.
    after = sum((numbers >= least).astype(np.int64) for least in NUMBERED)
    first_byte = np.where(after == 0, numbers, (0xFF80 >> after) & 0xFF | numbers >> 6 * after)
    lead += [first_byte, *(0x80 | (numbers >> 6 * j) & 0x3F for j in range(4, -1, -1)), (sizes - 1) >> 8, (sizes - 1) & 0xFF]
    lead_on = np.stack([np.ones(n, bool)] * 5 + [after > j for j in range(4, -1, -1)] + [np.ones(n, bool)] * 2, 1)
    lead = np.stack(lead, 1)
    head = lead[lead_on].astype(np.uint8)
    head_sizes = lead_on.sum(1)
    crc8 = crcs(head, np.cumsum(head_sizes) - head_sizes, head_sizes, CRC8, 8)
    kind = np.where(constant, 0, np.where(plain, 1, np.where(lin, 32 + ORDER - 1, 8)))
    first = np.where(column[None, :ORDER] < warm[:, None], 8, 0)
    values = [lead, crc8[:, None], (kind << 1)[:, None], x[:, :ORDER] & 0xFF, np.full((n, 1), PRECISION - 1), shift[:, None], coefs & ((1 << PRECISION) - 1), np.zeros((n, 1), np.int64), k[:, None]]
    widths = [lead_on * 8, np.full((n, 2), 8), first, lin[:, None] * 4, lin[:, None] * 5, np.tile(lin[:, None] * PRECISION, (1, ORDER)), coded[:, None] * 6, coded[:, None] * 4]
    body = np.where(coded[:, None], (1 << k)[:, None] | (u & ((1 << k) - 1)[:, None]), x & 0xFF)
    size = np.where(coded[:, None], np.where(valid & (column[None] >= warm[:, None]), (u >> k[:, None]) + 1 + k[:, None], 0), np.where(plain[:, None], valid * 8, (column[None] == 0) * 8))
    values, widths = np.concatenate([*values, body], 1, dtype=np.int32, casting="unsafe"), np.concatenate([*widths, size], 1, dtype=np.int32, casting="unsafe")
    pad = -widths.sum(1) % 8
    values = np.concatenate([values, np.zeros((n, 2), np.int32)], 1)
    widths = np.concatenate([widths, pad[:, None], np.full((n, 1), 16)], 1, dtype=np.int32, casting="unsafe")
    lengths = widths.sum(1, dtype=np.int64) // 8
    data = packed(np.where(widths > 0, values, 0).ravel(), widths.ravel())
    starts = np.cumsum(lengths) - lengths
    crc = crcs(data, starts, lengths - 2, CRC16, 16)
    data[starts + lengths - 2], data[starts + lengths - 1] = crc >> 8, crc & 0xFF
    return data, lengths


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (one byte or more); a byte b is the sample b - 128."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    many = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    counts = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    joined, stops, written, lengths = np.frombuffer(b"".join(payloads), np.uint8), np.cumsum(counts), [], []
    for at in range(0, len(owner), FRAMES):
        n = counts[at : at + FRAMES]
        x = np.zeros((len(n), BLOCK), np.int32)
        x[np.arange(BLOCK)[None] < n[:, None]] = joined[stops[at] - n[0] : stops[at + len(n) - 1]].astype(np.int32) - 128
        data, length = frames(x, n, number[at : at + FRAMES])
        written.append(data.tobytes())
        lengths.append(length)
    lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    raw, out, at = b"".join(written), [], 0
    for i, p in enumerate(payloads):
        own = slice(at, at + int(many[i]))
        begin, stop = int(ends[at] - lengths[at]), int(ends[own.stop - 1])
        samples = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()  # two's complement of b - 128
        block = min(BLOCK, max(16, len(p)))
        info = struct.pack(">HH", block, block) + int(lengths[own].min()).to_bytes(3, "big") + int(lengths[own].max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points = np.empty(int(many[i]), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        points["sample"], points["offset"], points["n"] = number[own] * BLOCK, ends[own] - lengths[own] - begin, counts[own]
        table = points.tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + raw[begin:stop])
        at = own.stop
    return out


# Reading


def opened(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """Number of samples, MD5, seek points and where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", np.empty(0, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    while not last:
        kind, size = stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = stream[at] >> 7 == 1, stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed_info = int.from_bytes(body[10:18], "big")
            if (packed_info >> 36) & 0x1F != 7 or (packed_info >> 41) & 7:
                raise ValueError("not 8-bit mono")
            total, md5 = packed_info & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, points.dtype)
            points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
        at += 4 + size
    return total, md5, points, at


class Bits:
    """Bit positions of many frames read side by side."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """`width` (1 to 24) bits at each position, as integers."""
        word = self.words[at >> 3] << (at & 7).astype(np.uint32)
        return (word >> (32 - np.asarray(width)).astype(np.uint32)).astype(np.int32)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """The number of zero bits before the next one bit."""
        got = self.take(at, 24)
        # A float's exponent is the place of its highest bit; 0 has none and is looked at again further on.
        out = 150 - (got.astype(np.float32).view(np.int32) >> 23)
        open_ = np.flatnonzero(got == 0)
        if len(open_):
            out[open_] = 24 + self.zeros(at[open_] + 24)
        return out


BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}  # fixed values


def decoded_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of all frames, a row each, and how many of a row count. Checks both checksums of every frame."""
    bits, n = Bits(data), len(starts)
    if n == 0:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    if not ((data[starts] == 0xFF) & (data[starts + 1] >> 1 == 0x7C)).all():
        raise ValueError("a frame doesn't begin with its marker")
    lead = data[starts + 4].astype(np.int64)
    number = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, np.where(lead < 0xFC, 5, np.where(lead < 0xFE, 6, 7))))))
    code, rate = data[starts + 2] >> 4, data[starts + 2] & 15
    at = starts + 4 + number
    size = np.array([BLOCK_CODES.get(c, 0) for c in range(16)])[code]
    size = np.where(code == 6, data[at] + 1, np.where(code == 7, data[at].astype(np.int64) * 256 + data[at + 1] + 1, size))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0)) + np.where(rate == 12, 1, np.where(rate > 12, 2, 0))
    if (crcs(data, starts, at - starts, CRC8, 8) != data[at]).any():
        raise ValueError("a frame header's checksum is wrong")
    if (crcs(data, starts, ends - starts - 2, CRC16, 16) != data[ends - 2] * np.uint32(256) + data[ends - 1]).any():
        raise ValueError("a frame's checksum is wrong")
    pos = (at + 1) * 8
    kind = bits.take(pos, 8)
    if (kind & 1).any() or (kind >> 7).any():
        raise ValueError("wasted bits aren't supported")
    kind, pos = kind >> 1, pos + 8
    lin, fixed, plain, constant = kind >= 32, (kind >= 8) & (kind <= 12), kind == 1, kind == 0
    if not (lin | fixed | plain | constant).all():
        raise ValueError("unknown subframe")
    order = np.where(lin, kind - 31, np.where(fixed, kind - 8, 0))
    width = int(size.max())
    out = np.zeros((width, n), np.int32)  # the n-th samples of all frames lie together

    def signed(v: np.ndarray, w: np.ndarray | int) -> np.ndarray:
        return v - ((v >> (w - 1)) << w)

    coefs, shift, top = np.zeros((max(1, int(order.max())), n), np.int32), np.zeros(n, np.int32), int(order.max())
    for j in range(top):
        on = np.flatnonzero(order > j)
        out[j, on], pos[on] = signed(bits.take(pos[on], 8), 8), pos[on] + 8
    on = np.flatnonzero(lin)
    precision = bits.take(pos[on], 4) + 1
    shift[on] = bits.take(pos[on] + 4, 5)
    pos[on] += 9
    for j in range(top):
        k = order[on] > j
        coefs[j, on[k]] = signed(bits.take(pos[on[k]], precision[k]), precision[k])
        pos[on[k]] += precision[k]
    for o in range(1, min(top, 4) + 1):
        for j, c in enumerate(FIXED[o]):
            coefs[j, fixed & (order == o)] = c
    once = np.flatnonzero(constant)
    out[:, once], pos[once] = signed(bits.take(pos[once], 8), 8)[None], pos[once] + 8
    coded = lin | fixed
    wide, parts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = np.flatnonzero(coded)
    wide[on], parts[on] = 4 + bits.take(pos[on], 2), bits.take(pos[on] + 2, 4)
    pos[on] += 6
    step, k, escape = size >> parts, np.zeros(n, np.int32), np.zeros(n, bool)
    by_size = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[by_size], -np.arange(width), side="left")
    for i in range(width):
        now = by_size[: alive[i]]
        raw = now[plain[now]]
        if len(raw):
            out[i, raw], pos[raw] = signed(bits.take(pos[raw], 8), 8), pos[raw] + 8
        now = now[coded[now] & (order[now] <= i)]
        new = now[(i == order[now]) | (i % step[now] == 0)]
        if len(new):
            k[new] = bits.take(pos[new], wide[new])
            pos[new] += wide[new]
            escape[new] = k[new] == (1 << wide[new]) - 1
            e = new[escape[new]]
            k[e], pos[e] = bits.take(pos[e], 5), pos[e] + 5
        e = now[escape[now]]
        if len(e):
            has = e[k[e] > 0]
            out[i, has] = signed(bits.take(pos[has], k[has]), k[has])
            pos[e] += k[e]
            rest = now[~escape[now]]
        else:
            rest = now
        if len(rest):
            p, kk = pos[rest], k[rest]
            q = bits.zeros(p)
            u = (q << kk) | np.where(kk > 0, bits.take(p + q + 1, np.maximum(kk, 1)), 0)
            out[i, rest], pos[rest] = (u >> 1) ^ -(u & 1), p + q + 1 + kk
        if top and len(now):
            sum_ = np.zeros(len(now), np.int32)
            for j in range(min(top, i)):
                sum_ += coefs[j, now] * out[i - 1 - j, now]
            out[i, now] += sum_ >> shift[now]
    if (-(-pos // 8) != ends - 2).any():
        raise ValueError("a frame ends early or late")
    return out.T, size


def decode(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams that have a seek point for every frame; every checksum is verified."""
    heads = [opened(s) for s in streams]
    base = np.cumsum([0, *(len(s) for s in streams)])
    starts = [b + at + points["offset"].astype(np.int64) for b, (_, _, points, at) in zip(base, heads, strict=False)]
    ends = [np.append(s[1:], base[i + 1]) for i, s in enumerate(starts)]
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    data, starts, ends, raw = np.frombuffer(b"".join(streams), np.uint8), flat(starts), flat(ends), []
    for at in range(0, len(starts), FRAMES):
        low, begin, stop = starts[at], starts[at : at + FRAMES], ends[at : at + FRAMES]
        rows, size = decoded_frames(data[low : stop[-1]], begin - low, stop - low)
        raw.append((rows[np.arange(rows.shape[1])[None] < size[:, None]] + 128).astype(np.uint8))
    raw, out, at = np.concatenate(raw) if raw else np.zeros(0, np.uint8), [], 0
    for total, md5, _, _ in heads:
        own = raw[at : at + total]
        if hashlib.md5((own ^ 0x80).tobytes()).digest() != md5:
            raise ValueError("the samples' MD5 is wrong")
        out.append(own.tobytes())
        at += total
    return out


def sample_range(stream: bytes, first: int, count: int) -> bytes:
    """`count` payload bytes from sample `first` on, decoding only the frames that hold them."""
    total, _, points, at = opened(stream)
    begin, stop = points["sample"].astype(np.int64), np.append(points["sample"][1:].astype(np.int64), total)
    own = np.flatnonzero((stop > first) & (begin < min(first + count, total)))
    if not len(own) or count <= 0:
        return b""
    starts = at + points["offset"].astype(np.int64)
    ends = np.append(starts[1:], len(stream))
    rows, size = decoded_frames(np.frombuffer(stream, np.uint8), starts[own], ends[own])
    raw = (rows[np.arange(rows.shape[1])[None] < size[:, None]] + 128).astype(np.uint8).tobytes()
    low = first - int(begin[own[0]])
    return raw[low : low + count]


# On Spark


def pieces(items: list[bytes]) -> Iterator[slice]:
    """Runs of items of at most CHUNK bytes together; a larger item is a run of its own."""
    at = 0
    while at < len(items):
        end, room = at, CHUNK
        while end < len(items) and (end == at or room >= len(items[end])):
            room -= len(items[end])
            end += 1
        yield slice(at, end)
        at = end


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def media(docs: DataFrame) -> DataFrame:
    """_id, n_bytes and media (the FLAC stream of the padded text) of every row."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        raw = [payload(t) for t in batch["text"]]
        streams = [s for part in pieces(raw) for s in encode(raw[part])]
        sizes = [len(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
        return pd.DataFrame({"_id": batch["_id"], "n_bytes": np.array(sizes, np.int64), "media": streams})

    return each_batch(keyed(docs).select("_id", "text"), step, "_id long, n_bytes long, media binary")


def blocks(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """The PCM blocks of decoded bytes: the first sample's offset and up to BLOCK signed 8-bit samples."""
    pcm = (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes()
    return ((at, pcm[at : at + BLOCK]) for at in range(0, len(pcm), BLOCK))


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """The PCM blocks of `media`'s rows: _id, block, first_sample, pcm (signed 8-bit samples)."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        rows, items = [], list(batch["media"])
        raw = [p for part in pieces(items) for p in decode(items[part])]
        for key, p in zip(batch["_id"], raw, strict=True):
            rows += [(key, k, at, pcm) for k, (at, pcm) in enumerate(blocks(p))]
        return pd.DataFrame(rows, columns=["_id", "block", "first_sample", "pcm"])

    return each_batch(stored.select("_id", "media"), step, "_id long, block long, first_sample long, pcm binary")


def feature(raw: bytes) -> str:
    """Loudness, peak and sign changes of the decoded samples."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"samples={len(x)};energy={int((x * x).sum())};peak={int(np.abs(x).max())};turns={turns}"


def media_report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    pcm_blocks and pcm_sha256 (of the PCM blocks, each after its first sample's offset in eight bytes).
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks", "pcm_sha256"]

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        items, rows = list(batch["media"]), []
        raw = [p for part in pieces(items) for p in decode(items[part])]
        for p, m in zip(raw, items, strict=True):
            n, pcm = 0, hashlib.sha256()
            for at, samples in blocks(p):
                n += 1
                pcm.update(at.to_bytes(8, "big") + samples)
            rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), n, pcm.hexdigest()))
        return pd.DataFrame(rows, columns=names[1:]).assign(_id=batch["_id"].to_numpy(), n_bytes=batch["n_bytes"].to_numpy())[["_id", *names]]

    kinds = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, pcm_sha256 string"
    return each_batch(media(docs), step, kinds).select(real_id("_id"), *names)
