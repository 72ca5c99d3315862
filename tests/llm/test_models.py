"""Quality, FLAC, neighbours, mixing and pieces: exact round trips, brute force and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import flac, mixing, neighbours, pieces, quality
from tests.llm.helpers import clashing, empty, odd

SF = "/root/testdata/sf0.01"


# Quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert len(rows) > 50 and right / len(rows) > 0.95


def test_quality_of_odd_rows(spark):
    df = clashing(odd(spark))
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (7, 0, 0), (None, 1, 1), (99, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scores(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.score for r in quality.scores(df, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == df.count()
    assert quality.scores(empty(spark), labels).count() == 0


def test_gradient_is_the_loss_derivative():
    rng = np.random.default_rng(0)
    x, many, y = rng.normal(size=(12, 5)), np.array([3, 1, 5, 3]), np.array([1.0, 0.0, 1.0, 0.0])
    quality_epochs, quality.EPOCHS = quality.EPOCHS, 1
    try:
        model = quality.train(x, many, y)
    finally:
        quality.EPOCHS = quality_epochs
    loss = lambda: np.mean(np.logaddexp(0, model.forward(x, many)[0]) - y * model.forward(x, many)[0])
    grads = quality.gradient(model, x, many, y)
    for name in ("encode", "v", "u", "a", "out"):
        w = model.w[name]
        i = tuple(0 for _ in w.shape)
        old = w[i]
        w[i] = old + 1e-5
        up = loss()
        w[i] = old - 1e-5
        down = loss()
        w[i] = old
        assert grads[name][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# FLAC


def payloads():
    rng = np.random.default_rng(0)
    return [b"a" * 64, bytes(64), rng.integers(0, 256, 5000, dtype=np.uint8).tobytes(), bytes(range(256)) * 10, b"\x00\xff" * 700, b"x", b"ab", b"abcd", b"\x00\xff\x00", ("text " * 3000).encode(), (np.sin(np.arange(4000) / 9) * 100 + 128).astype(np.uint8).tobytes()]


def test_flac_round_trip():
    raw = payloads()
    streams = flac.encode(raw)
    assert flac.decode(streams) == raw
    assert len(streams[-1]) < 0.7 * len(raw[-1])
    assert all(s[:4] == b"fLaC" for s in streams)
    long = raw[-2]
    for first, count in ((0, 10), (1000, 100), (1023, 2), (len(long) - 5, 50), (len(long), 5), (7, 0)):
        assert flac.sample_range(streams[-2], first, count) == long[first : first + count]


def test_flac_of_long_payloads_and_frame_numbers():
    raw = [np.random.default_rng(1).integers(97, 101, 5 * flac.CHUNK // 2, dtype=np.uint8).tobytes(), b"x" * 64]
    assert flac.decode(flac.encode(raw)) == raw
    x, size = np.zeros((1, flac.BLOCK), np.int32) + 5, np.array([flac.BLOCK])
    for number, lead in ((127, 1), (128, 2), (2047, 2), (2048, 3), (65535, 3), (65536, 4), (0x1FFFFF, 4), (0x200000, 5), (0x3FFFFFF, 5), (0x4000000, 6)):
        data, length = flac.frames(x, size, np.array([number]))
        coded = bytes(data[4 : 4 + lead])
        assert (coded.decode("utf-8") == chr(number)) if number < 0x110000 and not 0xD800 <= number < 0xE000 else (int.from_bytes(coded[-1:], "big") & 63) == number & 63
        assert (flac.decoded_frames(data, np.array([0]), length)[0] == 5).all()


@pytest.mark.parametrize("place", [-1, -40, 120, 60])
def test_flac_damage_is_found(place):
    stream = bytearray(flac.encode([("some text " * 100).encode()])[0])
    stream[place] ^= 4
    with pytest.raises((ValueError, IndexError)):
        out = flac.decode([bytes(stream)])
        assert out == [("some text " * 100).encode()] and place == 60
        raise ValueError("only the seek table or the header's figures were hit")


def test_other_frames_are_read():
    """A frame by hand: fixed order 2, two Rice partitions, one of them plain bits."""
    samples = [3, 5, 8, 10, 11, 13, 12, 9, 20, -20, 30, -30, 40, -40, 50, -50]
    res = [samples[i] - 2 * samples[i - 1] + samples[i - 2] for i in range(2, 16)]
    bits = "0" + "001010" + "0" + "".join(f"{s & 255:08b}" for s in samples[:2]) + "00" + "0001" + "0010"
    for r in res[:6]:
        u = r * 2 if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 2) + "1" + f"{u & 3:02b}"
    bits += "1111" + f"{10:05b}" + "".join(f"{r & 1023:010b}" for r in res[6:])
    bits += "0" * (-len(bits) % 8)
    head = bytes([0xFF, 0xF8, 0x60, 0x02, 0x00, 15])
    array = lambda b: np.frombuffer(b, np.uint8)
    head += bytes([int(flac.crcs(array(head), np.array([0]), np.array([len(head)]), flac.CRC8, 8)[0])])
    frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(flac.crcs(array(frame), np.array([0]), np.array([len(frame)]), flac.CRC16, 16)[0]).to_bytes(2, "big")
    got, size = flac.decoded_frames(array(frame), np.array([0]), np.array([len(frame)]))
    assert got[0].tolist() == samples and size.tolist() == [16]


def test_media_report(spark):
    df = odd(spark)
    got = flac.media_report(clashing(df)).collect()
    texts = {r.doc_id: r.text or "" for r in df.where("doc_id IS NOT NULL").collect()}
    for r in got:
        if r.doc_id is not None:
            p = flac.payload(texts[r.doc_id])
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == df.count() and flac.media_report(empty(spark)).count() == 0
    blocks = flac.pcm_blocks(flac.media(df.where("doc_id = 8"))).orderBy("block").collect()
    assert [b.first_sample for b in blocks] == list(range(0, 5056, flac.BLOCK))
    assert b"".join(bytes(b.pcm) for b in blocks) == bytes(x ^ 0x80 for x in flac.payload("x" * 5000))


# Neighbours


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = unit @ unit[q]
        near[q] = -2
        best = ids[np.lexsort((ids, -near))[:5]]
        mine = sorted(got[ids[q]])
        assert [k for k, _, _ in mine] == [1, 2, 3, 4, 5] and [s for _, _, s in mine] == sorted((s for _, _, s in mine), reverse=True)
        place = {v: i for i, v in enumerate(ids)}
        assert all(abs(near[place[v]] - s) < 1e-9 for _, v, s in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits / (5 * len(got)) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.5]
    rows = [(i, one, 0) for i in range(0, 30)] + [(50, two, 0), (100, None, 0), (150, [0.0, 0.0, 0.0], 0), (200, [1.0, None, 0.0], 0), (250, [float("nan"), 1.0, 0.0], 0), (300, [1.0], 0), (None, one, 0), (50, two, 0), (350, [float("inf"), 0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit("own")).withColumn("list", F.lit(1))
    got = sorted(tuple(r) for r in neighbours.search(df).collect())
    assert [(q, k, v) for q, k, v, _ in got if q == 0] == [(0, i, i) for i in range(1, 6)]
    assert [(k, v) for q, k, v, _ in got if q == 50] == [(i + 1, i) for i in range(5)]
    assert {q for q, *_ in got} == {0, 50}
    assert neighbours.search(df.limit(0)).count() == 0
    few = neighbours.search(spark.createDataFrame([(0, one), (1, two)], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]


def test_neighbours_of_several_sizes_and_tiny_components(spark):
    tiny = [1e-300, 2e-300, 0.0]
    rows = [(0, tiny), (1, [1.0, 2.0, 0.0]), (2, [0.0, 0.0, 1e300]), (50, [1.0, 1.0]), (51, [1.0, 0.9]), (52, [-1.0, 0.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 51), (50, 2, 52)]
    assert got[0][3] == pytest.approx(1) and got[1][3] == 0


# Mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == [200, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert sum(mixing.targets([10, 1000], [3, 1], 1515, 2)) == pytest.approx(1515)


def test_mix_is_near_its_targets_and_repeatable(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("source IN ('src0', 'src1', 'src2', 'src3')")
    rows = mixing.mix_report(df, 256, 20_000).collect()
    by = {}
    for r in rows:
        assert r.taken <= 2 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 1 for (_, target), t in by.items()) and len(by) == 4
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(df.repartition(7), 256, 20_000).collect()))
    taken = {}
    for r in mixing.mix(df, 256, 20_000).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + words(r.text)
    assert taken == {r.doc_id: r.taken for r in rows if r.taken}


def test_split_tree_sums_to_the_quotas():
    counts = np.array([100, 3, 0, 57])
    leaves = [mixing.split(counts, 7, i) for i in range(7)]
    assert sum(leaves).tolist() == counts.tolist() and max(x.sum() for x in leaves) - min(x.sum() for x in leaves) <= 1


def test_large_splits_and_leaves_before():
    counts = np.array([7 * 10**9, 0, 3 * 10**9 + 1, 5])
    leaves = [mixing.leaf(counts, 5, i) for i in range(5)]
    assert sum(x for x, _ in leaves).tolist() == counts.tolist() and all((x >= 0).all() for x, _ in leaves)
    assert [b.tolist() for _, b in leaves] == [sum((x for x, _ in leaves[:i]), np.zeros(4, np.int64)).tolist() for i in range(5)]
    assert all(abs(x[0] - counts[0] / 5) < 10**6 for x, _ in leaves)


def test_mix_keeps_rows_that_differ_in_another_column(spark):
    rows = [(1, "some words of one text", lang, "a", None) for lang in ("en", "fr", None)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, m map<string,int>"))
    assert {r.lang for r in out.collect()} == {"en", "fr", None}


def test_mix_of_odd_rows(spark):
    df = clashing(odd(spark))
    rows = mixing.mix_report(df.drop("size")).collect()
    assert len(rows) == df.count() and all(r.taken <= 2 * r["size"] for r in rows)
    out = mixing.mix(df)
    assert out.columns == df.columns and sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.mix_report(empty(spark)).count() == 0 == mixing.mix(empty(spark)).count()


# Pieces


TEXTS = ["", None, " ", "  a  b\n\tc 12345 x² y²... 😀é漢字 don't stop", "a" * 1000, " lead", "trail \n", "The quick brown fox, jumped; over 13 lazy dogs!", "naïve café — “quoted” text", "x" * 63, "y" * 62, "z" * 61, "ab" * 30]


@pytest.fixture(scope="module")
def reference():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.mark.parametrize("most", [pieces.DICTIONARY, 5])
def test_pieces_are_sentencepieces_own(spark, reference, most):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(odd(spark).where("doc_id IN (7, 9)").select(F.col("doc_id") + 100, "text").toDF("doc_id", "text"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r._id: np.frombuffer(r.ids, np.int32).tolist() for r in pieces.encoded(df, most=most).collect()}
    vocabulary = pieces.Vocabulary.load()
    assert got == {d: reference.encode(t) for d, t in texts.items()}
    assert {d: vocabulary.decode(i) for d, i in got.items()} == texts


def test_unigram_vocabularies_take_the_viterbi_path(spark, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            p.score = -float(8 + i % 5 - 2 * min(len(p.piece), 3))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = pieces.Vocabulary.load(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r._id: np.frombuffer(r.ids, np.int32).tolist() for r in pieces.encoded(df, path).collect()}
    score = lambda ids: sum(own.get_score(i) for i in ids)
    for d, t in enumerate(TEXTS):
        plain = [i for u in vocabulary.units(t or "") for i in vocabulary.encode_unit(u)]
        assert got[d] == plain
        if t and t.isascii() and "\n" not in t:
            assert score(got[d]) == pytest.approx(score(own.encode(t)))


def test_merges_that_make_a_passed_edge_fit(spark, tmp_path):
    """Better pieces whose parts are worse: a single sweep by score would leave them apart."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    longest = sorted((p for p in model.pieces if p.type == 1), key=lambda p: len(p.piece))
    for p, score in zip(longest, sorted((p.score for p in longest)), strict=True):
        p.score = score  # the longer, the better
    path = str(tmp_path / "late.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    vocabulary = pieces.Vocabulary.load(path)
    words = [w for t in TEXTS if t for w in vocabulary.units(t) if len(w) <= pieces.LONG]
    got = {r.unit: list(r.ids) for r in pieces.encoded_units(spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "unit string"), vocabulary).collect()}
    assert got == {w: vocabulary.encode_unit(w) for w in words}
    texts = [t for t in TEXTS if t and len(t) < 60]
    assert [own.encode(t) for t in texts] == [[i for u in vocabulary.units(t) for i in vocabulary.encode_unit(u)] for t in texts]


def test_rows_of_one_key_do_not_mix(spark, monkeypatch):
    """Every row with one key, as if all hashes met: gaps with two answers are encoded in place."""
    monkeypatch.setattr(pieces, "row_key", lambda: F.lit(1).cast("long"))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r._id: np.frombuffer(r.ids, np.int32).tolist() for r in pieces.encoded(df, most=3).collect()}
    vocabulary = pieces.Vocabulary.load()
    assert got == {d: [i for u in vocabulary.units(t or "") for i in vocabulary.encode_unit(u)] for d, t in enumerate(TEXTS)}


def test_piece_report_of_odd_rows(spark, reference):
    df = clashing(odd(spark))
    rows = pieces.piece_report(df).collect()
    assert len(rows) == df.count() and all(r.exact for r in rows)
    assert pieces.piece_report(empty(spark)).count() == 0
    assert pieces.tokenised(df).count() == df.count() and pieces.tokenised(empty(spark)).count() == 0
    assert [(r.n_pieces, list(r.ids), r.text) for r in pieces.tokenised(df.where("text IS NULL")).collect()] == [(0, [], "")] * 2
    out = pieces.tokenised(df.where("doc_id = 1")).first()
    assert out.ids == reference.encode(out.text) and out.n_pieces == len(out.ids)


@pytest.mark.parametrize("at_once", [1, pieces.FILLED])
def test_gaps_are_filled_as_columns(monkeypatch, at_once):
    """Answers stay Arrow columns and rows come out some at a time; missing, double and needless answers are encoded in place."""
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(pieces, "FILLED", at_once)
    vocabulary = pieces.Vocabulary.load()
    known = [" the", ",", " lazy"]
    ids = [vocabulary.encode_unit(u.replace(" ", pieces.SPACE)) for u in known]
    d = pieces.Dictionary(np.cumsum([0, *map(len, ids)]), np.array(sum(ids, []), np.int32))
    texts = ["", *filter(None, TEXTS), "the lazy, the lazy", "the " + "q" * 70 + " odd, the odd"]
    parts = [pieces.packed(i, t, vocabulary, {u: n for n, u in enumerate(known, 1)}, zstandard.ZstdCompressor().compress) for i, t in enumerate(texts)]
    found = [[[k, *vocabulary.encode_unit(u.decode())] for k, u in enumerate(p[2:]) if u] or None for p in parts]
    found[2] = None
    found[3] = [*(found[3] or ()), [0, 7], [0, 8], [99, 5]]
    groups = list(pieces.filled(parts, pa.array(found, pa.list_(pa.list_(pa.int32()))), vocabulary, d))
    assert [p for rows, _ in groups for p in rows] == parts and (len(groups) > 1) == (at_once == 1)
    got = [i.values[a:b].tolist() for _, i in groups for a, b in zip(i.starts, i.starts[1:], strict=False)]
    assert got == [[i for u in vocabulary.units(t) for i in vocabulary.encode_unit(u)] for t in texts]
    assert [t for _, i in groups for t in vocabulary.decoded(i)] == texts
    assert [bytes(raw) for _, i in groups for raw in i.joined(vocabulary.spellings[1])] == ["".join(f"{n}," for n in g).encode() for g in got]


def test_the_dictionary_is_not_made_from_the_drivers_rows(spark, monkeypatch):
    """Only the vocabulary's own table goes from the driver to tasks, however many units there are; numbers go by frequency, then unit."""
    made, create = [], type(spark).createDataFrame
    df = spark.createDataFrame([(i, 0, f"w{i % 1999}x, " * 3 + f"v{i}y ok") for i in range(4000)], "_id long, _th long, text string")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(data) or create(self, data, *a, **k))
    vocabulary = pieces.Vocabulary.load()
    names, d = pieces.dictionary(df, vocabulary, 900)
    assert [len(rows) for rows in made] == [len(vocabulary.pieces)]
    units = Counter(u.replace(" ", pieces.SPACE) for r in df.collect() for u in vocabulary.spaced_units(r.text))
    assert [u.replace(" ", pieces.SPACE) for u in names.numbers] == sorted(units, key=lambda u: (-units[u], u.encode()))[:900]
    assert [d.ids[a:b].tolist() for a, b in zip(d.starts, d.starts[1:], strict=False)] == [vocabulary.encode_unit(u.replace(" ", pieces.SPACE)) for u in names.numbers]
