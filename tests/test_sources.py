import json

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.sources import golden, media, ocr, payloads


def rows(spark, payload):
    return spark.createDataFrame([("d", json.dumps(payload))], "document_id string, payload string")


def test_media_types_come_from_bytes(spark, tmp_path):
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.txt": b"plain", "c.tif": b"MM\x00*rest", "d.png": b"\x89PNG\r\n\x1a\n"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: (r.media_type, r.refusal) for r in media.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.txt": (None, "unrecognized"), "c.tif": ("image/tiff", "mime_type"), "d.png": ("image/png", None)}


def test_page_windows(spark):
    df = media.page_windows(spark.createDataFrame([("a", 5), ("b", 2)], "path string, pages int"), "pages", 2)
    assert sorted((r.path, r.first_page, r.page_count) for r in df.collect()) == [("a", 0, 2), ("a", 2, 2), ("a", 4, 1), ("b", 0, 2)]


def test_layout_analysis(spark):
    word = lambda text, at, x: {"content": text, "polygon": [x, 1, x + 1, 1, x + 1, 2, x, 2], "confidence": 0.9, "span": {"offset": at, "length": len(text)}}
    cell = lambda r, c, **more: {"rowIndex": r, "columnIndex": c, "content": "x", "spans": [{"offset": 0, "length": 1}], **more}
    payload = {
        "content": "Hello world\nBye\nNext\n",
        "pages": [
            {"pageNumber": 1, "width": 10, "height": 5, "spans": [{"offset": 0, "length": 16}], "words": [word("Hello", 0, 1), word("world", 6, 3), word("Bye", 12, 1)], "lines": [{"spans": [{"offset": 0, "length": 11}]}, {"spans": [{"offset": 12, "length": 3}]}]},
            {"pageNumber": 2, "width": 10, "height": 5, "spans": [{"offset": 16, "length": 4}], "words": [word("Next", 16, 1)], "lines": [{"spans": [{"offset": 16, "length": 4}]}]},
        ],
        "tables": [{"rowCount": 1, "columnCount": 2, "cells": [cell(0, 0, columnSpan=2), cell(0, 1), cell(1, 0, spans=[])]}],
    }
    got = ocr.layout_tokens(rows(spark, payload)).orderBy("span_start").collect()
    assert [(r.page_index, r.line, r.word) for r in got] == [(0, 0, "Hello"), (0, 0, "world"), (0, 1, "Bye"), (1, 0, "Next")]
    assert (got[0].x0, got[0].y0, got[0].x1, got[0].y1) == (0.1, 0.2, 0.2, 0.4)
    assert [(r.span_start, r.span_end) for r in ocr.layout_pages(rows(spark, payload)).orderBy("page_index").collect()] == [(0, 16), (16, 21)]
    cells = ocr.layout_cells(rows(spark, payload))
    assert [r.refusal for r in cells.orderBy("row", "col").collect()] == [None, None, "cell_without_span"]
    assert [(r.row, r.col) for r in ocr.clashes(cells).collect()] == [(0, 1)]


def vision_word(text, end=None):
    symbols = [{"text": c} for c in text]
    if end:
        symbols[-1]["property"] = {"detectedBreak": {"type": end}}
    return {"symbols": symbols, "confidence": 0.5, "boundingBox": {"vertices": [{"x": 10, "y": 20}, {"x": 30, "y": 40}]}}


def test_text_annotation(spark):
    paragraphs = [{"words": [vision_word("ab"), vision_word("cd", "LINE_BREAK"), vision_word("ef")]}, {"words": [vision_word("gh")]}]
    payload = {"fullTextAnnotation": {"pages": [{"width": 100, "height": 100, "blocks": [{"paragraphs": paragraphs}]}]}}
    got = ocr.vision_tokens(rows(spark, payload)).orderBy("ord").collect()
    assert [(r.line, r.word) for r in got] == [(0, "ab"), (0, "cd"), (1, "ef"), (2, "gh")]
    assert (got[0].x0, got[0].y1) == (0.1, 0.4)
    assert ocr.vision_refusals(rows(spark, payload)).count() == 0


@pytest.mark.parametrize(("payload", "reason"), [({"error": {"code": 16}}, "auth"), ({"error": {"code": 8}}, "rate_limit"), ({"error": {"code": 2}}, "service"), ({"fullTextAnnotation": {"pages": []}}, "empty_result")])
def test_text_annotation_refusals(spark, payload, reason):
    assert ocr.vision_refusals(rows(spark, payload)).first().reason == reason


def test_recognised_lines_on_a_turned_page(spark):
    page = {"prunedResult": {"rec_texts": ["one", "two"], "rec_boxes": [[10, 10, 20, 20], [0, 0, 50, 100]], "rec_scores": [0.9, 0.8], "doc_preprocessor_res": {"angle": 90}}}
    none = {"prunedResult": {"rec_texts": [], "rec_boxes": [], "rec_scores": []}}
    payload = {"errorCode": 0, "result": {"dataInfo": {"pages": [{"width": 100, "height": 50}, {"width": 1, "height": 1}]}, "ocrResults": [page, none]}}
    got = ocr.line_tokens(rows(spark, payload)).orderBy("line").collect()
    assert [(r.word, r.viewer_angle) for r in got] == [("one", 270), ("two", 270)]
    assert (got[1].x1, got[1].y1) == (1.0, 1.0)


def test_uneven_pages_are_refused_and_do_not_vanish(spark):
    page = {"prunedResult": {"rec_texts": ["one"], "rec_boxes": [[0, 0, 1, 1]], "rec_scores": [0.9]}}
    odd = {"prunedResult": {"rec_texts": ["x"], "rec_boxes": [], "rec_scores": [0.1]}}
    size = {"width": 10, "height": 10}
    answer = lambda pages, sizes, code=0: {"errorCode": code, "result": {"dataInfo": {"pages": sizes}, "ocrResults": pages}}
    for payload, reason in [(answer([page, odd], [size, size]), "uneven_page"), (answer([page], [size, size]), "page_count"), (answer([], []), "empty_result"), (answer([page], [size], 500), "service"), ({"errorCode": 0}, "empty_result")]:
        assert [r.reason for r in ocr.line_refusals(rows(spark, payload)).collect()] == [reason]
        assert ocr.line_tokens(rows(spark, payload)).collect() == []
    assert ocr.line_refusals(rows(spark, answer([page], [size]))).collect() == []


def test_rotated_boxes(spark):
    box = F.struct(F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(3.0).alias("x1"), F.lit(5.0).alias("y1"))
    df = spark.range(1).select(*(T.displayed_box(box, F.lit(10.0), F.lit(20.0), F.lit(r)).alias(f"r{r}") for r in (0, 90, 180, 270, 45)))
    r = df.first()
    assert tuple(r.r0) == (1, 15, 3, 18) and tuple(r.r90) == (2, 1, 5, 3) and tuple(r.r180) == (7, 2, 9, 5) and tuple(r.r270) == (15, 7, 18, 9) and r.r45 is None


def test_payloads_are_read_strictly(spark):
    payload = {"total": "12.50", "when": "2026-1-1", "ok": True, "items": [{"n": 1}, {"n": "x"}, {}]}
    df = payloads.flattened(rows(spark, payload), ["document_id"], {"total": "decimal", "when": "date", "ok": "boolean", "items[].n": "int"})
    got = {r.field_path: (r.value, r.present) for r in df.collect()}
    assert got["total"][1] and got["when"] == (None, False) and got["ok"] == ("true", True)
    assert got["items[0].n"] == ("1", True) and not got["items[1].n"][1] and not got["items[2].n"][1]


def test_labelled_sets(spark, tmp_path):
    docs = [{"document_id": "a", "blob_sha256": "1", "tier": "public", "schema_identity": "s@1", "declared_label_count": 2}, {"document_id": "b", "blob_sha256": "2", "tier": "restricted", "schema_identity": "s@1", "declared_label_count": 1}]
    (tmp_path / "manifest.json").write_text(json.dumps({"documents": docs}))
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.json").write_text(json.dumps({"document_id": "a", "labels": [{"field_path": "x", "expectation": "value", "value": "1", "type": "int"}] * 2}))
    listed, given = golden.manifest(spark, str(tmp_path / "manifest.json")), golden.labels(spark, str(tmp_path / "labels"))
    assert sorted((r.document_id, r.problem) for r in golden.problems(listed, given).collect()) == [("a", "repeated_label"), ("b", "label_count")]
    bundle = spark.createDataFrame([("2", "y", "absent", None, "int")], "blob_sha256 string, field_path string, expectation string, value string, type string")
    assert golden.restricted(listed, bundle).first().document_id == "b"
    golden.write_predictions(given, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_path_keys_sort_indices_by_number(spark):
    paths = ["items[10].a", "items[2].a", "items.b", "total"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.orderBy(T.path_key(F.col("p"))).collect()] == ["items[2].a", "items[10].a", "items.b", "total"]
    assert df.select(T.slot(F.col("p")), T.strip_indices(F.col("p"))).first() == ("items[].a", "items.a")


def test_layout_analyses_are_refused_whole(spark):
    word = lambda at, x=1: {"content": "ab", "polygon": [x, 1, x + 1, 1, x + 1, 2, x, 2], "span": {"offset": at, "length": 2}}
    page = lambda *words, number=1: {"pageNumber": number, "width": 10, "height": 5, "spans": [{"offset": 0, "length": 5}], "words": list(words), "lines": []}
    place = [{"offset": 0, "length": 2}]
    of = lambda *pages, **table: {"content": "ab ab", "pages": list(pages), "tables": [{"boundingRegions": [{"pageNumber": 1}], "spans": place, "cells": []} | table] if table else []}
    cell = {"rowIndex": 0, "columnIndex": 0, "content": "c"}
    for payload, reason in [
        (of(), "empty_result"), (of(page(word(0), word(1))), "invalid_order"), (of(page(word(3)), page(word(0), number=2)), "invalid_order"), (of(page(word(0), word(3, 9.5))), "outside_page"),
        (of(page(word(0) | {"polygon": []})), "outside_page"), (of(page(word(0)), spans=[]), "table_without_span"), (of(page(word(0)), cells=[cell]), "cell_without_span"),
        (of(page(word(0)), boundingRegions=[{"pageNumber": 7}]), "table_page"), (of(page(word(0)), boundingRegions=[]), "table_page"),
    ]:
        assert [r.reason for r in ocr.layout_refusals(rows(spark, payload)).collect()] == [reason]
        assert ocr.layout_tokens(rows(spark, payload), whole=True).collect() == []
    good = of(page(word(0), number=4), page(word(3, 9.05), number=1), cells=[cell | {"spans": place}])
    assert ocr.layout_refusals(rows(spark, good)).collect() == []
    assert [(r.page_index, r.x1) for r in ocr.layout_tokens(rows(spark, good), whole=True).orderBy("page_index").collect()] == [(0, 0.2), (1, 1.0)]
    assert [r.page_index for r in ocr.layout_cells(rows(spark, good), whole=True).collect()] == [1]
    assert ocr.layout_refusals(rows(spark, {"content": "", "pages": []})).collect() == []


def test_annotated_words_need_a_box_on_their_page(spark):
    of = lambda box: {"fullTextAnnotation": {"pages": [{"width": 100, "height": 100, "blocks": [{"paragraphs": [{"words": [vision_word("ab"), vision_word("cd") | {"boundingBox": box}]}]}]}]}}
    for box, reason in [({}, "word_without_box"), ({"vertices": []}, "word_without_box"), ({"vertices": [{"x": 10}, {"x": 150, "y": 5}]}, "outside_page"), ({"normalizedVertices": [{"x": 0.1}, {"x": 0.5, "y": -0.2}]}, "outside_page")]:
        assert [r.reason for r in ocr.vision_refusals(rows(spark, of(box))).collect()] == [reason]
        assert ocr.vision_tokens(rows(spark, of(box)), whole=True).collect() == []
    good = rows(spark, of({"normalizedVertices": [{"x": 0.5}, {"x": 0.75, "y": 0.25}]}))
    assert ocr.vision_refusals(good).collect() == []
    assert [(r.x0, r.y0, r.x1, r.y1) for r in ocr.vision_tokens(good, whole=True).where("word = 'cd'").collect()] == [(0.5, 0.0, 0.75, 0.25)]


def test_recognised_lines_of_an_image_and_without_lines(spark):
    page = lambda texts, boxes: {"prunedResult": {"rec_texts": texts, "rec_boxes": boxes, "rec_scores": [0.5] * len(texts)}}
    answer = lambda p, info: {"errorCode": 0, "result": {"dataInfo": info, "ocrResults": [p]}}
    image = {"type": "image", "width": 20, "height": 10}
    assert [(r.x1, r.y1) for r in ocr.line_tokens(rows(spark, answer(page(["a"], [[0, 0, 10, 5]]), image))).collect()] == [(0.5, 0.5)]
    for payload, reason in [(answer(page([], []), image), "empty_result"), (answer(page(["a"], [[0, 0, 10, 15]]), image), "outside_page"), (answer(page(["a"], [[0, 0]]), image), "outside_page"), (answer(page(["a"], [[0, 0, 1, 1]]), {"type": "other"}), "page_count")]:
        assert [r.reason for r in ocr.line_refusals(rows(spark, payload)).collect()] == [reason]
        assert ocr.line_tokens(rows(spark, payload)).collect() == []


def test_an_answer_that_is_no_json(spark):
    bad = spark.createDataFrame([("d", None)], "document_id string, payload string")
    for f in (ocr.layout_refusals, ocr.vision_refusals, ocr.line_refusals):
        assert [r.reason for r in f(bad).collect()] == ["not_json"]
