"""Recognition answers are made and read within their rows."""

import json

import pyarrow as pa

from folio.plans import recognition as R
from folio.sources import ocr

SF = "/root/testdata/sf0.001"


def test_nothing_is_shuffled(spark):
    for run in (R.annotated_words, R.annotation_refusals, R.layout_words, R.layout_table_cells, R.layout_refusals):
        plan = run(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan, run.__name__


def test_starts_of_words_in_slices_of_batches():
    lengths = pa.array([[9], [1, 2, 3], [], [4], [2, 2]], pa.list_(pa.int32()))
    assert R.starts(lengths).to_pylist() == [[0], [0, 2, 5], [], [0], [0, 3]]
    assert R.starts(lengths.slice(1, 3)).to_pylist() == [[0, 2, 5], [], [0]]
    assert R.starts(lengths.slice(2, 1)).to_pylist() == [[]]


def test_lines_end_by_breaks_and_paragraphs(spark):
    def word(text, end=None):
        return {"symbols": [{"text": c} for c in text[:-1]] + [{"text": text[-1]} | ({"property": {"detectedBreak": {"type": end}}} if end else {})], "boundingBox": {"vertices": [{"x": 1}, {"x": 2, "y": 1}]}}

    blocks = [{"paragraphs": [{"words": [word("ab", "LINE_BREAK"), word("c", "SPACE"), word("d")]}, {"words": []}, {"words": None}]}, {}, {"paragraphs": [{"words": [{"symbols": []}, word("e", "EOL_SURE_SPACE")]}]}]
    pages = [{"width": 10, "height": 10, "blocks": blocks}, {"width": 10, "height": 10}, {"width": 10, "height": 10, "blocks": blocks[:1]}]
    rows = spark.createDataFrame([(1, json.dumps({"fullTextAnnotation": {"pages": pages}}))], "document_id int, payload string")
    got = sorted((r.page_index, r.ord, r.line, r.word) for r in ocr.vision_tokens(rows).collect())
    first = [(0, 0, "ab"), (1, 1, "c"), (2, 1, "d")]
    assert got == [(0, *x) for x in [*first, (3, 2, ""), (4, 2, "e")]] + [(2, *x) for x in first]
