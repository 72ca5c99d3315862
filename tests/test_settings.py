import datetime as dt
import hashlib
import json

import pytest

from folio.functions import canonical
from folio.operators import declared
from folio.plans.declared import SCHEMA
from folio.sources import settings


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_limits(spark, tmp_path):
    path = write(tmp_path / "limits.json", {"default": {"runs": 5}, "tenants": {"a": {"tokens": 7}}})
    assert sorted(map(tuple, settings.limits(spark, path).collect()), key=str) == sorted([(None, None, 5, None, None), ("a", None, None, 7, None)], key=str)
    for wrong in ({"other": {}}, {"default": {"pages": 1}}):
        with pytest.raises(ValueError, match="unknown"):
            settings.limits(spark, write(tmp_path / "wrong.json", wrong))


def test_policy(tmp_path):
    got = settings.policy(write(tmp_path / "p.json", {"version": "2", "required_fields": ["total"]}))
    assert got.version == "2" and got.required_fields == ("total",) and got.review_on_error_finding
    with pytest.raises(ValueError, match="unknown"):
        settings.policy(write(tmp_path / "q.json", {"version": "2", "colour": 1}))


def test_canned_answers(spark, tmp_path):
    path = write(tmp_path / "c.json", {"order@1": {"payload": {"a": 1}}, "order@2": {"mode": "malformed"}, "order@3": {"mode": "refusal"}})
    asked = spark.createDataFrame([(i, f"order@{i}") for i in (1, 2, 3, 4)], "document_id int, schema_identity string")
    got = {r.document_id: (r.payload, r.failure) for r in settings.answered(asked, settings.canned(spark, path)).collect()}
    assert got == {1: ('{"a": 1}', None), 2: ("{", None), 3: (None, "refusal"), 4: (None, "no_response")}


def test_prediction_set(spark, tmp_path):
    one = {"document_id": "d1", "schema_identity": "order@1", "values": [{"field_path": "total", "value": "3", "type": "int"}]}
    write(tmp_path / "d1.json", one)
    write(tmp_path / "d2.json", {"document_id": "d2", "failed_stage": "parse"})
    write(tmp_path / "recorder.json", {"recorder": "x"})
    rows, values = settings.prediction_set(spark, str(tmp_path))
    assert sorted((r.document_id, r.failed_stage) for r in rows.collect()) == [("d1", None), ("d2", "parse")]
    assert [tuple(r) for r in values.collect()] == [("d1", "total", "3", "int")]
    write(tmp_path / "again.json", one)
    with pytest.raises(ValueError, match="d1"):
        settings.prediction_set(spark, str(tmp_path))


def test_canonical_json():
    assert canonical.canonical_json({"b": [1, 2.5, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null,true]}'.encode()
    for wrong in (float("nan"), {1: 2}, {"a": {1}}):
        with pytest.raises(ValueError, match="number|key|JSON"):
            canonical.canonical_json(wrong)
    other = {**SCHEMA, "fields": SCHEMA["fields"][::-1], "rules": SCHEMA["rules"][::-1]}
    assert canonical.schema_hash(SCHEMA) == canonical.schema_hash(other) == canonical.schema_hash({**SCHEMA, "name": "x", "version": 2})
    assert canonical.schema_hash(SCHEMA) != canonical.schema_hash({**SCHEMA, "fields": SCHEMA["fields"][1:]}) != canonical.schema_hash({**SCHEMA, "rules": []})
    assert canonical.prompt_hash("Read ﬁt") == "sha256:" + hashlib.sha256('{"prompt":"Read ﬁt"}'.encode()).hexdigest()
    with pytest.raises(ValueError, match="two keys"):
        canonical.canonical_json({"\u00e9": 1, "e\u0301": 2})
    assert canonical.schema_hash({"name": "a", "version": 1, "fields": [], "rules": []}) == canonical.schema_hash({"name": "a", "version": 1, "fields": []})
    assert canonical.extraction_options_hash(model_id="m") == canonical.extraction_options_hash(model_id="m", seed=None)
    with pytest.raises(ValueError, match="unknown"):
        canonical.extraction_options_hash(colour=1)


def test_rules_can_be_chosen(spark):
    documents = spark.createDataFrame([("d",)], "document_id string")
    values = spark.createDataFrame([("d", "total", "3"), ("d", "items[0].price", "1"), ("d", "items[1].price", "2.005")], "document_id string, field_path string, value string")
    rows = {r.check_id: r for r in declared.checked(values, documents, SCHEMA, ("adds_up",)).collect()}
    assert rows["adds_up"].outcome == "passed" and "duty" not in rows and rows["required:number"].outcome == "failed"
    assert rows["minimum:total"].outcome == "failed" and rows["minimum:total"].actual == "3" and "minimum:number" not in rows
    with pytest.raises(ValueError, match="unknown rules"):
        declared.checked(values, documents, SCHEMA, ("other",))


def test_sweeps_end_when_none_is_due(spark):
    from folio.operators import runs as R

    now = dt.datetime(2026, 1, 10)
    rows = [(i, ("succeeded", "failed", "queued")[i % 3], now - dt.timedelta(hours=i % 7 - 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "run_id long, status string, expires_at timestamp")
    pins = spark.createDataFrame([(i, now + dt.timedelta(days=1)) for i in range(0, 60, 10)], "run_id long, expires_at timestamp")
    whole = sorted(r.run_id for r in R.sweep(df, pins, now).collect())
    batches = [[r.run_id for r in b.collect()] for b in R.sweeps(df, pins, now, 7)]
    assert whole and sorted(sum(batches, [])) == whole and [len(b) for b in batches[:-1]] == [7] * (len(batches) - 1)
    assert list(R.sweeps(df.limit(0), pins, now, 7)) == []
