"""Folders of labelled sets: parsed in tasks, every authoring error a row."""

import copy
import json

import pytest

from folio.sources import labelled as L

DOC = {"document_id": "sha256:a", "blob_sha256": "a", "tier": "public", "origin": {"kind": "licensed", "basis": "terms"}, "schema_identity": "berth@1", "schema_hash": "h", "path": "a.pdf", "declared_label_count": 2}
LABEL = {"field_path": "ship", "expectation": "value", "value": "Ada"}
ABSENT = {"field_path": "left", "expectation": "absent", "value": None, "location": {"page": 0}}


def manifest(*documents, **more):
    return json.dumps({"documents": list(documents)} | more)


def test_a_good_manifest_and_good_labels():
    documents, keys, labels, refusals = L.parse_one("manifest", "manifest", manifest(DOC, entry_keys=[{"group_path": "loads", "key_field": "sku"}]))
    assert (documents, keys, labels, refusals) == ([("sha256:a", "a", "public", "berth@1", "a.pdf", 2, True)], [("loads", "sku")], [], [])
    assert L.parse_one("labels", "sha256_a", json.dumps([LABEL, ABSENT, LABEL | {"value": True}]))[2:] == (
        [("sha256_a", "ship", "value", "Ada", "string", True), ("sha256_a", "left", "absent", None, None, True), ("sha256_a", "ship", "value", "true", "boolean", True)], [],
    )
    assert L.parse_one("restricted", "restricted", json.dumps({"b": [LABEL]}))[2] == [("b", "ship", "value", "Ada", "string", True)]
    assert L.parse_one("manifest", "manifest", "{}") == ([], [], [], [])


@pytest.mark.parametrize(
    ("kind", "content", "refusal"),
    [
        ("manifest", None, (None, "", "not_json")), ("manifest", "[", (None, "", "not_json")), ("labels", "[" * 100_000, ("n", "", "not_json")), ("manifest", "[]", (None, "", "not_an_object")), ("labels", "{}", ("n", "", "not_a_list")),
        ("manifest", '{"documents":1}', (None, "documents", "not_a_list")), ("manifest", manifest(5), (None, "documents.0", "not_an_object")), ("manifest", manifest(DOC, entry_keys=[{}]), (None, "entry_keys.0.key_field", "missing_key")),
        ("manifest", manifest({k: v for k, v in DOC.items() if k != "tier"}), ("sha256:a", "tier", "missing_key")), ("manifest", manifest(DOC | {"tier": "x"}), ("sha256:a", "tier", "unknown_word")), ("manifest", manifest(DOC | {"mine": 1}), ("sha256:a", "mine", "unknown_key")),
        ("manifest", manifest(DOC | {"declared_label_count": True}), ("sha256:a", "declared_label_count", "wrong_type")), ("manifest", manifest(DOC | {"origin": {"kind": "licensed", "basis": " "}}), ("sha256:a", "origin.basis", "empty")),
        ("manifest", manifest(DOC | {"origin": {"kind": "synthetic", "basis": "b", "generator_id": "g"}}), ("sha256:a", "origin", "no_generator")), ("manifest", manifest(DOC | {"origin": {"kind": "found", "basis": "b"}}), ("sha256:a", "origin.kind", "unknown_word")),
        ("labels", json.dumps([LABEL | {"value": None}]), ("n", "ship", "no_value")), ("labels", json.dumps([ABSENT | {"value": 0}]), ("n", "left", "value_given")), ("labels", json.dumps([LABEL | {"expectation": "maybe"}]), ("n", "ship", "unknown_word")),
        ("labels", json.dumps([3]), ("n", "0", "not_an_object")), ("restricted", json.dumps({"b": 1}), ("b", "", "not_a_list")),
    ],
)
def test_errors_of_one_file(kind, content, refusal):
    assert refusal in L.parse_one(kind, "n", content)[3]


@pytest.mark.parametrize(
    ("declared", "fits", "unfit"),
    [
        ("string", ["a"], [1, True, {}]), ("boolean", [True], ["true", 1]), ("int", [1], [True, 1.5, "1"]), ("number", [1, 1.5], [True, "1"]), ("decimal", ["1", "-.5", "1.", "1e5", " 2 "], [1, 1.5, "x", "", "1,5"]),
        ("date", ["2024-02-29"], ["2023-02-29", "1.2.2024", "2024-02-29T01:00", 20240229]), ("datetime", ["2024-02-29", "2024-02-29T10:00:00+01:00", "2024-02-29 10:00"], ["2024-13-01T10:00", "now", 5]), ("money", [], ["1"]),
    ],
)
def test_values_that_a_type_can_hold(spark, declared, fits, unfit):
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    rows = [(text(v), L.value_kind(v), declared, fit) for vs, fit in ((fits, True), (unfit, False)) for v in vs]
    df = spark.createDataFrame(rows, "value string, kind string, declared string, fit boolean")
    got = df.select("value", "fit", L.carried(df["value"], df["kind"], df["declared"]).alias("got")).collect()
    assert [r for r in got if r["fit"] != r["got"]] == []


def written(root, documents, labels, bundle=None, **more):
    (root / "labels").mkdir(parents=True)
    (root / "manifest.json").write_text(manifest(*documents, **more))
    for name, given in labels.items():
        (root / "labels" / f"{name}.json").write_text(json.dumps(given))
    if bundle is not None:
        (root / "restricted.json").write_text(json.dumps(bundle))


def test_folders_of_sets(spark, tmp_path):
    secret = DOC | {"document_id": "s", "blob_sha256": "bs", "tier": "restricted", "path": None}
    keyed = [LABEL | {"field_path": f"loads[{i}].sku", "value": v} for i, v in enumerate(["k", "k"])]
    key = {"group_path": "loads", "key_field": "sku"}
    # A restricted document without its bundle is no error, nor a document without labels.
    written(tmp_path / "good", [DOC, secret, DOC | {"document_id": "none"}], {"sha256_a": [LABEL, ABSENT]}, entry_keys=[key])
    written(tmp_path / "whole", [secret], {"s": "not read"}, {"bs": [LABEL, ABSENT]})
    odd = copy.deepcopy(DOC) | {"document_id": "o", "path": ""}
    written(
        tmp_path / "bad", [DOC, DOC, odd, secret | {"path": "p"}], {"sha256_a": keyed, "o": [LABEL, LABEL | {"value": 1}, LABEL | {"field_path": "hue"}], "stranger": []},
        {"bs": [LABEL], "bx": [LABEL]}, entry_keys=[key, key | {"key_field": "ship"}],
    )
    facts = spark.createDataFrame([("berth@1", p, t) for p, t in (("ship", "string"), ("left", "date"), ("loads", "group"), ("loads.sku", "string"))], "schema_identity string, path string, type string")
    files = L.load(spark, str(tmp_path)).cache()
    rows = {(r["set_path"].rsplit("/", 1)[1], r["document_id"], r["at"], r["problem"]) for r in L.refusals(files, facts).collect()}
    assert rows == {("whole", "s", "", "not_a_list")} | {("bad", *r) for r in (
        ("sha256:a", None, "repeated_document"), ("o", "path", "public_without_path"), ("s", "path", "restricted_with_path"), ("stranger", None, "unknown_document"), (None, "bx", "unknown_blob"), ("s", None, "label_count"),
        ("o", None, "label_count"), ("o", "ship", "repeated_label"), ("o", "hue", "unresolved_path"), ("o", "ship", "value_not_carried"), (None, "loads", "repeated_key"), ("sha256:a", "loads.sku", "repeated_key_value"), (None, "loads.ship", "key_not_scalar"),
    )}
    assert {r["problem"] for r in L.refusals(files).collect()} & {"unresolved_path", "value_not_carried", "key_not_scalar"} == set()
    kept = L.accepted(files, facts)
    assert sorted((r["document_id"], r["field_path"]) for r in L.labels(kept).collect()) == [("sha256:a", "left"), ("sha256:a", "ship")]


def test_no_sets(spark):
    none = L.parsed(spark.createDataFrame([], "path string, content string, labels int"))
    assert L.refusals(none).count() == 0 and L.accepted(none).count() == 0


def test_what_grows_with_the_sets_is_dealt_by_key(spark):
    """Only the declared fields of schemas are sent whole: no table of files, documents or labels."""
    from folio.plans import labelled as P

    sf = "/root/testdata/sf0.001"
    got = P.parsed(spark, sf)
    for df in (L.refusals(got, P.facts(spark)), L.labels(L.accepted(got, P.facts(spark))), P.labelled_documents(spark, sf)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
        assert all("[schema_identity" in x for x in joins), joins
