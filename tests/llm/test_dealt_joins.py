"""Tables that grow with the input are joined by their keys: none is sent whole to all tasks, however small Spark takes it for."""

from folio.llm import common, lines, mixing, pieces, simhash

SF = "/root/testdata/sf0.001"


def plans_of(monkeypatch, run) -> list[str]:
    """The plans of all checkpoints that `run` makes, and of its result."""
    plans, whole = [], common.checkpoint

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df)

    for module in (common, lines, simhash, pieces):
        monkeypatch.setattr(module, "checkpoint", noted)
    plans.append(run()._jdf.queryExecution().executedPlan().toString())
    return plans


def sent(plans: list[str]) -> list[str]:
    return [x for plan in plans for x in plan.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


def test_links_and_their_components_are_dealt(spark, monkeypatch):
    fps = spark.range(500).selectExpr("xxhash64(id div 4) ^ shiftleft(1L, cast(id % 4 as int)) AS fp")
    assert sent(plans_of(monkeypatch, lambda: simhash.components(simhash.links(fps)))) == []


def test_reports_and_stages_of_dedup_are_dealt(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for run in (simhash.simhash, simhash.near_dedup):
        assert sent(plans_of(monkeypatch, lambda: run(docs))) == [], run.__name__  # noqa: B023
    for run in (lines.line_report, lines.line_dedup):
        # One broadcast has at most 4,096 rows.
        assert all("_one" in x for x in sent(plans_of(monkeypatch, lambda: run(docs)))), run.__name__  # noqa: B023


def test_the_mix_joins_texts_by_key(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all("_source" in x for x in sent(plans_of(monkeypatch, lambda: mixing.mix(docs))))
