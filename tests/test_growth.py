"""Faults that show only at size: shared caches, task counts, generated code that is not compiled."""

import pytest
from pyspark.sql import functions as F

from vitalcells.operators import glm as G
from vitalcells.operators.cells import collapse
from vitalcells.registry.models_q import SETTINGS
from vitalcells.sources import star_births
from vitalcells.storage import cached

# The JVM does not compile longer methods.
COMPILED = 8000


def longest_method(spark, df) -> int:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        code = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        return max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_records_are_stored_unsorted_and_without_categories(spark, space):
    files = space.cohort.inputFiles()
    assert not any("regiao=" in f for f in files)
    stored = spark.read.parquet(*files)
    assert not {"raca", "idade_cat", "parid_known"} & set(stored.columns)
    assert {"raca", "idade_cat", "parid_known", "regiao", "in_sens_var"} <= set(space.cohort.columns)


def test_a_cached_table_stays_while_another_holder_works_on_it(spark):
    def table():
        return spark.range(10).where("id % 3 = 1")

    first, second = table(), table()
    with cached(first):
        with cached(second):
            second.count()
        assert first.storageLevel.useMemory
    assert not table().storageLevel.useMemory


@pytest.mark.parametrize("cells, tasks", [(100, 1), (50_000, 3)])
def test_cells_are_dealt_to_the_tasks_they_need(spark, monkeypatch, cells, tasks):
    seen = []
    fit = G._fit
    monkeypatch.setattr(G, "_fit", lambda data, *more: seen.append(data.rdd.getNumPartitions()) or fit(data, *more))
    rows = spark.createDataFrame([("Branca", 3, 10), ("Preta", 4, 9), ("Preta", 1, 3)], "raca string, succ bigint, n bigint")
    result = G.fit(rows, G.Model("m", ("raca",)), most_cells=cells)
    assert seen == [tasks] and result.n == 22


def test_cross_sums_of_the_largest_model_are_compiled(spark, space, monkeypatch):
    """Pairs are not written out one by one: the code of a pass over the cells has to stay short."""
    run, task = space.run(national=True), SETTINGS.ladder()[-1]
    coding = G.Coding(task.model, run._levels_of(task))
    data = coding.apply(collapse(run.cells_of(task), *task.model.keys), "succ", "n").localCheckpoint()
    plans = []
    frame = type(data)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df) or collect(df))
    sums, _ = coding.cross_sums(data, {"n": "n", "succ": "succ", "hc0": "n * n", "x": "succ * n", "y": "n + 1"})
    monkeypatch.undo()
    assert longest_method(spark, plans[0]) < COMPILED
    total = data.agg(F.sum("n"), F.sum("succ")).first()
    assert (sums["n"][0, 0], sums["succ"][0, 0]) == tuple(total)
    first = coding.first[1]
    by_race = {r.raca: r.n for r in data.groupBy("raca").agg(F.sum("n").alias("n")).collect()}
    assert [sums["n"][0, first + i] for i in sorted(by_race)] == [by_race[i] for i in sorted(by_race)]


def test_cluster_scores_of_the_largest_model_are_compiled(spark, space, monkeypatch):
    """Reading categories, numbering levels and scoring them do not share one method."""
    run, task = space.run(national=True), SETTINGS.or_vs_rr()[-1]
    plans = []
    frame = type(run.rows)
    collect = frame.collect
    cluster = G._cluster

    def seen(*args):
        with monkeypatch.context() as patch:
            patch.setattr(frame, "collect", lambda df: plans.append(df) or collect(df))
            return cluster(*args)

    monkeypatch.setattr(G, "_cluster", seen)
    fit = G.fit(run.cells_of(task), task.model, rows=run.rows_of(task))
    assert set(fit.standard_errors["cluster"]) and len(plans) == 1
    assert longest_method(spark, plans[0]) < COMPILED


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_records_are_shuffled_for_orders_and_parts_only(spark):
    """Customers join the orders; tables that outgrow a broadcast add no shuffle of the records for them."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        plan = star_births.births_raw(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
        shuffled = [n for n in nodes(plan) if n.nodeName() == "Exchange" and "l_linenumber" in n.output().toString()]
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert len(shuffled) == 2


def test_codes_are_not_cleaned_again_by_a_filter(spark, space):
    """A join on a code that may be null makes Spark test it on the raw text, cleaned anew at each use."""
    plan = space.births()._jdf.queryExecution().optimizedPlan()
    assert not [n for n in nodes(plan) if n.nodeName() == "Filter" and "trim(" in n.condition().toString()]
    assert longest_method(spark, space.births()) < 6500
