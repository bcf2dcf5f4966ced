"""The report queries hold what the report has, not only what their SQL checks."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_cohort import COLUMNS
from test_models import dense

from vitalcells import fixed_values as V
from vitalcells.operators import glm as G
from vitalcells.registry import base
from vitalcells.registry import reports_q as Q
from vitalcells.sources import star_births as S
from vitalcells.storage import Store


def test_whole_numbers_have_all_samples_variables_and_exclusions(space):
    odds = space.spark.createDataFrame(
        [], "modelo string, grupo string, estimativa double, ic_low double, ic_high double")
    found = Q.consolidated(space, odds, whole=True).where(F.col("secao") != "pendencias").collect()
    names = {(r.secao, r.metrica) for r in found}
    assert {m for s, m in names if s == "amostras"} == set(Q.REPORTED_SAMPLES)
    assert {("missing", label) for label in V.MISSING_LABELS.values()} <= names
    assert {m for s, m in names if s == "incluidos_excluidos"} == {
        "n", "ptb_pct", "raca_indigena_pct", "raca_outra_missing_pct"}
    edges = {r.metrica: r for r in found if r.metrica in ("raca_minimo", "raca_maximo")}
    assert len(edges) == 2 and edges["raca_minimo"].valor <= edges["raca_maximo"].valor
    assert all(r.chave.split()[-1].isdigit() for r in edges.values())


class OwnRecords(base.Workspace):
    """Made records of three states, with unknown and missing codes that the teams treat differently."""

    focus_states = []

    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.store = Store(spark, f"{folder}/store", [], "own records")

    def births(self, keep=()):
        draw = random.Random(3)

        def code(*values):
            value = draw.choice(values)
            return None if value is None else float(value)

        def record(i):
            race = code(1, 2, 3, 4, 5)
            weeks = 34.0 if draw.random() < 0.2 + 0.04 * race else 39.0
            return (f"{5200 + i % 40}", draw.choice("ABC"), race, weeks, code(1, 2, 3, 4, 5, 9),
                    code(0, 1, 2, 3, 4, 5, 9, None), code(17, 25, 38), draw.randint(*S.YEARS),
                    code(1, 2, 3, 4, 9, None), code(0, 1, 2, 5, 99, None), code(1, 2, 5, 9, None), 1.0, 2.0)

        return self.spark.createDataFrame([record(i) for i in range(3000)], COLUMNS)


def expected_ratio(space, task, arm):
    """The focal odds ratio of a row-level fit on an arm's own sample."""
    rows = [r.asDict() for r in space.run(arm, True).rows.collect()]
    rows = [r for r in rows if (task.sample != "sens" or r["sens"]) and all(r[f] is not None for f in task.model.factors)]
    terms = G.design(task.model, {f: {r[f] for r in rows} for f in task.model.factors})
    beta, _, _ = dense(rows, task.model, terms)
    return math.exp(beta[terms.index(((G.EXPOSURE, V.RACE_FOCAL),))])


def test_ratios_are_compared_for_every_model_of_the_ladder(spark, tmp_path, monkeypatch):
    space = OwnRecords(spark, str(tmp_path))
    monkeypatch.setattr(base, "workspace", lambda *_: space)
    found = base.QUERIES["d03_ratio_by_model"](spark, str(tmp_path)).collect()
    assert sorted(r.modelo for r in found) == [name for name, _ in V.LADDER]
    rows = {r.modelo: r for r in found}
    for task in space.run("ESCMAE", True).ladder():
        ours, theirs = (expected_ratio(space, task, arm) for arm in ("ESCMAE", "variant"))
        row = rows[task.model.name]
        assert row.grupo == V.RACE_FOCAL and ours != pytest.approx(theirs, abs=1e-4)
        assert (row.nosso, row.referencia, row.delta) == pytest.approx((ours, theirs, ours - theirs), abs=2e-6)
