"""Cascade, samples and descriptive tables."""

import pytest
from pyspark.sql import functions as F

from vitalcells.operators import cohort as K
from vitalcells.operators import describe as D
from vitalcells.registry.base import workspace

# Counts worked out independently for the test input, steps 0 to 6.
GOLDEN = {
    "sf0.001": [5933, 4212, 1918, 1849, 1737, 1737, 1309],
    "sf0.01": [59414, 46209, 20767, 19918, 18810, 18810, 14746],
    "sf0.1": [593782, 466339, 210488, 202233, 190819, 190819, 151257],
}
OUTCOMES = {"sf0.001": 1111, "sf0.01": 12375, "sf0.1": 124464}

COLUMNS = ("CODMUNRES string, UF string, RACACORMAE double, SEMAGESTAC double, ESCMAE double, "
           "ESCMAE2010 double, IDADEMAE double, ANO int, CONSULTAS double, QTDFILVIVO double, "
           "ESTCIVMAE double, GRAVIDEZ double, MESPRENAT double")
GOOD = dict(CODMUNRES="520870", UF="GO", RACACORMAE=1.0, SEMAGESTAC=38.0, ESCMAE=4.0, ESCMAE2010=3.0,
            IDADEMAE=25.0, ANO=2020, CONSULTAS=4.0, QTDFILVIVO=1.0, ESTCIVMAE=2.0, GRAVIDEZ=1.0,
            MESPRENAT=2.0)
WINDOW = (2015, 2024)


def births(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, **c}.values()) for c in changes], COLUMNS)


@pytest.mark.parametrize("scale", GOLDEN)
def test_golden_cascade(spark, scale):
    space = workspace(spark, f"/root/testdata/{scale}")
    rows = K.cascade(space.births(keep=()), space.rules["ESCMAE"]).orderBy("ordem").collect()
    assert [r.n for r in rows] == GOLDEN[scale]
    assert space.cohort.where("in_primary").agg(F.sum("ptb")).first()[0] == OUTCOMES[scale]


@pytest.mark.parametrize("arm", ["ESCMAE", "ESCMAE2010", "variant"])
def test_cascade_only_shrinks(space, arm):
    rows = K.cascade(space.cohort, space.rules[arm]).orderBy("ordem").collect()
    counts = [r.n for r in rows]
    assert counts == sorted(counts, reverse=True)


@pytest.mark.parametrize("change, primary, sens", [
    ({}, True, True),
    ({"RACACORMAE": 3.0}, False, False), ({"RACACORMAE": 9.0}, False, False),
    ({"RACACORMAE": None}, False, False), ({"RACACORMAE": 1.5}, False, False),
    ({"SEMAGESTAC": 21.0}, False, False), ({"SEMAGESTAC": 22.0}, True, True),
    ({"SEMAGESTAC": 44.0}, True, True), ({"SEMAGESTAC": 45.0}, False, False),
    ({"SEMAGESTAC": None}, False, False), ({"ESCMAE": 9.0}, False, False),
    ({"IDADEMAE": 9.0}, False, False), ({"IDADEMAE": 61.0}, False, False),
    ({"UF": None}, False, False), ({"CONSULTAS": 9.0}, True, True),
    ({"CONSULTAS": None}, True, False), ({"ESTCIVMAE": 9.0}, True, False),
    ({"ESTCIVMAE": None}, True, False), ({"QTDFILVIVO": None}, True, True),
])
def test_main_rules(spark, change, primary, sens):
    row = K.with_flags(births(spark, change), K.main_rules("ESCMAE", WINDOW)).first()
    assert (row.in_primary, row.in_sens) == (primary, sens)


@pytest.mark.parametrize("change, primary, sens", [
    ({"ESCMAE2010": 9.0}, True, True), ({"ESCMAE2010": None}, False, False),
    ({"ESTCIVMAE": 9.0}, True, True), ({"QTDFILVIVO": None}, True, False),
])
def test_variant_rules(spark, change, primary, sens):
    row = K.with_flags(births(spark, change), K.variant_rules(WINDOW)).first()
    assert (row.in_primary_var, row.in_sens_var) == (primary, sens)


def test_inclusion_groups_overlap(spark):
    flagged = K.with_flags(births(spark, {}, {"SEMAGESTAC": None}, {"RACACORMAE": None}),
                           K.main_rules("ESCMAE", WINDOW))
    counts = {r.grupo: r["count"] for r in K.inclusion_groups(flagged).groupBy("grupo").count().collect()}
    assert counts == dict(zip(K.INCLUSION_GROUPS, (1, 1, 2)))


def test_included_vs_excluded_denominators(spark):
    rows = births(spark, {}, {"SEMAGESTAC": None}, {"RACACORMAE": None, "SEMAGESTAC": 30.0},
                  {"RACACORMAE": 3.0}, {"RACACORMAE": 9.0})
    flagged = K.with_categories(K.with_flags(rows, K.main_rules("ESCMAE", WINDOW)))
    table = {r.grupo: r for r in D.included_vs_excluded(K.inclusion_groups(flagged)).collect()}
    out = table[K.INCLUSION_GROUPS[2]]
    assert (out.n, out.ptb_definido_n) == (4, 3)
    assert out.ptb_pct == pytest.approx(100 / 3)
    assert out.raca_branca_pct == 100.0
    assert (out.raca_outra_missing_pct, out.raca_codigo9_pct) == (50.0, 25.0)


def test_group_rows_add_up_to_total(space):
    rows = D.table1_national(space.cohort).collect()
    total = next(r for r in rows if r.grupo == D.TOTAL)
    assert sum(r.n for r in rows if r.grupo != D.TOTAL) == total.n
    assert sum(r.ptb_n for r in rows if r.grupo != D.TOTAL) == total.ptb_n


def test_null_group_is_not_the_total(spark):
    rows = spark.createDataFrame([("a",), (None,)], "g string")
    table = D.by_group_and_total(rows, "g", [F.count("*").alias("n")]).collect()
    assert sorted((r.grupo or "", r.n) for r in table) == [("", 1), ("TOTAL", 2), ("a", 1)]


def test_empty_state_group_cell_is_kept(spark):
    flagged = K.with_categories(K.with_flags(births(spark, {}), K.main_rules("ESCMAE", WINDOW)))
    states = spark.createDataFrame([("GO",), ("MT",)], "UF string")
    grid = D.prevalence_grid(flagged, states).collect()
    assert len(grid) == 8
    empty = next(r for r in grid if (r.UF, r.raca) == ("MT", "Preta"))
    assert (empty.n, empty.ptb_n, empty.ptb_pct) == (0, 0, None)


def test_missing_rules_on_valid_exposure_only(spark):
    rows = K.with_categories(births(spark, {"SEMAGESTAC": 50.0}, {"MESPRENAT": 99.0},
                                    {"ESTCIVMAE": 9.0}, {"RACACORMAE": None, "CONSULTAS": None}))
    table = {(r.variavel, r.grupo): r for r in D.missing_by_group(rows).collect()}
    assert table["Idade gestacional", "TOTAL"].missing_n == 1
    assert table["Mes inicio pre-natal", "TOTAL"].missing_n == 1
    assert table["Estado civil", "TOTAL"].missing_n == 0
    assert table["No consultas pre-natal", "TOTAL"].n == 3
