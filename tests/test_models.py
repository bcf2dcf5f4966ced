"""Fits on cells against a dense numpy fit on the same rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalcells.operators import glm as G
from vitalcells.operators.cells import collapse_rows
from vitalcells.plans import studies as T
from vitalcells.plans.studies import Task


def dense(rows, model, terms):
    """IRLS on single rows: coefficients, covariances and AIC. `rows` are dicts with ptb and town."""
    x = np.array([[math.prod(float(r[c]) if v is None else float(r[c] == v) for c, v in t) for t in terms]
                  for r in rows])
    y = np.array([r["ptb"] for r in rows], float)
    logit = model.family == "binomial"
    beta = np.zeros(len(terms))
    beta[0] = np.log(y.mean() / (1 - y.mean())) if logit else np.log(y.mean())
    for _ in range(50):
        eta = x @ beta
        mu = 1 / (1 + np.exp(-eta)) if logit else np.exp(eta)
        v = mu * (1 - mu) if logit else mu
        step = np.linalg.solve((x * v[:, None]).T @ x, x.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    bread = np.linalg.inv((x * v[:, None]).T @ x)
    score = x * (y - mu)[:, None]
    towns = {}
    for r, s in zip(rows, score):
        towns[r["CODMUNRES"]] = towns.get(r["CODMUNRES"], 0) + s
    u = np.array(list(towns.values()))
    g, n, k = len(towns), len(rows), len(terms)
    loglik = (np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu)) if logit
              else np.sum(y * np.log(mu) - mu))
    return beta, {
        "model": np.sqrt(np.diag(bread)),
        "hc0": np.sqrt(np.diag(bread @ score.T @ score @ bread)),
        "cluster": np.sqrt(np.diag(bread @ u.T @ u @ bread) * g / (g - 1) * (n - 1) / (n - k)),
    }, -2 * loglik + 2 * k


FACTORS = ["raca", "idade_cat", "esc_cat", "ano_cat", "uf_cat", "cons_cat", "parid_cat", "estciv_cat"]


@pytest.fixture(scope="module")
def run(space):
    return space.run()


@pytest.fixture(scope="module")
def rows(space):
    columns = [F.col("UF").alias("uf_cat") if c == "uf_cat" else F.col(c) for c in FACTORS]
    collected = space.focus.where("in_primary").select(
        *columns, "ptb", "CODMUNRES", "in_sens", "singleton", F.col("ESCMAE").alias("esc_lin"),
        F.col("CONSULTAS").alias("cons_lin")).collect()
    return [r.asDict() for r in collected]


def of(rows, task, keep=lambda r: True):
    return [r for r in rows if (task.sample != "sens" or r["in_sens"]) and keep(r)
            and all(r[k] is not None for k in task.model.keys)]


@pytest.mark.parametrize("factors, linear, family", [
    (T.M1, (), "binomial"), (T.M5, (), "binomial"), (T.M8, (), "binomial"),
    (T.M5, (), "poisson"), (T.M8, (), "poisson"),
    (T.without(T.M8, "esc_cat", "cons_cat"), ("esc_lin", "cons_lin"), "binomial"),
])
def test_cells_fit_equals_row_fit(run, rows, factors, linear, family):
    model = G.Model(f"t_{len(factors)}_{family}", factors, linear, family=family)
    task = Task(model, "sens" if "parid_cat" in factors else "primary", robust=True, cluster=True)
    fit = run.fit(task)
    sample = of(rows, task)
    beta, errors, aic = dense(sample, model, fit.terms)
    assert fit.n == len(sample)
    np.testing.assert_allclose(fit.coefficients, beta, atol=1e-8)
    assert fit.aic == pytest.approx(aic, abs=1e-6)
    for kind, expected in errors.items():
        for i, term in enumerate(fit.terms):
            if term in fit.standard_errors[kind]:
                assert fit.standard_errors[kind][term] == pytest.approx(expected[i], rel=1e-7), (kind, term)
    assert len(fit.standard_errors["hc0"]) == len(fit.standard_errors["cluster"]) == 3


def test_interaction_fit_equals_row_fit(run, rows):
    base, extended = run.fit_all(run.interaction())
    _, errors, aic = dense(of(rows, run.interaction()[1]), extended.model, extended.terms)
    assert extended.aic == pytest.approx(aic, abs=1e-6)
    test = G.likelihood_ratio(base, extended)
    assert test["gl"] == 12 and test["lrt_chi2"] > 0 and 0 < test["p_valor"] < 1


def test_filtered_fit_equals_row_fit(run, rows):
    year = 1999
    task = next(t for t in run.yearly() if t.model.name == f"Ano_{year}")
    fit = run.fit(task)
    beta, _, _ = dense(of(rows, task, lambda r: r["ano_cat"] == str(year)), task.model, fit.terms)
    np.testing.assert_allclose(fit.coefficients, beta, atol=1e-8)


def test_more_factors_never_fit_worse(run):
    fits = run.fit_all(run.ladder())
    primary, sens = fits[:5], fits[5:]
    for group in (primary, sens):
        assert all(b.loglik >= a.loglik - 1e-6 for a, b in zip(group, group[1:]))


def test_block_without_the_first_year_picks_another_reference(run):
    block = run.blocks()[-1]
    fit = run.fit(block)
    years = [t[0][1] for t in fit.terms if t and t[0][0] == "ano_cat"]
    assert years == ["2001"]
    assert all(e < 1 for e in fit.standard_errors["model"].values())


CELLS = "raca string, a string, succ bigint, n bigint, singleton boolean"


def test_unused_level_makes_no_column(spark):
    cells = spark.createDataFrame(
        [("Branca", "x", 10, 30, True), ("Parda", "x", 12, 30, True), ("Branca", "y", 9, 31, True),
         ("Parda", "y", 16, 33, True), ("Preta", "z", 0, 0, True)], CELLS).where("n > 0")
    fit = G.fit(cells, G.Model("m", ("raca", "a")))
    assert [t for t in fit.terms] == [(), (("raca", "Parda"),), (("a", "y"),)]


def test_aliased_covariate_leaves_the_exposure_as_it_is(run, rows):
    cells = run.cells.cells("primary", ("raca", "idade_cat")).withColumn("again", F.concat(F.lit("x"), "idade_cat"))
    plain = G.fit(cells, G.Model("m", ("raca", "idade_cat")), robust=True)
    twice = G.fit(cells, G.Model("m", ("raca", "idade_cat", "again")), robust=True)
    assert twice.terms == plain.terms and twice.aic == pytest.approx(plain.aic, rel=1e-9)
    for se in ("model", "hc0"):
        for one, other in zip(G.effects(plain, se), G.effects(twice, se)):
            assert one[4:8] == pytest.approx(other[4:8], rel=1e-7)


def test_independent_columns_keep_the_first_named():
    x = np.array([[1, 1, 1, 0], [1, 0, 0, 1], [1, 1, 1, 2], [1, 0, 0, 5.0]])
    assert G.independent(x.T @ x, [0, 2]) == [0, 2, 3]


def test_separated_level_has_no_estimate(spark):
    cells = spark.createDataFrame(
        [("Branca", "x", 10, 30, True), ("Parda", "x", 0, 30, True), ("Preta", "x", 15, 30, True)], CELLS)
    rows = {r[1]: r for r in G.effects(G.fit(cells, G.Model("m", ("raca",))))}
    assert rows["Parda"][4] is None and rows["Preta"][4] == pytest.approx(2.0)


# Two binary covariates of which the combination n,n never and y,y always has the outcome: no level is
# separated, their combination is.
JOINT = [(r, a, b, s, n, True) for i, r in enumerate(("Branca", "Parda", "Preta", "Indigena"))
         for a, b, s, n in (("n", "n", 0, 20 + i), ("y", "y", 15 + i, 15 + i), ("y", "n", 8 + 3 * i, 30 + i),
                            ("n", "y", 14 - 2 * i, 29 + i))]
JOINT_CELLS = "raca string, a string, b string, succ bigint, n bigint, singleton boolean"


def singles(cells):
    """Cells as single records with a town each."""
    return [{"raca": r, "a": a, "b": b, "ptb": int(k < s), "CODMUNRES": f"{r}{k % 7}"}
            for r, a, b, s, n, _ in cells for k in range(n)]


def test_separated_combination_leaves_the_other_effects(spark):
    model = G.Model("joint", ("raca", "a", "b"))
    rest = [c for c in JOINT if c[1] != c[2]]
    rows = spark.createDataFrame(singles(JOINT))
    fit = G.fit(spark.createDataFrame(JOINT, JOINT_CELLS), model, robust=True, rows=rows)
    terms = [(), *[(("raca", g),) for g in ("Parda", "Preta", "Indigena")], (("a", "y"),)]
    beta, errors, aic = dense(singles(rest), G.Model("rest", ("raca", "a")), terms)
    assert set(fit.status.values()) == {"ok"} and fit.n == sum(c[4] for c in JOINT)
    for i, term in enumerate(terms[1:4], start=1):
        assert fit.coefficient(term) == pytest.approx(beta[i], abs=1e-8)
        for kind in ("model", "hc0"):
            assert fit.standard_errors[kind][term] == pytest.approx(errors[kind][i], rel=1e-7)
        assert fit.standard_errors["cluster"][term] > 0
    assert fit.n_params == 6 and fit.aic == pytest.approx(aic - 2 * len(terms) + 2 * 6, abs=1e-6)
    observed = {("a", "y"): 0, ("b", "y"): 0}
    for _, a, b, s, _, _ in JOINT:
        for key in (("a", a), ("b", b)):
            observed[key] = observed.get(key, 0) + s
    fitted = {(f, v): x for f, v, x in fit.margins}
    for key, total in observed.items():
        assert fitted[key] == pytest.approx(total, abs=1e-6)
    assert len(G.effects(fit)) == 3 and all(row[-1] == "ok" and row[4] > 0 for row in G.effects(fit))


def test_separated_level_beside_a_covariate(spark):
    """One group without the outcome: its ratio has no number, the others are those without its rows."""
    cells = [c if c[0] != "Preta" else (*c[:3], 0, *c[4:]) for c in JOINT if c[1] != c[2]]
    model = G.Model("level", ("raca", "a"))
    for family in ("binomial", "poisson"):
        fit = G.fit(spark.createDataFrame(cells, JOINT_CELLS), G.Model("level", ("raca", "a"), family=family))
        assert fit.status == {"Parda": "ok", "Preta": "separada", "Indigena": "ok"}
        terms = [(), (("raca", "Parda"),), (("raca", "Indigena"),), (("a", "y"),)]
        beta, errors, _ = dense(singles([c for c in cells if c[0] != "Preta"]),
                                G.Model("rest", model.factors, family=family), terms)
        rows = {r[1]: r for r in G.effects(fit)}
        assert rows["Preta"][4:8] == (None,) * 4 and rows["Preta"][-1] == "separada"
        for i, g in ((1, "Parda"), (2, "Indigena")):
            assert rows[g][4] == pytest.approx(math.exp(beta[i]), rel=1e-7)
        table = {r.grupo: r.p_ajustada_pct for r in G.standardised(spark.createDataFrame(cells, JOINT_CELLS), fit).collect()}
        assert table["Preta"] == 0.0 and table["Branca"] > 0


def test_separated_reference_separates_every_ratio(spark):
    cells = [("Branca", "n", "n", 0, 9, True), ("Parda", "n", "n", 3, 9, True), ("Preta", "n", "n", 4, 9, True)]
    fit = G.fit(spark.createDataFrame(cells, JOINT_CELLS), G.Model("m", ("raca",)))
    assert fit.status == {"Parda": "separada", "Preta": "separada"}
    everything = [("Branca", "n", "n", 0, 9, True), ("Parda", "n", "n", 9, 9, True)]
    fit = G.fit(spark.createDataFrame(everything, JOINT_CELLS), G.Model("m", ("raca",)))
    assert fit.separated == {"Parda"} and G.effects(fit)[0][4] is None


def test_rare_outcome_is_not_separated(spark):
    """Far predictors alone are no separation."""
    cells = [("Branca", "n", "n", 1, 60_000_000, True), ("Parda", "n", "n", 2, 50_000_000, True)]
    fit = G.fit(spark.createDataFrame(cells, JOINT_CELLS), G.Model("m", ("raca",)))
    assert fit.status == {"Parda": "ok"}
    assert G.effects(fit)[0][4] == pytest.approx(2 / (50_000_000 - 2) * (60_000_000 - 1), rel=1e-6)


def test_random_sparse_cells_agree_with_a_long_dense_fit(spark):
    """Sparse tables, some separated: finite effects equal a dense fit without the perfectly fitted rows."""
    rng = np.random.default_rng(5)
    seen = set()
    for trial in range(6):
        cells = [(g, a, b, int(rng.integers(0, n + 1)) if rng.random() < 0.35 else (n if rng.random() < 0.5 else 0), n, True)
                 for g in ("Branca", "Parda", "Preta", "Indigena") for a in "xyz" for b in "uvw"
                 for n in [int(rng.integers(1, 4))] if rng.random() < 0.7]
        model = G.Model(f"sparse{trial}", ("raca", "a", "b"))
        fit = G.fit(spark.createDataFrame(cells, JOINT_CELLS), model)
        rows = singles(cells)
        names = ["Parda", "Preta", "Indigena"]
        x = np.array([[1.0, *[float(r["raca"] == g) for g in names], float(r["a"] == "y"), float(r["a"] == "z"),
                       float(r["b"] == "v"), float(r["b"] == "w")] for r in rows])
        y = np.array([r["ptb"] for r in rows], float)
        beta = np.zeros(x.shape[1])
        for _ in range(22):  # damped: an infinite coefficient walks away about one a step
            mu = 1 / (1 + np.exp(-x @ beta))
            v = np.maximum(mu * (1 - mu), 1e-12)
            beta = beta + np.linalg.pinv((x * v[:, None]).T @ x, rcond=1e-13) @ (x.T @ (y - mu))
        for i, g in enumerate(names, start=1):
            if g not in fit.status:
                continue
            seen.add(fit.status[g])
            if fit.status[g] == "ok":
                assert fit.log_ratio(g) == pytest.approx(beta[i], abs=2e-4), (trial, g)
            else:
                assert abs(beta[i]) > 8, (trial, g)
    assert "ok" in seen


def test_empty_stratum_gives_no_rows(spark):
    cells = spark.createDataFrame([], CELLS)
    assert G.effects(G.fit(cells, G.Model("m", ("raca",)))) == []


def test_quotes_in_levels(spark):
    cells = spark.createDataFrame(
        [("Branca", "d'Oeste", 10, 30, True), ("Parda", "d'Oeste", 12, 30, True),
         ("Branca", "back\\slash", 9, 31, True), ("Parda", "back\\slash", 16, 33, True)], CELLS)
    fit = G.fit(cells, G.Model("m", ("raca", "a")))
    assert sum(v for f, _, v in fit.margins if f == "a") == pytest.approx(47)


def test_one_group_with_most_rows(spark):
    """A third of all rows in one town, and most in one cell, change nothing but the weights."""
    data = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("CODMUNRES"),
        F.when(F.col("id") % 10 < 8, "Branca").otherwise("Parda").alias("raca"),
        (F.col("id") % 7 == 0).cast("int").alias("ptb"))
    fit = G.fit(collapse_rows(data, "raca"), G.Model("m", ("raca",)), robust=True, rows=data)
    expected = [r.asDict() for r in data.collect()]
    beta, errors, _ = dense(expected, fit.model, fit.terms)
    np.testing.assert_allclose(fit.coefficients, beta, atol=1e-9)
    term = (("raca", "Parda"),)
    for kind in ("model", "hc0", "cluster"):
        assert fit.standard_errors[kind][term] == pytest.approx(errors[kind][1], rel=1e-7)


def test_standardised_reference_difference_is_zero(run):
    rows = {r.grupo: r for r in T.adjusted_probabilities(run, run.ladder()[4]).collect()}
    assert rows["Branca"].dif_pp == 0.0
    assert all(0 < r.p_ajustada_pct < 100 for r in rows.values())


@pytest.mark.parametrize("x, df, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (11.070497693516351, 5, 0.05), (26.29622760486423, 16, 0.05), (0.0, 4, 1.0)])
def test_chi2_tail(x, df, p):
    assert G.chi2_tail(x, df) == pytest.approx(p, abs=1e-9)


def test_normal_tail():
    assert G.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
