"""Logistic and Poisson models on cells, with model, HC0 and cluster covariances.

Cells stay on the executors. The driver sees level lists, coefficients and k x k sums, whose
size depends on the model and not on the data. A fit takes one aggregation of all factor pairs
before Spark's own solver and one after it: the first gives the levels that occur, the rank of the
design and whether outcomes can be told apart by it, the second the likelihood, the fitted totals,
the information and the HC0 sums.
"""

import math
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.operators.cells import collapse, collapse_rows
from vitalcells.storage import cached

LEVEL_ORDER = {
    "raca": V.RACE_LEVELS,
    "idade_cat": V.AGE_LEVELS,
    "cons_cat": tuple(V.VISITS.values()),
    "parid_cat": V.PARITY_LEVELS,
    "esc_cat": tuple(V.EDUCATION.values()),
}
EXPOSURE = "raca"
Z95 = 1.959963984540054
MOST_ROUNDS = 30
#: A column with more values is no factor.
MOST_LEVELS = 2000
# Share of a column that the columns before it must leave unexplained.
RANK_TOLERANCE = 1e-9
CELLS_PER_TASK = 20_000
# A linear predictor beyond this is on its way to infinity if the outcomes can be told apart.
FAR = 15.0
MOST_RECTIFIED = 500
OK, SEPARATED = "ok", "separada"


@dataclass(frozen=True)
class Model:
    """A model as a list of factor names; the first level present is each factor's reference."""

    name: str
    factors: tuple[str, ...]
    linear: tuple[str, ...] = ()
    interactions: tuple[tuple[str, str], ...] = ()
    family: str = "binomial"

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.factors, *self.linear)


# A term is a tuple of (column, level); level None stands for the column's number.
Term = tuple[tuple[str, str | None], ...]


def order_levels(factor: str, present: set[str]) -> list[str]:
    """Declared order first, anything else by text."""
    declared = LEVEL_ORDER.get(factor, ())
    return [v for v in declared if v in present] + sorted(present - set(declared))


def levels_of(cells: DataFrame, factors: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """Values of each factor, in order."""
    entries = [F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in factors]
    rows = (cells.select(F.inline(F.array(*entries))).where("v is not null").distinct()
            .limit(len(factors) * MOST_LEVELS + 1).collect())
    out: dict[str, set] = {f: set() for f in factors}
    for row in rows:
        out[row.f].add(row.v)
    for f, values in out.items():
        if len(values) > MOST_LEVELS:
            raise ValueError(f"{f} has more than {MOST_LEVELS} values")
    return {f: tuple(order_levels(f, values)) for f, values in out.items()}


def _text(level: str) -> str:
    return "'" + level.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Coding:
    """Levels as numbers: every factor column becomes its level's place, so that all later work looks
    weights up by number. `kinds` are the blocks of the design: the constant, factors, numbers and
    products of factors, each with its places in the table of cross sums."""

    def __init__(self, model: Model, levels: dict[str, tuple[str, ...]]):
        self.model = model
        self.levels = {f: levels[f] for f in model.factors}
        self.kinds: list[tuple[str, ...]] = [(), *[(f,) for f in model.factors],
                                             *[(x,) for x in model.linear], *model.interactions]
        self.sizes = [math.prod(len(self.levels[c]) for c in kind if c in self.levels) for kind in self.kinds]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).tolist()
        self.total = self.first[-1]
        self._place = {kind: i for i, kind in enumerate(self.kinds)}

    def apply(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Numbered levels beside the columns to keep; rows with an unknown key are left out."""
        numbered = []
        for f in self.model.factors:
            pairs = ", ".join(f"{_text(v)}, {i}" for i, v in enumerate(self.levels[f]))
            numbered.append(f"try_element_at(map({pairs}), `{f}`) as `{f}`" if pairs
                            else f"cast(null as int) as `{f}`")
        numbers = [f"cast(`{x}` as double) as `{x}`" for x in self.model.linear]
        return rows.selectExpr(*numbered, *numbers, *keep).na.drop(subset=list(self.model.keys))

    def place(self, kind: tuple[str, ...], fixed: dict[str, int] | None = None) -> str:
        """SQL of a row's place within a kind."""
        parts, scale = [], 1
        for c in reversed([c for c in kind if c in self.levels]):
            parts.append(f"{scale} * {(fixed or {}).get(c, f'`{c}`')}")
            scale *= len(self.levels[c])
        return " + ".join(parts) or "0"

    def value(self, kind: tuple[str, ...]) -> str:
        return " * ".join(f"`{c}`" for c in kind if c not in self.levels) or "1D"

    def code(self, term: Term) -> int:
        """Place of a term in the table of cross sums."""
        kind = tuple(c for c, _ in term)
        at = 0
        for c, level in term:
            if level is not None:
                at = at * len(self.levels[c]) + self.levels[c].index(level)
        return self.first[self._place[kind]] + at

    def predictor(self, terms, weights, fixed: dict[str, str] | None = None) -> str:
        """SQL of the sum of weight x term on numbered rows; `fixed` sets factors to a level."""
        places = {f: self.levels[f].index(v) for f, v in (fixed or {}).items()}
        of_kind: dict[tuple, np.ndarray] = {}
        for term, weight in zip(terms, weights):
            kind = tuple(c for c, _ in term)
            block = self._place[kind]
            table = of_kind.setdefault(kind, np.zeros(self.sizes[block]))
            table[self.code(term) - self.first[block]] = weight
        parts = []
        for kind, table in of_kind.items():
            numbers = [f"{float(w)!r}D" for w in table]
            weight = numbers[0] if len(numbers) == 1 and not any(c in self.levels for c in kind) else \
                f"get(array({', '.join(numbers)}), {self.place(kind, places)})"
            value = self.value(kind)
            parts.append(weight if value == "1D" else f"{weight} * {value}")
        return " + ".join(parts) or "0D"

    def cross_sums(self, data: DataFrame, measures: dict[str, str],
                   most: str = "0D") -> tuple[dict[str, np.ndarray], float]:
        """Sums of measure x column x column over all pairs of columns of the design, in one pass, and
        the largest value of `most`.

        A cell is one entry per pair of kinds (not per pair of columns): the places of its two levels.
        """
        cells = range(len(self.kinds))
        pairs = [(0, 0), *[(0, j) for j in cells[1:]], *combinations(cells[1:], 2),
                 *[(j, j) for j in cells if self.value(self.kinds[j]) != "1D"]]
        # A cell carries its place in every kind; a short expression picks the two of each pair. Writing
        # out all pairs makes code that the JVM does not compile.
        places = ", ".join(f"{first}L + {self.place(kind)}" for first, kind in zip(self.first, self.kinds))
        values = ", ".join(f"cast({self.value(kind)} as double)" for kind in self.kinds)
        picked = ", ".join(f"named_struct('i', {i}, 'j', {j})" for i, j in pairs)
        names = [f"m{i}" for i in range(len(measures))]
        rows = (data.selectExpr(*[f"cast({sql} as double) as {n}" for n, sql in zip(names, measures.values())],
                                f"{most} as most", f"array({places}) as places", f"array({values}) as vals")
                .selectExpr("*", f"inline(array({picked}))")
                .selectExpr(*names, "most", f"get(places, i) * {self.total}L + get(places, j) as k",
                            "get(vals, i) * get(vals, j) as v")
                .groupBy("k").agg(F.max("most").alias("most"),
                                  *[F.sum(F.col(n) * F.col("v")).alias(n) for n in names]).collect())
        out = {m: np.zeros((self.total, self.total)) for m in measures}
        for row in rows:
            i, j = divmod(row.k, self.total)
            for n, table in zip(names, out.values()):
                table[i, j] = table[j, i] = row[n]
        for block, kind in enumerate(self.kinds):
            if self.value(kind) == "1D":  # of the levels of a factor only one is 1
                at = np.arange(self.first[block], self.first[block + 1])
                for table in out.values():
                    table[at, at] = table[0, at]
        return out, max((row.most for row in rows), default=0.0)

    def of_terms(self, table: np.ndarray, terms) -> np.ndarray:
        codes = [self.code(t) for t in terms]
        return table[np.ix_(codes, codes)]

    def present(self, cells: np.ndarray) -> dict[str, set]:
        """Levels and level pairs that some cell has, given the numbers of cells."""
        out: dict[str, set] = {}
        for block, kind in enumerate(self.kinds):
            if not kind or kind[0] not in self.levels:
                continue
            found = [i for i in range(self.sizes[block]) if cells[0, self.first[block] + i] > 0]
            if len(kind) == 1:
                out[kind[0]] = {self.levels[kind[0]][i] for i in found}
            else:
                f, g = kind
                width = len(self.levels[g])
                out[f"{f}:{g}"] = {(self.levels[f][i // width], self.levels[g][i % width]) for i in found}
        return out


@dataclass(frozen=True)
class Fit:
    model: Model
    # Terms with a coefficient: the others are aliased, or infinite and set aside.
    terms: tuple[Term, ...]
    coefficients: tuple[float, ...]
    n: int
    loglik: float
    margins: tuple[tuple[str, str, float], ...]
    standard_errors: dict[str, dict[Term, float]] = field(default_factory=dict)
    # Per exposure level beyond the reference: ok, or separated (its ratio is zero or infinite).
    status: dict[str, str] = field(default_factory=dict)
    # Parameters of the design, infinite ones included.
    n_params: int = 0
    # Directions in which the predictor grows without end, strongest first, with their terms.
    directions: tuple[tuple[tuple[Term, ...], tuple[float, ...]], ...] = ()
    coding: Coding | None = None

    @property
    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_params

    @property
    def separated(self) -> frozenset[str]:
        return frozenset(level for level, status in self.status.items() if status == SEPARATED)

    def coefficient(self, term: Term) -> float | None:
        return dict(zip(self.terms, self.coefficients)).get(term)

    def log_ratio(self, level: str) -> float | None:
        return self.coefficient(((EXPOSURE, level),))

    def mean(self, fixed: dict[str, str] | None = None) -> str:
        """SQL of the fitted mean on numbered rows; where the predictor has no end, its limit."""
        eta = self.coding.predictor(self.terms, self.coefficients, fixed)
        sql = f"1D / (1D + exp(-({eta})))" if self.model.family == "binomial" else f"exp({eta})"
        top = "1D" if self.model.family == "binomial" else "cast(null as double)"
        for terms, weights in reversed(self.directions):
            along = self.coding.predictor(terms, weights, fixed)
            sql = f"case when {along} > {ALONG} then {top} when {along} < -{ALONG} then 0D else {sql} end"
        return sql

    def finite(self) -> str:
        """SQL test of the numbered rows whose predictor has an end."""
        return " and ".join(["true", *[f"abs({self.coding.predictor(*d)}) <= {ALONG}" for d in self.directions]])


def design(model: Model, present: dict[str, set]) -> tuple[Term, ...]:
    """Intercept, dummies of the levels present except the reference, numbers, products."""
    levels = {f: order_levels(f, present.get(f, set())) for f in model.factors}
    terms: list[Term] = [()]
    terms += [((f, v),) for f in model.factors for v in levels[f][1:]]
    terms += [((x, None),) for x in model.linear]
    for f, g in model.interactions:
        terms += _estimable_products(f, levels[f], g, levels[g], present.get(f"{f}:{g}", set()))
    return tuple(terms)


def _estimable_products(f, f_levels, g, g_levels, pairs: set) -> list[Term]:
    """Products that add information beyond the main effects, given the level pairs that occur."""
    rows = sorted(pairs)

    def column(test):
        return [1.0 if test(a, b) else 0.0 for a, b in rows]

    columns = [column(lambda a, b: True)]
    columns += [column(lambda a, b, v=v: a == v) for v in f_levels[1:]]
    columns += [column(lambda a, b, v=v: b == v) for v in g_levels[1:]]
    kept: list[Term] = []
    for u in f_levels[1:]:
        for v in g_levels[1:]:
            candidate = [*columns, column(lambda a, b: (a, b) == (u, v))]
            if (u, v) in pairs and np.linalg.matrix_rank(np.array(candidate)) == len(candidate):
                columns = candidate
                kept.append(((f, u), (g, v)))
    return kept


def independent(gram: np.ndarray, first: list[int]) -> list[int]:
    """Columns that are not sums of columns taken before them, given all cross products.

    Columns in `first` are taken first, the others in their order, so that an aliased covariate is
    left out and the exposure stays.
    """
    kept: list[int] = []
    for i in [*first, *(j for j in range(len(gram)) if j not in first)]:
        own = gram[i, i]
        if kept and own > 0:
            cross = gram[kept, i]
            own -= cross @ np.linalg.solve(gram[np.ix_(kept, kept)], cross)
        if own > RANK_TOLERANCE * gram[i, i]:
            kept.append(i)
    return sorted(kept)


def _exposure_first(terms) -> list[int]:
    return [i for i, t in enumerate(terms) if not t or (len(t) == 1 and t[0][0] == EXPOSURE)]


def _full_rank(gram: np.ndarray, terms: tuple[Term, ...]) -> tuple[Term, ...]:
    return tuple(terms[i] for i in independent(gram, _exposure_first(terms)))


def null_space(gram: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Directions (columns) in which the cross products vanish, measured against `scale`."""
    root = 1 / np.sqrt(scale)
    values, vectors = np.linalg.eigh(gram * root[:, None] * root[None, :])
    return vectors[:, values < RANK_TOLERANCE] * root[:, None]


# Separation.

# A predictor along a direction counts as zero below this; directions are scaled to a largest of 1.
ALONG = 1e-4
#: SQL of the side a cell's outcomes pull the predictor to; null where they hold it in place.
SIDE = {"binomial": "case when succ = n then 1D when succ = 0 then -1D end",
        "poisson": "case when succ = 0 then -1D end"}


def separating_direction(data: DataFrame, coding: Coding, terms, cells: np.ndarray,
                         held: np.ndarray) -> np.ndarray | None:
    """Weights along which the predictor can grow without lowering the likelihood, or None.

    Cells with both outcomes hold the predictor in place, which leaves the null space of their cross
    products. In it the iterative rectifier looks for a direction that no other cell opposes: the
    cells' wish to move is projected on the design, what is negative of it set to zero, and so on. The
    cells enter as their distinct projections; the sums of a round have the size of the null space.
    """
    whole, fixed = coding.of_terms(cells, terms), coding.of_terms(held, terms)
    basis = null_space(fixed, np.diag(whole))
    if not basis.shape[1]:
        return None
    names = [f"z{j}" for j in range(basis.shape[1])]
    side = SIDE[coding.model.family]
    points = (data.selectExpr(f"{side} as side", *[f"{coding.predictor(terms, b)} as {z}" for z, b in zip(names, basis.T)])
              .where("side is not null")
              .selectExpr(*[f"round(side * {z}, 9) + 0D as {z}" for z in names])
              .where(" or ".join(f"abs({z}) > 1e-7" for z in names))
              .groupBy(*names).agg(F.count("*").alias("w")))
    with cached(points):
        inner = np.linalg.pinv(basis.T @ (whole - fixed) @ basis, hermitian=True)
        along, weights = "1D", None
        for _ in range(MOST_RECTIFIED):
            low, high, *wish = points.selectExpr("w", *names, f"{along} as a").agg(
                F.min("a"), F.max("a"), *[F.sum(F.expr(f"w * greatest(a, 0D) * {z}")) for z in names]).first()
            if high is None or high < 1e-3:
                return None
            if weights is not None and low > -1e-5 * high:
                return basis @ weights / high
            weights = inner @ np.array(wish)
            along = " + ".join(f"({z} * {w!r}D)" for z, w in zip(names, weights.tolist()))
        return None


def fit(cells: DataFrame, model: Model, robust: bool = False, rows: DataFrame | None = None,
        correction_n: str = "rows", levels: dict[str, tuple[str, ...]] | None = None,
        most_cells: int | None = None) -> Fit:
    """Fit a model on cells; `rows` are the single records (ptb, CODMUNRES) behind them, for cluster
    errors; `levels` lists at least all levels that occur, and `most_cells` is a bound on the cells, where
    the caller has them.

    Where some outcomes can be told apart by the design, their cells fit perfectly in the limit and say
    nothing of the rest: they are set aside, what becomes infinite is reported as separated, and the
    other effects are those of the remaining cells.
    """
    if most_cells is not None:
        # Dealt by the keys to the few tasks that they need, where they are summed without a second shuffle.
        cells = cells.repartition(_tasks(most_cells), *model.keys)
    data = collapse(cells, *model.keys)
    coding = Coding(model, levels or levels_of(data, model.factors))
    with cached(coding.apply(data, "succ", "n")) as data:
        return _fit(data, coding, robust, rows, correction_n)


def _tasks(cells: float) -> int:
    return max(1, math.ceil(cells / CELLS_PER_TASK))


def _fit(data: DataFrame, coding: Coding, robust: bool, rows: DataFrame | None, correction_n: str) -> Fit:
    model = coding.model
    held = "succ > 0 and succ < n" if model.family == "binomial" else "succ > 0"
    before, _ = coding.cross_sums(data, {"cells": "1", "held": f"if({held}, 1, 0)"})
    whole = design(model, coding.present(before["cells"]))
    if len(whole) < 2:  # no rows, or nothing varies
        return Fit(model, (), (), 0, math.nan, ())
    whole = _full_rank(coding.of_terms(before["cells"], whole), whole)
    result = Fit(model, whole, (), 0, math.nan, (), n_params=len(whole), coding=coding,
                 status={t[0][1]: OK for t in whole if len(t) == 1 and t[0][0] == EXPOSURE})
    # Small cell tables run in few tasks; the number of tasks grows with the cells.
    left = data = data.coalesce(_tasks(before["cells"][0, 0]))
    while True:
        coefficients, converged = _estimate(left, coding, result.terms)
        result = replace(result, coefficients=tuple(coefficients))
        after, far = _after(data, result)
        along = None
        if not converged or far > FAR:
            along = separating_direction(left, coding, result.terms, before["cells"], before["held"])
        if along is None:
            if not converged:
                raise ArithmeticError(f"{model.name}: no convergence in {MOST_ROUNDS} rounds")
            break
        path = coding.predictor(result.terms, along)
        left = left.where(f"abs({path}) <= {ALONG}")
        result = replace(result, directions=(*result.directions, (result.terms, tuple(along.tolist()))))
        before, _ = coding.cross_sums(left, {"cells": "1", "held": f"if({held}, 1, 0)"})
        rest = coding.of_terms(before["cells"], whole)
        if rest[0, 0] == 0:  # every cell fits perfectly
            return replace(result, terms=(), coefficients=(), status={v: SEPARATED for v in result.status})
        result = replace(result, terms=_full_rank(rest, whole), status=_status(rest, whole))
    totals = after["fitted"]
    inverse = np.linalg.inv(coding.of_terms(after["information"], result.terms))
    errors = {"model": {t: math.sqrt(max(inverse[i, i], 0.0)) for i, t in enumerate(result.terms)}}
    exposure = {t: inverse[i] for i, t in enumerate(result.terms) if len(t) == 1 and t[0][0] == EXPOSURE}
    if robust:
        meat = coding.of_terms(after["hc0"], result.terms)
        errors["hc0"] = {t: math.sqrt(w @ meat @ w) for t, w in exposure.items()}
    n = int(after["n"][0, 0])
    if rows is not None:
        errors["cluster"] = _cluster(coding.apply(rows, "ptb", "CODMUNRES"), result, exposure, n, correction_n)
    return replace(result, n=n, loglik=float(after["loglik"][0, 0]), margins=_margins(coding, totals, after["n"]),
                   standard_errors=errors)


def _status(gram: np.ndarray, terms) -> dict[str, str]:
    """Which exposure effects the remaining cells still hold."""
    loose = np.abs(null_space(gram, np.where(np.diag(gram) > 0, np.diag(gram), 1.0))).max(axis=1, initial=0.0)
    return {t[0][1]: SEPARATED if loose[i] > 1e-6 * max(loose.max(), 1e-30) and loose[i] > 0 else OK
            for i, t in enumerate(terms) if len(t) == 1 and t[0][0] == EXPOSURE}


def _estimate(data: DataFrame, coding: Coding, terms):
    names = [f"x{i}" for i in range(1, len(terms))]
    columns = [f"{_indicator(coding, t)} as {x}" for t, x in zip(terms[1:], names)]
    inputs = data.selectExpr("succ", "n", *columns)
    inputs = VectorAssembler(inputCols=names, outputCol="features").transform(inputs)
    common = dict(labelCol="y", featuresCol="features", tol=1e-10, maxIter=MOST_ROUNDS)
    if coding.model.family == "binomial":
        inputs = inputs.selectExpr("succ / n as y", "cast(n as double) as w", "features")
        glm = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="w", **common)
    else:
        inputs = inputs.selectExpr("cast(succ as double) as y", "ln(cast(n as double)) as offset", "features")
        glm = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="offset", **common)
    with cached(inputs):
        fitted = glm.fit(inputs)
        coefficients = [fitted.intercept, *fitted.coefficients]
        converged = fitted.summary.numIterations < MOST_ROUNDS
    return coefficients, converged


def _indicator(coding: Coding, term: Term) -> str:
    if term[0][1] is None:
        return f"`{term[0][0]}`"
    tests = " and ".join(f"`{c}` = {coding.levels[c].index(v)}" for c, v in term)
    return f"if({tests}, 1D, 0D)"


def _after(data: DataFrame, result: Fit) -> tuple[dict[str, np.ndarray], float]:
    """Sums over the fitted cells, and how far their predictors go."""
    binomial = result.model.family == "binomial"
    fitted = data.selectExpr("*", f"{result.mean()} as mu")
    # A perfect fit has a likelihood of 1, also where the mean is rounded to it.
    loglik = ("if(succ > 0, succ * ln(greatest(mu, 1e-300D)), 0D)"
              + (" + if(n > succ, (n - succ) * log1p(-least(mu, 1D - 1e-16D)), 0D)" if binomial else " - n * mu"))
    eta = result.coding.predictor(result.terms, result.coefficients)
    far = f"if({result.finite()}, {'abs' if binomial else '-'}({eta}), 0D)"
    return result.coding.cross_sums(fitted, {
        "n": "n", "fitted": "n * mu", "loglik": loglik,
        "information": "n * mu * (1 - mu)" if binomial else "n * mu",
        "hc0": "succ * (1 - mu) * (1 - mu) + (n - succ) * mu * mu"}, far)


def _margins(coding: Coding, fitted: np.ndarray, n: np.ndarray):
    """Fitted totals per level, per level pair of interactions, and weighted by numbers."""
    out = []
    for block, kind in enumerate(coding.kinds):
        if not kind:
            continue
        at = coding.first[block]
        if kind[0] not in coding.levels:
            out.append((kind[0], "sum", float(fitted[0, at])))
            continue
        for i in range(coding.sizes[block]):
            if n[0, at + i] > 0:
                names, rest = [], i
                for c in reversed(kind):
                    rest, own = divmod(rest, len(coding.levels[c]))
                    names.append(coding.levels[c][own])
                out.append((":".join(kind), ":".join(reversed(names)), float(fitted[0, at + i])))
    return tuple(out)


def _cluster(rows: DataFrame, result: Fit, influence: dict[Term, np.ndarray], n: int,
             correction_n: str) -> dict[Term, float]:
    """Scores summed per municipality. A score is linear in the outcome, so records of one municipality and
    one level pattern are one term, and numbering levels and scoring them are short passes of their own. The
    patterns of a large municipality are spread over the tasks, each handing on one row of sums."""
    if not influence:
        return {}
    keys = result.model.keys
    names = [f"u{i}" for i in range(len(influence))]
    scores = [f"(succ - n * mu) * ({result.coding.predictor(result.terms, w)}) as {u}"
              for u, w in zip(names, influence.values())]
    per_town = (collapse_rows(rows, "CODMUNRES", *keys).selectExpr("*", f"{result.mean()} as mu")
                .selectExpr("CODMUNRES", *scores)
                .groupBy("CODMUNRES").agg(F.count("*").alias("cells"), *[F.sum(u).alias(u) for u in names]))
    row = per_town.agg(F.count("*").alias("groups"), F.sum("cells").alias("cells"),
                       *[F.sum(F.col(u) ** 2).alias(u) for u in names]).first()
    if row.groups < 2:
        return {}
    total = n if correction_n == "rows" else row.cells
    factor = row.groups / (row.groups - 1) * (total - 1) / (total - result.n_params)
    return {t: math.sqrt(row[u] * factor) for u, t in zip(names, influence)}


def effects(result: Fit, se_type: str = "model", name: str | None = None) -> list[tuple]:
    """Ratio, interval and p-value of every exposure level against the reference, and why one has none."""
    measure = "OR" if result.model.family == "binomial" else "RR"
    rows = []
    for level in V.RACE_LEVELS[1:]:
        status = result.status.get(level)
        if status is None:
            continue
        term = ((EXPOSURE, level),)
        b, se = result.coefficient(term), result.standard_errors.get(se_type, {}).get(term)
        if status != OK or b is None or se is None:
            numbers = (None, None, None, None)
        else:
            numbers = (math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se),
                       normal_tail(b / se))
        rows.append((name or result.model.name, level, measure, se_type, *numbers,
                     result.aic, result.n, status))
    return rows


EFFECT_SCHEMA = ("modelo string, grupo string, medida string, se_tipo string, estimativa double, "
                 "ic_low double, ic_high double, p_valor double, aic double, n bigint, situacao string")


def normal_tail(z: float) -> float:
    """Two-sided normal p-value."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by its finite sum for whole df."""
    half = x / 2
    if df % 2 == 0:
        term, total, start = math.exp(-half), math.exp(-half), 1.0
    else:
        total, start = math.erfc(math.sqrt(half)), 1.5
        term = 2 * math.sqrt(half / math.pi) * math.exp(-half)
        total += term if df > 1 else 0.0
    terms_left = df // 2 - 1
    for i in range(max(terms_left, 0)):
        term *= half / (start + i)
        total += term
    return min(total, 1.0)


def likelihood_ratio(base: Fit, extended: Fit) -> dict:
    chi2 = 2 * (extended.loglik - base.loglik)
    df = extended.n_params - base.n_params
    return {"lrt_chi2": chi2, "gl": df, "p_valor": chi2_tail(chi2, df),
            "aic_sem": base.aic, "aic_com": extended.aic}


def standardised(cells: DataFrame, result: Fit) -> DataFrame:
    """Mean prediction with the exposure set to each level for all rows, and its difference."""
    if result.coding is None:
        return cells.sparkSession.createDataFrame([], "grupo string, p_ajustada_pct double, dif_pp double")
    data = result.coding.apply(collapse(cells, *result.model.keys), "n")

    def average(level):
        return F.sum(F.expr(f"n * ({result.mean({EXPOSURE: level})})")) / F.sum("n")

    levels = [V.RACE_REFERENCE] + [v for v in V.RACE_LEVELS if v in result.status]
    wide = data.agg(*[average(level).alias(level) for level in levels])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(level).alias("grupo"), (100 * F.col(level)).alias("p_ajustada_pct"),
                 (100 * (F.col(level) - F.col(V.RACE_REFERENCE))).alias("dif_pp"))
        for level in levels])))
