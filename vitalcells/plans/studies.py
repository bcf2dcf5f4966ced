"""The model studies: which models run on which cells."""

import math
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import accumulate
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.operators.cells import VIEWS, Lattice
from vitalcells.operators.glm import (EFFECT_SCHEMA, Fit, Model, effects, fit, levels_of,
                                      likelihood_ratio, standardised)

FACTORS = [factor for _, factor in V.LADDER]
M1, M5, M8 = ("raca",), tuple(FACTORS[:5]), tuple(FACTORS)
# Fits sent to the cluster at the same time: each is a chain of short jobs.
PARALLEL_FITS = 4


def ladder_models(prefix: str = "") -> list[Model]:
    steps = accumulate(((f,) for f in FACTORS), lambda done, new: done + new)
    return [Model(prefix + name, factors) for (name, _), factors in zip(V.LADDER, steps)]


def without(factors: tuple[str, ...], *drop: str) -> tuple[str, ...]:
    return tuple(f for f in factors if f not in drop)


def sample_of(factors: tuple[str, ...]) -> str:
    """M6 and later need the sensitivity sample."""
    return "sens" if set(factors) & {"cons_cat", "parid_cat", "estciv_cat"} else "primary"


@dataclass(frozen=True)
class Task:
    """One fit: a model, the cells it sees, and the errors it needs."""

    model: Model
    sample: str
    where: str = "true"
    robust: bool = False
    cluster: bool = False
    correction_n: str = "rows"


@dataclass
class Run:
    """Fits on the cells of one arm and region, each done once."""

    cells: Lattice
    rows: DataFrame
    years: tuple[int, int]
    periods: dict[str, tuple[int, int]]
    region: str = "true"
    _done: dict[Task, Fit] = field(default_factory=dict)
    _levels: dict[str, dict[str, tuple[str, ...]]] = field(default_factory=dict)
    _locks: dict = field(default_factory=lambda: defaultdict(RLock))

    def _columns(self, task: Task) -> set[str]:
        """Columns that a task's model and conditions use."""
        named = set(re.findall(r"\w+", f"{self.region} {task.where}"))
        return {*task.model.keys, *named & {k for v in VIEWS for k in v.keys}}

    def cells_of(self, task: Task) -> DataFrame:
        return self.cells.cells(task.sample, self._columns(task)).where(self.region).where(task.where)

    def rows_of(self, task: Task) -> DataFrame:
        rows = self.rows.where(self.region).where(task.where)
        return rows.where("sens") if task.sample == "sens" else rows

    def _levels_of(self, task: Task) -> dict[str, tuple[str, ...]]:
        """Levels of the view a task reads, listed once for all its models."""
        view = self.cells.parent(task.sample, self._columns(task))
        with self._locks[view.name]:
            if view.name not in self._levels:
                factors = tuple(k for k in view.keys if not k.endswith("_lin") and k != "singleton")
                self._levels[view.name] = levels_of(self.cells.cells(view.sample, view.keys), factors)
        return self._levels[view.name]

    def _fit(self, task: Task) -> Fit:
        with self._locks[task]:
            if task not in self._done:
                rows = self.rows_of(task) if task.cluster else None
                view = self.cells.parent(task.sample, self._columns(task))
                self._done[task] = fit(self.cells_of(task), task.model, task.robust, rows,
                                       task.correction_n, self._levels_of(task), self.cells.sizes.get(view.name, 0))
        return self._done[task]

    def fit_all(self, tasks: list[Task]) -> list[Fit]:
        with ThreadPoolExecutor(PARALLEL_FITS) as pool:
            return list(pool.map(self._fit, tasks))

    def fit(self, task: Task) -> Fit:
        return self._fit(task)

    # Studies, each a list of tasks.

    def ladder(self) -> list[Task]:
        return [Task(m, sample_of(m.factors)) for m in ladder_models()]

    def or_vs_rr(self) -> list[Task]:
        """Logistic with cluster errors, and Poisson with HC0 and with cluster errors."""
        tasks = []
        for name, factors in (("M1", M1), ("M5", M5), ("M8", M8)):
            sample = sample_of(factors)
            tasks.append(Task(Model(f"{name}_Logistic", factors), sample, cluster=True))
            tasks.append(Task(Model(f"{name}_Poisson", factors, family="poisson"), sample,
                              robust=True, cluster=True))
        return tasks

    def coding(self) -> list[Task]:
        """Education and visits as categories or as numbers."""
        def swap(factors, linear):
            return without(factors, *linear), tuple({"esc_cat": "esc_lin", "cons_cat": "cons_lin"}[x]
                                                    for x in linear)

        specs = [("M5_Lin_Esc_artigo", M5, ("esc_cat",)),
                 ("M8_Lin_Esc_Lin_Cons", M8, ("esc_cat", "cons_cat")),
                 ("M8_Cat_Esc_Lin_Cons", M8, ("cons_cat",)),
                 ("M8_Lin_Esc_Cat_Cons", M8, ("esc_cat",)),
                 ("M8_Cat_Esc_Cat_Cons", M8, ())]
        return [Task(Model(name, *swap(factors, linear)), sample_of(factors))
                for name, factors, linear in specs]

    def interaction(self) -> list[Task]:
        pair = (("raca", "uf_cat"),)
        return [Task(Model("M5_sem_interacao", M5), "primary"),
                Task(Model("M5_com_interacao", M5, interactions=pair), "primary")]

    def interaction_saturated(self) -> list[Task]:
        return [Task(Model("M1_sem_interacao", M1), "primary"),
                Task(Model("saturado", ("raca", "uf_cat"), interactions=(("raca", "uf_cat"),)),
                     "primary")]

    def stratified(self, states: list[str]) -> list[Task]:
        return [Task(Model(f"{name}_{uf}", without(factors, "uf_cat")), sample_of(factors),
                     f"uf_cat = '{uf}'")
                for uf in states for name, factors in (("M5", M5), ("M8", M8))]

    def yearly(self) -> list[Task]:
        return [Task(Model(f"Ano_{year}", without(M5, "ano_cat")), "primary", f"ano_cat = '{year}'")
                for year in range(self.years[0], self.years[1] + 1)]

    def blocks(self) -> list[Task]:
        return [Task(Model(name, M5), "primary", f"ano_cat between '{low}' and '{high}'")
                for name, (low, high) in self.periods.items()]

    def last_year(self) -> list[Task]:
        last = self.years[1]
        pairs = [("sem", f"ano_cat <> '{last}'"), ("com", "true")]
        return [Task(Model(f"{name}_{tag}{last}", factors), sample_of(factors), where)
                for tag, where in pairs for name, factors in (("M5", M5), ("M8", M8))]

    def singletons(self) -> list[Task]:
        return [Task(m, sample_of(m.factors), "singleton") for m in ladder_models()]

    def prenatal(self) -> list[Task]:
        """First-trimester start against visits, on the rows where the month is known."""
        base = without(M8, "cons_cat")
        return [Task(Model("M_MESPRENAT_1trim", (*base, "mesp1trim")), "sens", "mesp1trim is not null"),
                Task(Model("M_CONSULTAS_categorica", M8), "sens", "mesp1trim is not null")]

    def national(self) -> list[Task]:
        return [Task(Model(f"{name}_{tag}", factors, family=family), sample_of(factors))
                for name, factors in (("M1", M1), ("M5", M5), ("M8", M8))
                for tag, family in (("logit", "binomial"), ("poisson_RR", "poisson"))]

    def national_cluster(self) -> list[Task]:
        """The finite-sample factor counts cells here, as the fit's observations are cells."""
        return [Task(Model("M1_logit_cluster_muni", M1), "primary", cluster=True,
                     correction_n="cells")]

    def variant(self) -> list[Task]:
        by_name = {m.name.split("_")[0]: m for m in ladder_models()}
        return [Task(Model(name, by_name[name].factors), sample_of(by_name[name].factors))
                for name in V.PUBLISHED_FOCAL_OR]


def effect_table(spark: SparkSession, fits: list[tuple[Fit, str]]) -> DataFrame:
    rows = [row for result, se_type in fits for row in effects(result, se_type)]
    return spark.createDataFrame(rows, EFFECT_SCHEMA)


def margin_table(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """Fitted outcome totals per level: at the optimum they equal the observed totals."""
    rows = [(f.model.name, factor, level, float(value))
            for f in fits for factor, level, value in f.margins]
    return spark.createDataFrame(rows, "modelo string, fator string, nivel string, ajustado double")


def design_audit(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """Parameters and AIC per model, which factors are in, and whether AIC moved."""
    rows = [(f.model.name, f.n_params, f.aic, "parid_cat" in f.model.factors,
             "estciv_cat" in f.model.factors,
             None if i == 0 else abs(f.aic - fits[i - 1].aic) >= 0.01)
            for i, f in enumerate(fits)]
    return spark.createDataFrame(
        rows, "modelo string, n_params int, aic double, tem_paridade boolean, "
              "tem_estado_civil boolean, aic_mudou boolean")


def focal_ratios(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """The focal group's ratio of each fit, null where it has none."""
    rows = [(f.model.name, None if V.RACE_FOCAL in f.separated or f.log_ratio(V.RACE_FOCAL) is None
             else math.exp(f.log_ratio(V.RACE_FOCAL))) for f in fits]
    return spark.createDataFrame(rows, "modelo string, focal_or double")


def interaction_test(spark: SparkSession, base: Fit, extended: Fit) -> DataFrame:
    row = likelihood_ratio(base, extended)
    return spark.createDataFrame(
        [tuple(row.values())],
        "lrt_chi2 double, gl int, p_valor double, aic_sem double, aic_com double")


def adjusted_probabilities(run: Run, task: Task) -> DataFrame:
    return standardised(run.cells_of(task), run.fit(task))


def by_year(effects_df: DataFrame) -> DataFrame:
    """Yearly model rows with their year; block rows keep a null year."""
    year = F.when(F.col("modelo").startswith("Ano_"), F.split("modelo", "_")[1].cast("int"))
    return effects_df.withColumn("ano", year)
