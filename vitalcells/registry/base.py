"""Query registration and the tables the queries share."""

import inspect
import re
import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalcells import fixed_values
from vitalcells.fixed_values import PROFILED
from vitalcells.functions import derive, normalize
from vitalcells.operators import cells as C
from vitalcells.operators import cohort as K
from vitalcells.plans import cube
from vitalcells.plans.studies import Run
from vitalcells.sources import star_births as S
from vitalcells.sources import yearly
from vitalcells.sources.yearly import (YearFiles, normalise, open_years, scan_years, schema_rows,
                                       with_filled, with_states)
from vitalcells.storage import Store, is_written, lasting_folder, shared_folder, small, stored

IDS = ("l_orderkey", "l_linenumber")
NUMERIC_FILE_YEAR = 2000
GESTACAO_FROM = 1998
EXPECTED_FILE_YEARS = range(1994, 2003)
# State codes have two digits.
MAX_STATES = 100


class Workspace:
    """Tables of one input folder, built when first needed and shared by the queries."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.root = f"{shared_folder(spark)}/{re.sub('[^A-Za-z0-9.]+', '_', self.folder).strip('_')}"
        self._runs: dict[tuple, Run] = {}
        self._lattices: dict[str, C.Lattice] = {}
        self._lock = threading.RLock()

    @cached_property
    def store(self) -> Store:
        """Tables that the next process finds again: named by the sources' state and the code behind them."""
        sources = [f"{self.folder}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part", "nation", "region")]
        rules = [inspect.getsource(m) for m in (S, K, C, cube, derive, normalize, yearly, fixed_values)]
        return Store(self.spark, lasting_folder(self.spark), sources, "\n".join(rules))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        """Raw records with row identity."""
        return stored(self.spark, f"{self.root}/births_raw",
                      lambda: S.births_raw(self.spark, self.folder))

    @cached_property
    def states(self) -> DataFrame:
        return small(S.states(self.spark, self.folder), MAX_STATES)

    @cached_property
    def focus_states(self) -> list[str]:
        """Labels of the focus states, in code order; at most one per state."""
        rows = self.states.where(F.col("uf_code").isin(*S.FOCUS_CODES)).orderBy("uf_code").collect()
        return [r.UF for r in rows]

    def births(self, keep=IDS) -> DataFrame:
        """Normalised records of all states, computed from the raw text."""
        births = normalise(self.raw, F.col("ANO_ARQUIVO"), S.YEARS, keep)
        known = with_states(births, self.states)
        return known.where(F.col("UF").isNotNull())

    @cached_property
    def rules(self) -> dict[str, K.Rules]:
        return {"ESCMAE": K.main_rules("ESCMAE", S.YEARS),
                "ESCMAE2010": K.main_rules("ESCMAE2010", S.YEARS, "_2010"),
                "variant": K.variant_rules(S.YEARS)}

    @cached_property
    def cohort(self) -> DataFrame:
        """All records with sample flags and categories. Numbers and flags are written once; readers derive
        the categories they name. Deriving all of them in the write made its code too long for the JVM to
        compile, and folders by region made every task sort its records."""
        def build():
            flagged = self.births()
            for rules in self.rules.values():
                flagged = K.with_flags(flagged, rules)
            return flagged

        return K.with_categories(self.store.table("records", build))

    @cached_property
    def cube(self) -> DataFrame:
        """Counts of all states by year and exposure group, for both teams' samples, from one pass."""
        arms = {"ours": C.ARMS["ESCMAE"], "theirs": C.ARMS["variant"]}
        return self.store.table("cube", lambda: cube.measure_cube(
            self.cohort, self.rules["ESCMAE"], {p: (arm.primary, arm.sensitivity) for p, arm in arms.items()}))

    @property
    def focus_cube(self) -> DataFrame:
        return self.cube.where(F.col("UF").isin(self.focus_states))

    @property
    def focus(self) -> DataFrame:
        # The region's name is tested on the stored text, before the codes.
        return self.cohort.where((F.col("regiao") == S.FOCUS_REGION_NAME) & F.col("uf_code").isin(*S.FOCUS_CODES))

    def run(self, arm: str = "ESCMAE", national: bool = False) -> Run:
        with self._lock:
            if (arm, national) not in self._runs:
                spec = C.ARMS[arm]
                rows = C.arm_rows(self.cohort, spec)
                if arm not in self._lattices:
                    self._lattices[arm] = C.Lattice(self.store.table(
                        f"cells_{arm}", lambda: C.views(rows), ("view",)))
                names = ", ".join(f"'{uf}'" for uf in self.focus_states)
                region = "true" if national else f"uf_cat in ({names})"
                self._runs[arm, national] = Run(self._lattices[arm], rows, S.YEARS, S.PERIODS, region)
            return self._runs[arm, national]

    @cached_property
    def yearly_paths(self) -> dict[int, str]:
        """Raw records as yearly files: one year stores numbers, and one column starts late."""
        folder = f"{self.root}/yearly"
        late = F.col("ANO_ARQUIVO") >= GESTACAO_FROM
        rows = self.raw.withColumn("GESTACAO", F.when(
            F.col("SEMAGESTAC") != "", F.col("SEMAGESTAC").cast("int") % 6 + 1).cast("string"))
        numeric = [F.expr(f"try_cast(nullif(trim({c}), '') as double)").alias(c)
                   for c in (*S.RECORD_COLUMNS, "GESTACAO") if c != "ANO_ARQUIVO"]
        numeric_year = F.col("ANO_ARQUIVO") == NUMERIC_FILE_YEAR
        writes = {
            "early": rows.where(~late).drop("GESTACAO"),
            "late": rows.where(late & ~numeric_year),
            "numbers": rows.where(numeric_year).select(*IDS, *numeric, "ANO_ARQUIVO"),
        }
        for name, part in writes.items():
            if not is_written(self.spark, f"{folder}/{name}"):
                part.write.mode("overwrite").partitionBy("ANO_ARQUIVO").parquet(f"{folder}/{name}")

        def part_of(year):
            if year == NUMERIC_FILE_YEAR:
                return "numbers"
            return "early" if year < GESTACAO_FROM else "late"

        return {y: f"{folder}/{part_of(y)}/ANO_ARQUIVO={y}" for y in EXPECTED_FILE_YEARS}

    @cached_property
    def files(self) -> YearFiles:
        return open_years(self.spark, self.yearly_paths)

    @cached_property
    def schemas(self) -> DataFrame:
        """One row per column of every yearly file."""
        return schema_rows(self.spark, self.files)

    @cached_property
    def filled(self) -> DataFrame:
        """The schema rows with the values that each column has."""
        return stored(self.spark, f"{self.root}/filled", lambda: with_filled(self.schemas, self.files))

    @cached_property
    def profiled(self) -> DataFrame:
        """Cleaned text of the profiled columns of every year."""
        return scan_years(self.files, PROFILED)


_workspaces: dict[tuple[str, str], Workspace] = {}
_lock = threading.Lock()


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    with _lock:
        if key not in _workspaces:
            _workspaces[key] = Workspace(spark, folder)
        return _workspaces[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query on the workspace, and the SQL giving the same rows."""
    def register(build: Callable[[Workspace], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: build(workspace(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return build

    return register


# SQL side: the same input definition, and an independent normalisation and cohort.

_RAW = "births_raw as (select l.l_orderkey, l.l_linenumber, " + ", ".join(
    f"{sql} as {name}" for name, sql in S.RECORD_COLUMNS.items()) + """
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
  join customer c on o.o_custkey = c.c_custkey join part p on l.l_partkey = p.p_partkey)"""


def _num(column: str) -> str:
    return (f"case when regexp_full_match(trim({column}), '[+-]?[0-9.]+') "
            f"then try_cast(trim({column}) as double) end as {column}")


_NORM = """
normed as (
  select l_orderkey, l_linenumber, ANO_ARQUIVO, trim(CODMUNRES) as code, """ + ", ".join(
    _num(c) for c in ("RACACORMAE", "SEMAGESTAC", "ESCMAE", "ESCMAE2010", "IDADEMAE", "CONSULTAS",
                      "QTDFILVIVO", "ESTCIVMAE", "GRAVIDEZ", "MESPRENAT")) + """,
    try_cast(right(repeat('0', greatest(8 - length(trim(DTNASC)), 0)) || trim(DTNASC), 4) as int) as dt_year
  from births_raw),
births as (
  select n.* exclude (code, dt_year),
    repeat('0', greatest(6 - length(code), 0)) || code as CODMUNRES,
    left(repeat('0', greatest(6 - length(code), 0)) || code, 2) as uf_code,
    t.n_name as UF, g.r_name as regiao,
    case when dt_year >= 1995 and dt_year <= 2001 then dt_year else ANO_ARQUIVO end as ANO
  from normed n
  join nation t on left(repeat('0', greatest(6 - length(code), 0)) || code, 2) = cast(11 + t.n_nationkey as varchar)
  join region g on g.r_regionkey = t.n_regionkey)"""

_COHORT = """
checked as (
  select *,
    coalesce(RACACORMAE in (1, 2, 4, 5), false) as ok_race,
    coalesce(SEMAGESTAC >= 22 and SEMAGESTAC <= 44, false) as ok_weeks,
    coalesce(ESCMAE >= 1 and ESCMAE <= 5, false) as ok_edu,
    coalesce(ESCMAE2010 >= 0 and ESCMAE2010 <= 5, false) as ok_edu2010,
    ESCMAE2010 is not null as ok_eduvar,
    coalesce(IDADEMAE >= 10 and IDADEMAE <= 60, false) as ok_age,
    CONSULTAS is not null and coalesce(ESTCIVMAE <> 9, false) as ok_sens,
    CONSULTAS is not null and QTDFILVIVO is not null and ESTCIVMAE is not null as ok_sensvar
  from births),
cohort as (
  select *,
    ok_race and ok_weeks and ok_edu and ok_age as in_primary,
    ok_race and ok_weeks and ok_edu and ok_age and ok_sens as in_sens,
    ok_race and ok_weeks and ok_edu2010 and ok_age as in_primary_2010,
    ok_race and ok_weeks and ok_edu2010 and ok_age and ok_sens as in_sens_2010,
    ok_race and ok_weeks and ok_eduvar and ok_age as in_primary_var,
    ok_race and ok_weeks and ok_eduvar and ok_age and ok_sensvar as in_sens_var,
    case RACACORMAE when 1 then 'Branca' when 2 then 'Preta' when 4 then 'Parda' when 5 then 'Indigena' end as raca,
    case when SEMAGESTAC < 37 then 1 when SEMAGESTAC >= 37 then 0 end as ptb,
    case when IDADEMAE > 9 and IDADEMAE <= 19 then '<20' when IDADEMAE > 19 and IDADEMAE <= 34 then '20-34'
         when IDADEMAE > 34 and IDADEMAE <= 60 then '>=35' end as idade_cat,
    case ESCMAE when 1 then 'Nenhuma' when 2 then '1-3anos' when 3 then '4-7anos' when 4 then '8-11anos' when 5 then '12mais' end as esc_cat,
    case ESCMAE2010 when 0 then '0_Sem' when 1 then '1_FundI' when 2 then '2_FundII' when 3 then '3_Medio' when 4 then '4_SupInc' when 5 then '5_SupComp' end as esc2010_cat,
    cast(cast(ESCMAE2010 as int) as varchar) as esc2010_code,
    cast(ANO as varchar) as ano_cat,
    case CONSULTAS when 1 then 'None' when 2 then '1-3' when 3 then '4-6' when 4 then '7plus' when 9 then 'Ignorado' end as cons_cat,
    case when QTDFILVIVO is null then '0' when QTDFILVIVO = 99 then 'Ign' when QTDFILVIVO >= 3 then '3' else cast(cast(QTDFILVIVO as int) as varchar) end as parid_cat,
    case when QTDFILVIVO is null then null when QTDFILVIVO = 99 then 'Ign' when QTDFILVIVO >= 3 then '3' else cast(cast(QTDFILVIVO as int) as varchar) end as parid_known,
    cast(cast(ESTCIVMAE as int) as varchar) as estciv_cat,
    GRAVIDEZ = 1 as singleton,
    case when MESPRENAT >= 1 and MESPRENAT <= 3 then '1' when MESPRENAT > 3 and MESPRENAT <= 9 then '0' end as mesp1trim,
    uf_code in ('15', '20', '25', '30', '35') as in_focus
  from checked),
focus as (select * from cohort where in_focus)"""


def with_tables(sql: str) -> str:
    """Put the shared SQL tables a check uses in front of it."""
    body = sql.strip()
    prelude = []
    if re.search(r"\b(births_raw|births|cohort|focus)\b", body):
        prelude.append(_RAW)
    if re.search(r"\b(births|cohort|focus)\b", body):
        prelude.append(_NORM)
    if re.search(r"\b(cohort|focus)\b", body):
        prelude.append(_COHORT)
    head = ",".join(prelude)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}" if head else body
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:]}" if head else body
    return f"with {head} {body}" if head else body


def r6(sql: str) -> str:
    return f"round(cast({sql} as double), 6)"


def focus_sql_list() -> str:
    return ", ".join(f"'{c}'" for c in S.FOCUS_CODES)
