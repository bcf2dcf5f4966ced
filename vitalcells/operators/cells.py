"""Rows collapsed to factor cells: every predictor is discrete, so models need no more.

The cells of an arm are a lattice of a few stored views, all made by one aggregation over grouping sets.
A model rolls up from the smallest view that has its columns.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Arm:
    """One version of the analysis: which education coding, parity rule and samples it uses."""

    name: str
    education: str
    education_code: str
    parity: str
    primary: str
    sensitivity: str


ARMS = {
    "ESCMAE": Arm("ESCMAE", "esc_cat", "ESCMAE", "parid_cat", "in_primary", "in_sens"),
    "ESCMAE2010": Arm("ESCMAE2010", "esc2010_cat", "ESCMAE2010", "parid_cat",
                      "in_primary_2010", "in_sens_2010"),
    "variant": Arm("variant", "esc2010_code", "ESCMAE2010", "parid_known",
                   "in_primary_var", "in_sens_var"),
}

# esc_lin and cons_lin are the codes behind esc_cat and cons_cat; they add no cells.
PRIMARY_KEYS = ("raca", "idade_cat", "esc_cat", "ano_cat", "uf_cat", "esc_lin")
SENSITIVITY_KEYS = ("cons_cat", "parid_cat", "estciv_cat", "cons_lin")
OWN_KEYS = ("singleton", "mesp1trim")


@dataclass(frozen=True)
class View:
    """Cells of one sample by some columns."""

    name: str
    sample: str
    keys: tuple[str, ...]


VIEWS = (
    View("primary", "primary", PRIMARY_KEYS),
    View("primary_singleton", "primary", (*PRIMARY_KEYS, "singleton")),
    View("sens", "sens", (*PRIMARY_KEYS, *SENSITIVITY_KEYS)),
    View("sens_singleton", "sens", (*PRIMARY_KEYS, *SENSITIVITY_KEYS, "singleton")),
    View("sens_mesp1trim", "sens", (*PRIMARY_KEYS, *SENSITIVITY_KEYS, "mesp1trim")),
)


def arm_rows(cohort: DataFrame, arm: Arm) -> DataFrame:
    """The arm's primary records with the columns its models use."""
    return cohort.where(F.col(arm.primary)).select(
        "raca", "idade_cat", F.col(arm.education).alias("esc_cat"), "ano_cat",
        F.col("UF").alias("uf_cat"), "cons_cat", F.col(arm.parity).alias("parid_cat"),
        "estciv_cat", F.col(arm.sensitivity).alias("sens"), "ptb",
        F.col(arm.education_code).alias("esc_lin"), F.col("CONSULTAS").alias("cons_lin"),
        "singleton", "mesp1trim", "CODMUNRES")


def views(rows: DataFrame, wanted: tuple[View, ...] = VIEWS) -> DataFrame:
    """All views of an arm's records in one table, told apart by `view`; a view's other columns are null.

    Records outside the sensitivity sample count as one level of its columns before they are left out,
    so that they make few groups there.
    """
    columns = [*PRIMARY_KEYS, *SENSITIVITY_KEYS, *OWN_KEYS, "sens"]
    known = rows.withColumn("sens", F.coalesce("sens", F.lit(False)))
    inside = known.withColumns({c: F.when(F.col("sens"), F.col(c)) for c in SENSITIVITY_KEYS})
    sets = [[*v.keys, "sens"] if v.sample == "sens" else list(v.keys) for v in wanted]
    # Bit by bit, first column first: 1 where a set leaves the column out.
    numbers = [int("".join("0" if c in keys else "1" for c in columns), 2) for keys in sets]
    name = F.lit(None).cast("string")
    for view, number in zip(wanted, numbers):
        name = F.when(F.col("grouping") == number, view.name).otherwise(name)
    return (inside.groupingSets([[F.col(c) for c in keys] for keys in sets], *columns)
            .agg(F.grouping_id().alias("grouping"), F.sum("ptb").alias("succ"), F.count("*").alias("n"))
            .withColumn("view", name).where("sens is null or sens").drop("grouping", "sens"))


@dataclass
class Lattice:
    """Stored views and their sizes."""

    table: DataFrame
    _sizes: dict[str, int] = field(default_factory=dict)

    @property
    def sizes(self) -> dict[str, int]:
        if not self._sizes:
            self._sizes = {r.view: r["count"] for r in self.table.groupBy("view").count().collect()}
        return self._sizes

    def parent(self, sample: str, columns) -> View:
        """The smallest view of a sample that has the columns."""
        fitting = [v for v in VIEWS if v.sample == sample and set(columns) <= set(v.keys)]
        if not fitting:
            raise KeyError(f"no view of the {sample} sample has {sorted(columns)}")
        return min(fitting, key=lambda v: (self.sizes.get(v.name, 0), len(v.keys)))

    def cells(self, sample: str, columns) -> DataFrame:
        """Cells of the smallest fitting view; other views' files are not read."""
        view = self.parent(sample, columns)
        return self.table.where(F.col("view") == view.name).select(*view.keys, "succ", "n")


def collapse_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("ptb").alias("succ"), F.count("*").alias("n"))


def collapse(cells: DataFrame, *keys: str) -> DataFrame:
    """Roll cells up to fewer keys, dropping cells with an unknown key."""
    return (cells.na.drop(subset=list(keys)).groupBy(*keys)
            .agg(F.sum("succ").alias("succ"), F.sum("n").alias("n")))
