"""Yearly record files: load and normalise, inventory, schema drift, variable dictionary."""

from collections.abc import Callable, Mapping
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitalcells import fixed_values as V
from vitalcells.functions import normalize as N
from vitalcells.storage import exists, size_of, small


def normalise(raw: DataFrame, file_year: Column, window: tuple[int, int],
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns from raw ones, whatever type the file stores them in."""
    types = {field.name: field.dataType for field in raw.schema}
    # Cleaned first, so that the expressions below read each cleaned value and not its recipe.
    text = raw.select(*keep, file_year.cast("int").alias("ANO_ARQUIVO"),
                      *[N.clean(F.col(name), types[name]).alias(name) for name in V.COLUMNS])
    text = text.withColumns({"CODMUNRES": N.pad_left(F.col("CODMUNRES"), 6), "ANO": N.date_year(F.col("DTNASC"))})
    return text.select(
        *keep,
        "CODMUNRES",
        N.state_code(F.col("CODMUNRES")).alias("uf_code"),
        *[N.number(F.col(name)).alias(name) for name in V.NUMERIC_COLUMNS],
        N.year_or_file_year(F.col("ANO"), F.col("ANO_ARQUIVO"), window).alias("ANO"),
        "ANO_ARQUIVO")


def with_states(births: DataFrame, states: DataFrame) -> DataFrame:
    """Add state and region labels; unknown codes keep null labels.

    The key is never null, since for one that may be Spark tests the code on the uncleaned text first,
    which cleans it several times over.
    """
    labels = states.select(F.col("uf_code").alias("_code"), *[c for c in states.columns if c != "uf_code"])
    joined = births.join(labels, F.coalesce("uf_code", F.lit("")) == F.col("_code"), "left").drop("_code")
    return joined.select("uf_code", *[c for c in joined.columns if c != "uf_code"])


def national_states(spark: SparkSession) -> DataFrame:
    rows = [(code, uf, region) for region, states in V.STATES.items()
            for code, uf in states.items()]
    return small(spark.createDataFrame(rows, "uf_code string, UF string, regiao string"), len(rows))


def focus_codes() -> list[str]:
    return list(V.STATES[V.FOCUS_REGION])


FILE_YEAR = "_file_year"


class YearFiles(Mapping):
    """Yearly files that exist, by year. Files of the same schema are read by one scan, which tells the
    year from the file's own path, so a plan has a scan per schema and not one per file."""

    def __init__(self, spark: SparkSession, paths: dict[int, str], schemas: dict[int, StructType]):
        self.spark, self.paths, self.schemas = spark, paths, schemas

    def __len__(self) -> int:
        return len(self.paths)

    def __iter__(self):
        return iter(self.paths)

    def __getitem__(self, year: int) -> DataFrame:
        """One year alone."""
        return self.spark.read.schema(self.schemas[year]).parquet(self.paths[year])

    def having(self, column: str) -> "YearFiles":
        """The files that have a column."""
        years = [y for y, schema in self.schemas.items() if column in schema.names]
        return YearFiles(self.spark, {y: self.paths[y] for y in years}, {y: self.schemas[y] for y in years})

    @property
    def tables(self) -> list[DataFrame]:
        """One table per schema, with the file's year as FILE_YEAR."""
        groups: dict[tuple, list[int]] = {}
        for year, schema in self.schemas.items():
            groups.setdefault(tuple((f.name, f.dataType.simpleString()) for f in schema), []).append(year)
        out = []
        for years in groups.values():
            table = self.spark.read.schema(self.schemas[years[0]]).parquet(*[self.paths[y] for y in years])
            out.append(table.withColumn(FILE_YEAR, self._year(years)))
        return out

    def _year(self, years: list[int]) -> Column:
        if len(years) == 1:
            return F.lit(years[0])
        path, year = F.col("_metadata.file_path"), F.lit(None).cast("int")
        for y in years:
            name = "/" + quote(self.paths[y].rstrip("/").rsplit("/", 1)[-1], safe="!$&'()*+,;=:@")
            year = F.when(path.contains(name + "/") | path.endswith(name), y).otherwise(year)
        return year

    def united(self, one: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A projection of every table, united."""
        return reduce(DataFrame.unionByName, [one(table) for table in self.tables])


def open_years(spark: SparkSession, expected: dict[int, str]) -> YearFiles:
    """The expected yearly files that exist, each with its schema read once."""
    paths = {year: path for year, path in expected.items() if exists(spark, path)}
    return YearFiles(spark, paths, {year: spark.read.parquet(path).schema for year, path in paths.items()})


def columns_of(file: DataFrame, columns) -> DataFrame:
    """Only the named columns of a file; a name given twice is read once."""
    return file.select(*dict.fromkeys(columns))


def load_years(files: YearFiles, states: DataFrame, codes: list[str],
               window: tuple[int, int] = V.YEARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """All yearly files of the given state codes as one table.

    Files are normalised before the union because their column types differ.
    """
    births = files.united(lambda table: normalise(
        columns_of(table, [*keep, *V.COLUMNS, FILE_YEAR]), F.col(FILE_YEAR), window, keep))
    births = births.where(F.col("uf_code").isin(codes))
    return with_states(births, states)


def scan_years(files: YearFiles, columns) -> DataFrame:
    """The cleaned text of some columns of every year; a column a year lacks is null."""
    def one(table):
        types = {f.name: f.dataType for f in table.schema}
        return table.select(
            F.col(FILE_YEAR).alias("ano"),
            *[(N.clean(F.col(c), types[c]) if c in types else F.lit(None).cast("string")).alias(c)
              for c in columns])

    return files.united(one)


def schema_rows(spark: SparkSession, files: YearFiles) -> DataFrame:
    """One row per (year, column) with its position and type, from the files' schemas alone."""
    rows = [(year, position, field.name, field.dataType.simpleString())
            for year, schema in files.schemas.items() for position, field in enumerate(schema)]
    return spark.createDataFrame(rows, "ano int, posicao int, coluna string, tipo string")


def with_filled(schemas: DataFrame, files: YearFiles) -> DataFrame:
    """Schema rows with the number of values that are not null (preenchidos), counted in one pass."""
    def one(table):
        columns = [c for c in table.columns if c != FILE_YEAR]
        counts = table.groupBy(F.col(FILE_YEAR).alias("ano")).agg(*[F.count(c).alias(c) for c in columns])
        return counts.select("ano", F.inline(F.array(*[
            F.struct(F.lit(c).alias("coluna"), F.col(c).alias("preenchidos")) for c in columns])))

    return schemas.join(files.united(one), ["ano", "coluna"])


def inventory(spark: SparkSession, expected: dict[int, str],
              files: YearFiles) -> DataFrame:
    """Expected years with rows, columns and size; absent files are flagged, and a file without rows has 0.

    Counting needs no column, and sizes come from the file system's own listing.
    """
    counts = files.united(lambda table: table.groupBy(F.col(FILE_YEAR).alias("ano"))
                          .agg(F.count("*").alias("n_linhas")))
    known = [(year, len(files.schemas[year]) if year in files else None,
              round(size_of(spark, path) / 1e6, 1) if year in files else None)
             for year, path in expected.items()]
    years = spark.createDataFrame(known, "ano int, n_colunas bigint, tamanho_mb double")
    found = F.col("n_colunas").isNotNull()
    return years.join(counts, "ano", "left").select(
        "ano", found.alias("existe"), F.when(found, F.coalesce("n_linhas", F.lit(0))).alias("n_linhas"),
        "n_colunas", "tamanho_mb",
        F.when(found, "presente").otherwise("ausente").alias("escopo"))


def _year_count(schemas: DataFrame) -> int:
    return schemas.select("ano").distinct().count()


def _values(schemas: DataFrame) -> list[Column]:
    """The values in all years, where the schema rows carry counts."""
    return [F.sum("preenchidos").alias("preenchidos")] if "preenchidos" in schemas.columns else []


def columns_not_everywhere(schemas: DataFrame) -> DataFrame:
    """Columns that some years lack, with the years that have them and their values in all."""
    years = F.array_sort(F.collect_set(F.col("ano").cast("string")))
    return (schemas.groupBy("coluna")
            .agg(F.count_distinct("ano").alias("n_anos"), F.array_join(years, ",").alias("anos"), *_values(schemas))
            .where(F.col("n_anos") < _year_count(schemas)))


def type_drift(schemas: DataFrame, years: list[int]) -> DataFrame:
    """Columns of all years whose type changes between years: one type column per year, and the
    values in all."""
    types = [F.max(F.when(F.col("ano") == y, F.col("tipo"))).alias(f"ano_{y}") for y in years]
    everywhere = F.count_distinct("ano") == len(years)
    return (schemas.groupBy("coluna")
            .agg(*types, *_values(schemas),
                 ((F.count_distinct("tipo") > 1) & everywhere).alias("drifts"))
            .where("drifts").drop("drifts"))


def column_list(schemas: DataFrame) -> DataFrame:
    """Columns of each year in file order, and as a list how many values each has."""
    ordered = F.array_sort(F.collect_list(F.struct("posicao", "coluna", "preenchidos")))
    return schemas.groupBy("ano").agg(
        F.count("*").alias("n_colunas"),
        F.array_join(F.transform(ordered, lambda e: e["coluna"]), ",").alias("colunas"),
        F.array_join(F.transform(ordered, lambda e: e["preenchidos"].cast("string")), ",").alias("preenchidos"))


def variable_dictionary(spark: SparkSession, schemas: DataFrame) -> DataFrame:
    """Each study role with its column, whether all, some or no years have it, and its values in all."""
    roles = spark.createDataFrame(list(V.ROLES) + [("Perfil", c) for c in ("GESTACAO", "CONSPRENAT")],
                                  "papel string, alvo string")
    seen = schemas.groupBy(F.col("coluna").alias("alvo")).agg(
        F.count_distinct("ano").alias("n"), F.sum("preenchidos").alias("preenchidos"))
    n = F.coalesce("n", F.lit(0))
    return roles.join(seen, "alvo", "left").select(
        "papel", "alvo", n.alias("n_anos"),
        F.when(n == 0, "ausente").when(n == _year_count(schemas), "todos").otherwise("parcial")
        .alias("presenca"), F.coalesce("preenchidos", F.lit(0)).alias("preenchidos"))
