"""Test input: one birth record per lineitem of the star schema, with dirty codes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Valid in Spark SQL and in DuckDB; the SQL checks use the same definition of the input.
RECORD_COLUMNS = {
    "CODMUNRES": "case when l.l_orderkey % 97 = 0 then cast(null as string) else ' ' || cast((11 + c.c_nationkey) * 10000 + c.c_custkey % 20 as string) end",
    "RACACORMAE": "case when l.l_orderkey % 41 = 0 then cast(null as string) when c.c_mktsegment='AUTOMOBILE' then '1' when c.c_mktsegment='BUILDING' then '2' when c.c_mktsegment='FURNITURE' then '3' when c.c_mktsegment='HOUSEHOLD' then '4' else '5' end",
    "SEMAGESTAC": "case when (l.l_orderkey + l.l_linenumber) % 53 = 0 then '' else cast(cast(l.l_quantity as int) as string) end",
    "ESCMAE": "case when l.l_partkey % 83 = 0 then cast(null as string) when l.l_partkey % 37 = 0 then '9' else substr(o.o_orderpriority,1,1) end",
    "ESCMAE2010": "case when l.l_linenumber = 7 then '9' when l.l_suppkey % 29 = 0 then cast(null as string) else cast(l.l_linenumber - 1 as string) end",
    "IDADEMAE": "case when l.l_orderkey % 61 = 0 then 'x' else cast(p.p_size + 12 as string) end",
    "DTNASC": "case when l.l_orderkey % 71 = 0 then '31129999' else cast(day(o.o_orderdate)*1000000 + month(o.o_orderdate)*10000 + year(o.o_orderdate) as string) end",
    "CONSULTAS": "case when l.l_suppkey % 31 = 0 then cast(null as string) when l.l_suppkey % 23 = 0 then '9' else cast(1 + l.l_suppkey % 4 as string) end",
    "QTDFILVIVO": "case when l.l_orderkey % 43 = 0 then cast(null as string) when l.l_orderkey % 47 = 0 then '99' else cast(cast(round(l.l_tax*100) as int) as string) end",
    "ESTCIVMAE": "case when l.l_orderkey % 59 = 0 then cast(null as string) when l.l_returnflag='A' then '1' when l.l_returnflag='R' and l.l_linestatus='O' then '9' when l.l_returnflag='R' then '5' else '2' end",
    "GRAVIDEZ": "case when l.l_linenumber = 7 then '2' else '1' end",
    "MESPRENAT": "case when l.l_suppkey % 19 = 0 then '99' when l.l_suppkey % 17 = 0 then cast(null as string) else cast(1 + l.l_partkey % 9 as string) end",
    "ANO_ARQUIVO": "cast(year(l.l_shipdate) as int)",
}

# Stand-ins for the study settings on this input.
YEARS = (1995, 2001)
PERIODS = {"Bloco(1995-1997)": (1995, 1997), "Bloco(1998-1999)": (1998, 1999),
           "Bloco(2000-2001)": (2000, 2001)}
FOCUS_REGION_NAME = "MIDDLE EAST"
FOCUS_CODES = ("15", "20", "25", "30", "35")


def births_raw(spark: SparkSession, folder: str) -> DataFrame:
    def table(name, alias):
        return spark.read.parquet(f"{folder}/{name}.parquet").alias(alias)

    # Orders meet their customers before the records do, so that the records are not shuffled for them.
    placed = table("orders", "o").join(table("customer", "c"), F.expr("o.o_custkey = c.c_custkey"))
    joined = (
        table("lineitem", "l")
        .join(placed, F.expr("l.l_orderkey = o.o_orderkey"))
        .join(table("part", "p"), F.expr("l.l_partkey = p.p_partkey"))
    )
    return joined.select(
        "l.l_orderkey", "l.l_linenumber",
        *[F.expr(sql).alias(name) for name, sql in RECORD_COLUMNS.items()])


def states(spark: SparkSession, folder: str) -> DataFrame:
    """State code, state label and macro-region of the test input."""
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    region = spark.read.parquet(f"{folder}/region.parquet")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        (F.col("n_nationkey") + 11).cast("string").alias("uf_code"),
        F.col("n_name").alias("UF"), F.col("r_name").alias("regiao"))
