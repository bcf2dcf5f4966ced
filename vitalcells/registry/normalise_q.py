"""Normalisation and scalar expressions over every raw record."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalcells import fixed_values as V
from vitalcells.functions import derive as D
from vitalcells.functions import normalize as N
from vitalcells.functions import text as X
from vitalcells.operators.cohort import period
from vitalcells.operators.glm import order_levels
from vitalcells.registry.base import IDS, Workspace, query
from vitalcells.sources import star_births as S
from vitalcells.sources.yearly import load_years

STRING = T.StringType()


def clean(name):
    return N.clean(F.col(name), STRING)


@query("b01_clean_text", """
select l_orderkey, l_linenumber, nullif(trim(CODMUNRES), '') as codmunres,
  nullif(trim(SEMAGESTAC), '') as semagestac, nullif(trim(IDADEMAE), '') as idademae
from births_raw""")
def _(w: Workspace):
    return w.raw.select(*IDS, *[clean(c).alias(c.lower())
                                for c in ("CODMUNRES", "SEMAGESTAC", "IDADEMAE")])


@query("b02_lenient_number", """
select l_orderkey, l_linenumber, try_cast(nullif(trim(IDADEMAE), '') as double) as idade,
  try_cast(nullif(trim(SEMAGESTAC), '') as double) as semanas,
  try_cast(nullif(trim(QTDFILVIVO), '') as double) as filhos
from births_raw""")
def _(w):
    return w.raw.select(*IDS, N.number(clean("IDADEMAE")).alias("idade"),
                        N.number(clean("SEMAGESTAC")).alias("semanas"),
                        N.number(clean("QTDFILVIVO")).alias("filhos"))


@query("b03_zero_pad", """
select l_orderkey, l_linenumber,
  case when length(DTNASC) < 8 then lpad(DTNASC, 8, '0') else DTNASC end as data8,
  case when length(trim(CODMUNRES)) < 4 then lpad(trim(CODMUNRES), 4, '0') else trim(CODMUNRES) end as mun4,
  case when length(trim(CODMUNRES)) < 8 then lpad(trim(CODMUNRES), 8, '0') else trim(CODMUNRES) end as mun8
from births_raw""")
def _(w):
    return w.raw.select(*IDS, N.pad_left(clean("DTNASC"), 8).alias("data8"),
                        N.pad_left(clean("CODMUNRES"), 4).alias("mun4"),
                        N.pad_left(clean("CODMUNRES"), 8).alias("mun8"))


@query("b04_state_prefix", """
select l_orderkey, l_linenumber, left(trim(CODMUNRES), 2) as uf2 from births_raw""")
def _(w):
    return w.raw.select(*IDS, N.state_code(N.pad_left(clean("CODMUNRES"), 6)).alias("uf2"))


@query("b05_code_labels", """
select l_orderkey, l_linenumber, raca, esc_cat, esc2010_cat, cons_cat, UF as uf, regiao from cohort""")
def _(w):
    return w.births().select(
        *IDS, N.label(F.col("RACACORMAE"), V.RACE).alias("raca"),
        D.education("ESCMAE").alias("esc_cat"), D.education("ESCMAE2010").alias("esc2010_cat"),
        D.visits(F.col("CONSULTAS")).alias("cons_cat"), F.col("UF").alias("uf"), "regiao")


@query("b06_birth_year", """
select l_orderkey, l_linenumber,
  cast(right(DTNASC, 4) as int) as ano_dt from births_raw""")
def _(w):
    return w.raw.select(*IDS, N.date_year(clean("DTNASC")).alias("ano_dt"))


@query("b07_year_or_file_year", """
select l_orderkey, l_linenumber,
  case when cast(right(DTNASC, 4) as int) between 1995 and 2001 then cast(right(DTNASC, 4) as int)
       else ANO_ARQUIVO end as ano
from births_raw""")
def _(w):
    year = N.date_year(clean("DTNASC"))
    return w.raw.select(*IDS, N.year_or_file_year(year, F.col("ANO_ARQUIVO"), S.YEARS).alias("ano"))


@query("b08_file_year_tag", """
select ANO_ARQUIVO as ano_arquivo, ANO as ano, count(*) as n from births group by 1, 2""")
def _(w):
    births = load_years(w.files, w.states,
                        [str(c) for c in range(11, 36)], S.YEARS)
    return births.groupBy(F.col("ANO_ARQUIVO").alias("ano_arquivo"), F.col("ANO").alias("ano")).agg(
        F.count("*").alias("n"))


@query("b09_outcome", "select l_orderkey, l_linenumber, ptb from cohort")
def _(w):
    return w.births().select(*IDS, D.preterm(F.col("SEMAGESTAC")).alias("ptb"))


@query("b10_age_band", "select l_orderkey, l_linenumber, idade_cat from cohort")
def _(w):
    return w.births().select(*IDS, D.age_band(F.col("IDADEMAE")).alias("idade_cat"))


@query("b11_education_switch", """
select l_orderkey, l_linenumber, ok_edu as valida, esc_cat as rotulo, 'ESCMAE' as variavel from cohort
union all
select l_orderkey, l_linenumber, ok_edu2010, esc2010_cat, 'ESCMAE2010' from cohort""")
def _(w):
    births = w.births()
    parts = [births.select(*IDS, F.coalesce(D.education_valid(v), F.lit(False)).alias("valida"),
                           D.education(v).alias("rotulo"), F.lit(v).alias("variavel"))
             for v in D.EDUCATION_VARIABLES]
    return parts[0].unionByName(parts[1])


@query("b12_parity", "select l_orderkey, l_linenumber, parid_cat, parid_known from cohort")
def _(w):
    count = F.col("QTDFILVIVO")
    return w.births().select(*IDS, D.parity(count).alias("parid_cat"),
                             D.parity(count, null_is_zero=False).alias("parid_known"))


@query("b13_code_text", "select l_orderkey, l_linenumber, estciv_cat, ano_cat from cohort")
def _(w):
    return w.births().select(*IDS, N.code_text(F.col("ESTCIVMAE")).alias("estciv_cat"),
                             N.code_text(F.col("ANO")).alias("ano_cat"))


@query("b14_severity_bands", """
select ANO as ano, round(100 * avg(case when SEMAGESTAC < 28 then 1 when SEMAGESTAC >= 28 then 0 end), 6) as ext_pct,
  round(100 * avg(case when SEMAGESTAC is null then null when SEMAGESTAC >= 28 and SEMAGESTAC < 32 then 1 else 0 end), 6) as muito_pct,
  round(100 * avg(case when SEMAGESTAC is null then null when SEMAGESTAC >= 32 and SEMAGESTAC < 37 then 1 else 0 end), 6) as mod_pct
from births group by 1""")
def _(w):
    weeks = F.col("SEMAGESTAC")
    bands = {"ext_pct": (None, 28), "muito_pct": (28, 32), "mod_pct": (32, V.PRETERM_WEEKS)}
    return w.births().groupBy(F.col("ANO").alias("ano")).agg(*[
        D.r6(D.share(D.severity_band(weeks, *band))).alias(name) for name, band in bands.items()])


@query("b15_first_trimester", """
select l_orderkey, l_linenumber, cast(mesp1trim as int) as mesp1trim from cohort""")
def _(w):
    return w.births().select(*IDS, D.first_trimester(F.col("MESPRENAT")).alias("mesp1trim"))


@query("b16_outcome_any_weeks", """
select UF as uf, count(*) as n, count(SEMAGESTAC) as n_definido,
  round(100.0 * sum(case when SEMAGESTAC < 37 then 1 else 0 end) / count(SEMAGESTAC), 6) as ptb_pct
from births group by 1""")
def _(w):
    outcome = D.preterm(F.col("SEMAGESTAC"))
    return w.births().groupBy(F.col("UF").alias("uf")).agg(
        F.count("*").alias("n"), F.count(outcome).alias("n_definido"),
        D.r6(D.share(outcome)).alias("ptb_pct"))


@query("b17_levels", """
with lv as (
  select distinct 'raca' as fator, raca as nivel, list_position(['Branca','Parda','Preta','Indigena'], raca) as o from cohort where in_primary
  union all select distinct 'idade_cat', idade_cat, list_position(['20-34','<20','>=35'], idade_cat) from cohort where in_primary
  union all select distinct 'parid_cat', parid_cat, list_position(['0','1','2','3','Ign'], parid_cat) from cohort where in_primary
  union all select distinct 'cons_cat', cons_cat, list_position(['None','1-3','4-6','7plus','Ignorado'], cons_cat) from cohort where in_primary and cons_cat is not null
  union all select distinct 'uf_cat', UF, 0 from cohort where in_primary)
select fator, nivel, cast(row_number() over (partition by fator order by o, nivel) as int) as ordem,
  row_number() over (partition by fator order by o, nivel) = 1 as referencia
from lv""")
def _(w):
    factors = {"raca": "raca", "idade_cat": "idade_cat", "parid_cat": "parid_cat",
               "cons_cat": "cons_cat", "uf_cat": "UF"}
    seen = (w.cohort.where("in_primary")
            .select(F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).alias("v"))
                                       for f, c in factors.items()])))
            .where("v is not null").distinct().collect())
    rows = [(f, level, i + 1, i == 0) for f in factors
            for i, level in enumerate(order_levels(f, {r.v for r in seen if r.f == f}))]
    return w.spark.createDataFrame(rows, "fator string, nivel string, ordem int, referencia boolean")


@query("b18_code_as_number", """
select UF as uf, cast(sum(ESCMAE) as double) as esc_soma, cast(sum(CONSULTAS) as double) as cons_soma,
  cast(sum(ESCMAE * CONSULTAS) as double) as produto
from cohort where in_primary group by 1""")
def _(w):
    esc, cons = F.col("ESCMAE").cast("double"), F.col("CONSULTAS").cast("double")
    return w.cohort.where("in_primary").groupBy(F.col("UF").alias("uf")).agg(
        F.sum(esc).alias("esc_soma"), F.sum(cons).alias("cons_soma"), F.sum(esc * cons).alias("produto"))


@query("b19_rounding", """
select UF as uf, round(avg(IDADEMAE), 1) as d1, round(avg(IDADEMAE), 2) as d2,
  round(avg(IDADEMAE), 3) as d3, round(avg(IDADEMAE), 4) as d4
from births group by 1""")
def _(w):
    mean = F.avg("IDADEMAE")
    return w.births().groupBy(F.col("UF").alias("uf")).agg(
        *[F.round(mean, d).alias(f"d{d}") for d in (1, 2, 3, 4)])


@query("b20_exp_log", """
select raca, round(ln(avg(ptb) / (1 - avg(ptb))), 6) as log_odds,
  round(exp(ln(avg(ptb) / (1 - avg(ptb)))), 6) as odds, round(ln(count(*)), 6) as log_n
from cohort where in_primary group by 1""")
def _(w):
    p = F.avg("ptb")
    return w.cohort.where("in_primary").groupBy("raca").agg(
        D.r6(F.log(p / (1 - p))).alias("log_odds"), D.r6(F.exp(F.log(p / (1 - p)))).alias("odds"),
        D.r6(F.log(F.count("*"))).alias("log_n"))


def br_sql(value: str, digits: int) -> str:
    return (f"coalesce(translate(format('{{:,.{digits}f}}', cast({value} as double)), ',.', '.,'), '')")


@query("b21_decimal_comma", f"""
select UF as uf, {br_sql("avg(IDADEMAE)", 3)} as media, {br_sql("count(*)", 0)} as n,
  {br_sql("sum(CONSULTAS)", 1)} as total
from births group by 1""")
def _(w):
    return w.births().groupBy(F.col("UF").alias("uf")).agg(
        X.decimal_text(F.avg("IDADEMAE"), 3).alias("media"), X.count_text(F.count("*")).alias("n"),
        X.decimal_text(F.sum("CONSULTAS"), 1).alias("total"))


@query("b22_interval_text", f"""
select raca, {br_sql("avg(IDADEMAE) - 1.96 * stddev_samp(IDADEMAE) / sqrt(count(IDADEMAE))", 3)} || '–' ||
  {br_sql("avg(IDADEMAE) + 1.96 * stddev_samp(IDADEMAE) / sqrt(count(IDADEMAE))", 3)} as ic
from cohort where in_primary group by 1""")
def _(w):
    half = 1.96 * F.stddev_samp("IDADEMAE") / F.sqrt(F.count("IDADEMAE"))
    return w.cohort.where("in_primary").groupBy("raca").agg(
        X.interval_text(F.avg("IDADEMAE") - half, F.avg("IDADEMAE") + half).alias("ic"))


@query("b23_keyed_list", f"""
with y as (select ANO, raca, {br_sql("100 * avg(ptb)", 2)} as v from cohort where in_primary group by 1, 2)
select raca, string_agg(cast(ANO as varchar) || ': ' || v, ' · ' order by ANO) as lista from y group by 1""")
def _(w):
    yearly = w.cohort.where("in_primary").groupBy("raca", "ANO").agg(
        X.decimal_text(D.share(F.col("ptb")), 2).alias("v"))
    return yearly.groupBy("raca").agg(X.keyed_list(F.col("ANO"), F.col("v")).alias("lista"))


MODEL_NAMES_SQL = """
names as (
  select 'Ano_' || ano_cat as modelo, count(*) as n from cohort where in_primary group by 1
  union all
  select case when ANO <= 1997 then 'Bloco(1995-1997)' when ANO <= 1999 then 'Bloco(1998-1999)'
              else 'Bloco(2000-2001)' end, count(*) from cohort where in_primary group by 1)"""


def model_names(w):
    """Yearly and period-block model names with their rows."""
    rows = w.cohort.where("in_primary")
    yearly = rows.groupBy(F.concat(F.lit("Ano_"), F.col("ano_cat")).alias("modelo"))
    blocks = rows.groupBy(period(F.col("ANO"), S.PERIODS).alias("modelo"))
    return yearly.agg(F.count("*").alias("n")).unionByName(blocks.agg(F.count("*").alias("n")))


@query("b24_name_match", f"""
with {MODEL_NAMES_SQL}
select modelo, n, starts_with(modelo, 'Ano_') as anual, contains(lower(modelo), 'bloco') as bloco from names""")
def _(w):
    name = F.col("modelo")
    return model_names(w).select("modelo", "n", name.startswith("Ano_").alias("anual"),
                                 F.lower(name).contains("bloco").alias("bloco"))


@query("b25_name_split", f"""
with {MODEL_NAMES_SQL}
select split_part(modelo, '_', 1) as prefixo, replace(modelo, '_', ' ') as titulo, n from names""")
def _(w):
    return model_names(w).select(F.split("modelo", "_")[0].alias("prefixo"),
                                 F.replace("modelo", F.lit("_"), F.lit(" ")).alias("titulo"), "n")


@query("b26_null_to_blank", """
select l_orderkey, l_linenumber, coalesce(raca, '') as raca, coalesce(cons_cat, '') as cons_cat from cohort""")
def _(w):
    return w.births().select(*IDS, X.blank(N.label(F.col("RACACORMAE"), V.RACE)).alias("raca"),
                             X.blank(D.visits(F.col("CONSULTAS"))).alias("cons_cat"))
