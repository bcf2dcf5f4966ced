"""Profiles and descriptive tables."""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import r6
from vitalcells.operators import describe as D
from vitalcells.operators import profile as P
from vitalcells.operators.cells import collapse, collapse_rows
from vitalcells.operators.cohort import inclusion_groups
from vitalcells.operators.reshape import dense, first_rows
from vitalcells.plans.reports import extremes
from vitalcells.registry.base import Workspace, query
from vitalcells.registry.sources_q import MISSINGNESS_SQL, missingness_table
from vitalcells.sources import star_births as S
from vitalcells.sources.yearly import scan_years

STUDY_YEARS = list(range(S.YEARS[0], S.YEARS[1] + 1))
FOCUS_LABELS = [f"NATION_{int(code) - 11}" for code in S.FOCUS_CODES]


def rounded(df):
    """All double columns to six digits, other columns as they are."""
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("e01_rows_per_year", """
select ANO_ARQUIVO as ano, count(*) as n from births_raw group by 1
union all select null, count(*) from births_raw""")
def _(w: Workspace):
    years = P.rows_per_year(w.profiled)
    return years.unionByName(years.agg(F.sum("n").alias("n")).select(F.lit(None).cast("int").alias("ano"), "n"))


@query("e02_missingness", MISSINGNESS_SQL)
def _(w):
    return missingness_table(w)


def distribution_sql(column: str, labels: dict) -> str:
    whens = " ".join(f"when codigo = '{k}' then '{v}'" for k, v in labels.items())
    return f"""
with d as (select ANO_ARQUIVO as ano, nullif(trim({column}), '') as codigo, count(*) as n from births_raw group by 1, 2)
select ano, coalesce(codigo, '(null)') as codigo, case when codigo is null then '(null/missing)' {whens} else '—' end as label,
  n, round(100.0 * n / sum(n) over (partition by ano), 6) as pct from d"""


def of_years_with(w, column: str):
    """The column's cleaned text, of the files that have it."""
    return scan_years(w.files.having(column), (column,))


@query("e03_exposure_codes", distribution_sql("RACACORMAE", V.RACE_PROFILE))
def _(w):
    return rounded(P.code_distribution(of_years_with(w, "RACACORMAE"), "RACACORMAE", V.RACE_PROFILE))


@query("e04_plurality_codes", distribution_sql("GRAVIDEZ", V.PLURALITY_PROFILE))
def _(w):
    return rounded(P.code_distribution(of_years_with(w, "GRAVIDEZ"), "GRAVIDEZ", V.PLURALITY_PROFILE))


@query("e05_weeks_range", """
with s as (select ANO_ARQUIVO as ano, try_cast(nullif(SEMAGESTAC, '') as double) as v from births_raw),
k as (select ano, v, row_number() over (partition by ano order by v) - 1 as pos, count(*) over (partition by ano) as m from s where v is not null),
q as (select ano, max(case when pos = floor(0.01 * (m - 1) + 0.5) then v end) as p1,
  max(case when pos = floor(0.5 * (m - 1) + 0.5) then v end) as p50,
  max(case when pos = floor(0.99 * (m - 1) + 0.5) then v end) as p99 from k group by 1)
select ano, min(v) as min, max(v) as max, any_value(p1) as p1, any_value(p50) as p50, any_value(p99) as p99,
  count(case when v < 22 then 1 end) as n_lt, round(100.0 * count(case when v < 22 then 1 end) / count(*), 6) as pct_lt,
  count(case when v > 44 then 1 end) as n_gt, round(100.0 * count(case when v > 44 then 1 end) / count(*), 6) as pct_gt,
  round(100.0 * (count(*) - count(v)) / count(*), 6) as pct_null
from s join q using (ano) group by 1""")
def _(w):
    return rounded(P.number_range(of_years_with(w, "SEMAGESTAC"), "SEMAGESTAC", *V.WEEKS_VALID))


@query("e06_state_year_counts", f"""
select cast(y.ano as int) as ano, cast(11 + t.n_nationkey as varchar) as uf_code, t.n_name as uf, count(r.ANO_ARQUIVO) as n
from nation t cross join range(1995, 2002) y(ano)
left join births_raw r on left(trim(r.CODMUNRES), 2) = cast(11 + t.n_nationkey as varchar) and r.ANO_ARQUIVO = y.ano
where t.n_regionkey = 4 group by 1, 2, 3""")
def _(w):
    focus = w.states.where(F.col("uf_code").isin(*S.FOCUS_CODES)).select("uf_code", F.col("UF").alias("uf"))
    return dense(P.state_counts(w.profiled), focus, {"ano": STUDY_YEARS}).select("ano", "uf_code", "uf", "n")


@query("e07_focus_share", """
select ANO_ARQUIVO as ano, count(*) as total_nacional,
  count(case when left(trim(CODMUNRES), 2) in ('15', '20', '25', '30', '35') then 1 end) as total_foco,
  round(100.0 * count(case when left(trim(CODMUNRES), 2) in ('15', '20', '25', '30', '35') then 1 end) / count(*), 6) as pct_foco
from births_raw group by 1""")
def _(w):
    return rounded(P.focus_share(w.profiled, list(S.FOCUS_CODES)))


@query("e08_state_year_matrix", f"""
select UF as uf, {", ".join(f"count(case when ANO_ARQUIVO = {y} then 1 end) as ano_{y}" for y in range(1995, 2002))}
from births where uf_code in ('15', '20', '25', '30', '35') group by 1""")
def _(w):
    counts = P.state_counts(w.profiled).join(w.states, "uf_code").where(F.col("uf_code").isin(*S.FOCUS_CODES))
    wide = counts.groupBy(F.col("UF").alias("uf")).pivot("ano", STUDY_YEARS).agg(F.sum("n"))
    return wide.select("uf", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"ano_{y}") for y in STUDY_YEARS])


def pct(condition: str, known: str = "true") -> str:
    return f"round(100.0 * count(case when {condition} then 1 end) / nullif(count(case when {known} then 1 end), 0), 6)"


TABLE1_SQL = ", ".join([
    "count(*) as n", "cast(sum(ptb) as bigint) as ptb_n", "round(100 * avg(ptb), 6) as ptb_pct",
    f"{pct('SEMAGESTAC < 28')} as ptb_ext_pct",
    f"{pct('SEMAGESTAC >= 28 and SEMAGESTAC < 32')} as ptb_muito_pct",
    f"{pct('SEMAGESTAC >= 32 and SEMAGESTAC < 37')} as ptb_mod_pct",
    "round(avg(IDADEMAE), 6) as idade_media", "round(stddev_samp(IDADEMAE), 6) as idade_sd",
    *[f"{pct(cond)} as {name}" for cond, name in (
        ("idade_cat = '<20'", "idade_lt20_pct"), ("idade_cat = '20-34'", "idade_2034_pct"),
        ("idade_cat = '>=35'", "idade_ge35_pct"))],
    *[f"{pct(f'ESCMAE = {k}', 'ESCMAE is not null')} as \"esc_{v}_pct\"" for k, v in V.EDUCATION.items()],
    *[f"{pct(f'''UF = '{uf}' ''')} as \"estado_{uf}_pct\"" for uf in FOCUS_LABELS],
    "count(case when in_sens then 1 end) as n_sens",
    *[f"{pct(f'in_sens and CONSULTAS = {k}', 'in_sens and CONSULTAS is not null')} as \"cons_{v}_pct\"" for k, v in V.VISITS.items()],
    f"{pct('in_sens and MESPRENAT between 1 and 3', 'in_sens and MESPRENAT is not null')} as mesprenat_1trim_pct",
])


@query("e09_table1", f"""
select raca as grupo, {TABLE1_SQL} from focus where in_primary group by 1
union all select 'TOTAL', {TABLE1_SQL} from focus where in_primary""")
def _(w):
    return rounded(D.table1(w.focus, w.focus_states))


NATIONAL_SQL = ", ".join([
    "count(*) as n", "cast(sum(ptb) as bigint) as ptb_n", "round(100 * avg(ptb), 6) as ptb_pct",
    "round(avg(IDADEMAE), 6) as idade_media",
    f"{pct('IDADEMAE <= 19')} as idade_lt20_pct", f"{pct('IDADEMAE >= 35')} as idade_ge35_pct"])


@query("e10_table1_national", f"""
select raca as grupo, {NATIONAL_SQL} from cohort where in_primary group by 1
union all select 'TOTAL', {NATIONAL_SQL} from cohort where in_primary""")
def _(w):
    return rounded(D.table1_national(w.cohort))


@query("e11_prevalence", """
select t.n_name as uf, r.raca, count(c.ptb) as n, cast(coalesce(sum(c.ptb), 0) as bigint) as ptb_n,
  round(100 * avg(c.ptb), 6) as ptb_pct
from nation t cross join (select unnest(['Branca', 'Parda', 'Preta', 'Indigena']) as raca) r
left join (select * from cohort where in_primary) c on c.UF = t.n_name and c.raca = r.raca group by 1, 2""")
def _(w):
    return prevalence_by_state(w)


def prevalence_by_state(w):
    grid = D.prevalence_grid(w.cohort, w.states.select("UF"))
    return rounded(grid.withColumnRenamed("UF", "uf"))


@query("e12_prevalence_pivot", """
select UF as uf, round(100 * avg(case when raca = 'Branca' then ptb end), 6) as branca, round(100 * avg(case when raca = 'Parda' then ptb end), 6) as parda,
  round(100 * avg(case when raca = 'Preta' then ptb end), 6) as preta, round(100 * avg(case when raca = 'Indigena' then ptb end), 6) as indigena
from cohort where in_primary group by 1""")
def _(w):
    wide = D.prevalence(w.cohort, "UF", "raca").groupBy(F.col("UF").alias("uf")).pivot(
        "raca", list(V.RACE_LEVELS)).agg(F.first("ptb_pct"))
    return wide.select("uf", *[r6(F.col(g)).alias(g.lower()) for g in V.RACE_LEVELS])


@query("e13_prevalence_two_groups", """
select UF as uf, regiao, raca as grupo, count(*) as n, cast(sum(ptb) as bigint) as ptb_n, round(100 * avg(ptb), 6) as ptb_pct
from cohort where in_primary and raca in ('Branca', 'Indigena') group by 1, 2, 3""")
def _(w):
    table = D.prevalence(w.cohort, "UF", "regiao", "raca")
    return rounded(table.where(F.col("raca").isin(V.RACE_REFERENCE, V.RACE_FOCAL))
                   .withColumnsRenamed({"UF": "uf", "raca": "grupo"}))


@query("e14_focal_by_region", """
with f as (select regiao, count(*) as n_focal from cohort where in_primary and RACACORMAE = 5 group by 1)
select regiao, n_focal, round(100.0 * n_focal / (select sum(n_focal) from f), 6) as pct_focal from f""")
def _(w):
    return rounded(D.focal_by_region(w.cohort)).orderBy(F.desc("n_focal"), "regiao")


MISSING_CONDITIONS = {
    "SEMAGESTAC": "SEMAGESTAC is null or SEMAGESTAC < 22 or SEMAGESTAC > 44", "RACACORMAE": "RACACORMAE is null",
    "IDADEMAE": "IDADEMAE is null or IDADEMAE < 10 or IDADEMAE > 60", "ESCMAE": "ESCMAE is null or ESCMAE < 1 or ESCMAE > 5",
    "CONSULTAS": "CONSULTAS is null", "MESPRENAT": "MESPRENAT is null or MESPRENAT = 99",
    "QTDFILVIVO": "QTDFILVIVO is null", "ESTCIVMAE": "ESTCIVMAE is null", "CODMUNRES": "CODMUNRES is null"}


@query("e15_missing_by_group", "with pool as (select * from cohort where ok_race), rows as (" + " union all ".join(
    f"select '{V.MISSING_LABELS[c]}' as variavel, raca, case when {cond} then 1 else 0 end as m from pool"
    for c, cond in MISSING_CONDITIONS.items()) + """)
select variavel, raca as grupo, count(*) as n, cast(sum(m) as bigint) as missing_n, round(100.0 * sum(m) / count(*), 6) as missing_pct from rows group by 1, 2
union all select variavel, 'TOTAL', count(*), cast(sum(m) as bigint), round(100.0 * sum(m) / count(*), 6) from rows group by 1""")
def _(w):
    return rounded(D.missing_by_group(w.cohort))


INOUT_SQL = ", ".join([
    "count(*) as n", "round(100 * avg(ptb), 6) as ptb_pct", "count(SEMAGESTAC) as ptb_definido_n",
    "round(avg(IDADEMAE), 6) as idade_media",
    *[f"coalesce({pct(f'''raca = '{g}' ''', 'raca is not null')}, 0) as raca_{g.lower()}_pct" for g in V.RACE_LEVELS],
    f"{pct('RACACORMAE is null or RACACORMAE = 3')} as raca_outra_missing_pct",
    f"{pct('RACACORMAE = 9')} as raca_codigo9_pct"])


@query("e16_included_vs_excluded", f"""
select 'Incluidos' as grupo, {INOUT_SQL} from cohort where in_primary
union all select 'Excluidos(so raca-valida)', {INOUT_SQL} from cohort where ok_race and not in_primary
union all select 'Excluidos(cascata completa)', {INOUT_SQL} from cohort where not in_primary""")
def _(w):
    return rounded(D.included_vs_excluded(inclusion_groups(w.cohort)))


EXPOSURE_GRID_SQL = """
select cast(y.ano as int) as ano, t.n_name as uf, count(b.ANO) as n_total,
  count(case when b.ANO is not null and b.RACACORMAE is null then 1 end) as missing_n,
  count(case when b.RACACORMAE = 3 then 1 end) as outra_n, count(case when b.RACACORMAE = 9 then 1 end) as codigo9_n,
  round(100.0 * count(case when b.ANO is not null and b.RACACORMAE is null then 1 end) / nullif(count(b.ANO), 0), 6) as missing_pct,
  round(100.0 * count(case when b.RACACORMAE = 3 then 1 end) / nullif(count(b.ANO), 0), 6) as outra_pct
from nation t cross join range(1995, 2002) y(ano) left join births b on b.UF = t.n_name and b.ANO = y.ano
where t.n_regionkey = 4 group by 1, 2"""


def exposure_grid(w):
    states = w.states.where(F.col("uf_code").isin(*S.FOCUS_CODES)).select("UF")
    return D.exposure_missing_grid(w.focus, STUDY_YEARS, states).withColumnsRenamed({"ANO": "ano", "UF": "uf"})


@query("e17_exposure_missing_grid", EXPOSURE_GRID_SQL)
def _(w):
    return rounded(exposure_grid(w))


@query("e18_first_trimester_by_group", """
select raca as grupo, count(case when MESPRENAT between 1 and 9 then 1 end) as n,
  round(100.0 * count(case when MESPRENAT between 1 and 3 then 1 end) / count(case when MESPRENAT between 1 and 9 then 1 end), 6) as inicio_1trim_pct
from cohort where in_sens group by 1""")
def _(w):
    return rounded(D.first_trimester_by_group(w.cohort))


SIZE_CONDITIONS = {
    "primaria_M1-5": "in_primary", "sensibilidade_M6-8": "in_sens",
    "singletons_primaria": "in_primary and GRAVIDEZ = 1", "singletons_sensib": "in_sens and GRAVIDEZ = 1",
    "mesprenat_subsample": "in_sens and MESPRENAT between 1 and 9",
    "sem_ultimo_ano_primaria": "in_primary and ANO < 2001", "sem_ultimo_ano_sensib": "in_sens and ANO < 2001",
    "ultimo_ano_contribuicao": "in_primary and ANO = 2001",
    **{f"{uf}_M{m}_n": f"{flag} and UF = '{uf}'" for uf in FOCUS_LABELS
       for m, flag in ((5, "in_primary"), (8, "in_sens"))}}


@query("e19_sample_sizes", " union all ".join(
    f"select '{name}' as amostra, count(*) as n from focus where {cond}" for name, cond in SIZE_CONDITIONS.items()))
def _(w):
    return D.sample_sizes(w.focus, S.YEARS[1], w.focus_states)


@query("e20_cells", """
select raca, idade_cat, esc_cat, ano_cat, UF as uf_cat, cast(sum(ptb) as bigint) as succ, count(*) as n,
  cast(count(*) - sum(ptb) as bigint) as fail
from cohort where in_primary group by 1, 2, 3, 4, 5""")
def _(w):
    keys = ("raca", "idade_cat", "esc_cat", "ano_cat", "uf_cat")
    cells = collapse(w.run().cells.cells("primary", keys), *keys)
    return cells.withColumn("fail", F.col("n") - F.col("succ"))


@query("e21_cells_by_town", """
select raca, CODMUNRES as codmunres, cast(sum(ptb) as bigint) as succ, count(*) as n from cohort where in_primary group by 1, 2""")
def _(w):
    return collapse_rows(w.run().rows, "raca", "CODMUNRES").withColumnRenamed("CODMUNRES", "codmunres")


@query("e22_value_shares", """
select UF as uf, round(1.0 * count(case when raca = 'Indigena' then 1 end) / count(raca), 6) as focal, count(raca) as n_rotulado
from cohort group by 1""")
def _(w):
    return w.cohort.groupBy(F.col("UF").alias("uf")).agg(
        r6(F.count_if(F.col("raca") == V.RACE_FOCAL) / F.count("raca")).alias("focal"),
        F.count("raca").alias("n_rotulado"))


@query("e23_mean_and_sd", """
select UF as uf, count(IDADEMAE) as n, round(avg(IDADEMAE), 6) as media, round(stddev_samp(IDADEMAE), 6) as sd
from cohort group by 1""")
def _(w):
    return w.cohort.groupBy(F.col("UF").alias("uf")).agg(
        F.count("IDADEMAE").alias("n"), r6(F.avg("IDADEMAE")).alias("media"),
        r6(F.stddev_samp("IDADEMAE")).alias("sd"))


@query("e24_mean_of_percent", f"""
with g as ({EXPOSURE_GRID_SQL}) select uf, round(avg(missing_pct), 6) as media from g group by 1""")
def _(w):
    return (exposure_grid(w).groupBy("uf").agg(r6(F.avg(r6(F.col("missing_pct")))).alias("media"))
            .orderBy(F.desc("media"), "uf"))


@query("e25_extreme_rows", f"""
with g as ({EXPOSURE_GRID_SQL}),
lo as (select * from g where missing_pct is not null order by missing_pct, ano, uf limit 1),
hi as (select * from g where missing_pct is not null order by missing_pct desc, ano, uf limit 1)
select lo.missing_pct as minimo, lo.ano as min_ano, lo.uf as min_uf, hi.missing_pct as maximo, hi.ano as max_ano, hi.uf as max_uf from lo, hi""")
def _(w):
    return extremes(rounded(exposure_grid(w)), "missing_pct")


@query("e26_distinct_sorted", "select distinct UF as uf from cohort where in_primary")
def _(w):
    return w.cohort.where("in_primary").select(F.col("UF").alias("uf")).distinct().orderBy("uf")


@query("e27_first_appearance", """
select CODMUNRES as codmunres, min(l_orderkey * 10 + l_linenumber) as ordem from births group by 1""")
def _(w):
    rows = w.cohort.select(F.col("CODMUNRES").alias("codmunres"),
                           (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordem"))
    return first_rows(rows, "codmunres").orderBy("ordem")


@query("e28_focal_rows_in_variant", """
select UF as uf, count(case when RACACORMAE = 5 then 1 end) as n_focal, count(*) as n from cohort where in_primary_var group by 1""")
def _(w):
    return w.cohort.where("in_primary_var").groupBy(F.col("UF").alias("uf")).agg(
        F.count_if(F.col("raca") == V.RACE_FOCAL).alias("n_focal"), F.count("*").alias("n"))
