"""Filters, cascades and cohorts."""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import r6, share
from vitalcells.operators import cohort as K
from vitalcells.operators.cells import collapse, collapse_rows
from vitalcells.operators.describe import prevalence
from vitalcells.operators.reshape import excluded_per_step
from vitalcells.registry.base import IDS, Workspace, focus_sql_list, query
from vitalcells.registry.sources_q import CASCADE_SQL
from vitalcells.sources import star_births as S


@query("c01_region_filter", f"""
select UF as uf, CODMUNRES as codmunres, count(*) as n from births where uf_code in ({focus_sql_list()}) group by 1, 2""")
def _(w: Workspace):
    return (w.births().where(F.col("uf_code").isin(*S.FOCUS_CODES))
            .groupBy(F.col("UF").alias("uf"), F.col("CODMUNRES").alias("codmunres"))
            .agg(F.count("*").alias("n")))


@query("c02_validity_flags", """
select l_orderkey, l_linenumber, coalesce(ok_race, false) as raca_ok, ok_weeks as semanas_ok, ok_edu as esc_ok,
  ok_age as idade_ok, true as geo_ok from cohort""")
def _(w):
    names = ("raca_ok", "semanas_ok", "esc_ok", "idade_ok", "geo_ok")
    conditions = [condition for _, condition in w.rules["ESCMAE"].steps]
    return w.births().select(*IDS, *[F.coalesce(c, F.lit(False)).alias(n)
                                     for c, n in zip(conditions, names)])


@query("c03_cascade", f"with {CASCADE_SQL} select ordem, passo, n from steps")
def _(w):
    return K.cascade(w.births(keep=()), w.rules["ESCMAE"])


@query("c04_excluded_per_step", f"""
with {CASCADE_SQL} select passo, n, lag(n) over (order by ordem) - n as excluidos from steps""")
def _(w):
    steps = K.cascade(w.births(keep=()), w.rules["ESCMAE"])
    return excluded_per_step(steps).select("passo", "n", "excluidos")


@query("c05_inclusion_flags", "select l_orderkey, l_linenumber, in_primary, in_sens from cohort")
def _(w):
    return K.with_flags(w.births(), w.rules["ESCMAE"]).select(*IDS, "in_primary", "in_sens")


@query("c06_primary_sample", "select l_orderkey, l_linenumber, raca, ptb, UF as uf from cohort where in_primary")
def _(w):
    return w.cohort.where("in_primary").select(*IDS, "raca", "ptb", F.col("UF").alias("uf"))


@query("c07_sensitivity_sample", """
select l_orderkey, l_linenumber, cons_cat, parid_cat, estciv_cat from cohort where in_sens""")
def _(w):
    return w.cohort.where("in_sens").select(*IDS, "cons_cat", "parid_cat", "estciv_cat")


@query("c08_variant_cascade", """
select 0 as ordem, '0_CO_bruto' as passo, count(*) as n from cohort
union all select 1, '1_raca_valida(excl Amarela/null)', count(*) from cohort where ok_race
union all select 2, '2_SEMAGESTAC 22-44 nao-missing', count(*) from cohort where ok_race and ok_weeks
union all select 3, '3_ESCMAE2010 presente', count(*) from cohort where ok_race and ok_weeks and ok_eduvar
union all select 4, '4_IDADEMAE 10-60', count(*) from cohort where in_primary_var
union all select 5, '5_ano/UF/municipio presente', count(*) from cohort where in_primary_var
union all select 6, '6_sensib(+cons,parid,estciv)', count(*) from cohort where in_sens_var""")
def _(w):
    return K.cascade(w.births(keep=()), w.rules["variant"])


@query("c09_singletons", "select l_orderkey, l_linenumber, in_sens from cohort where in_primary and GRAVIDEZ = 1")
def _(w):
    return w.cohort.where("in_primary and singleton").select(*IDS, "in_sens")


@query("c10_without_last_year", """
select ANO as ano, raca, count(*) as n, cast(sum(ptb) as bigint) as ptb_n, round(100 * avg(ptb), 6) as ptb_pct
from cohort where in_primary and ANO <> 2001 group by 1, 2""")
def _(w):
    rows = w.cohort.where(F.col("ANO") != S.YEARS[1])
    return prevalence(rows, "ANO", "raca").select(
        F.col("ANO").alias("ano"), "raca", "n", "ptb_n", r6(F.col("ptb_pct")).alias("ptb_pct"))


@query("c11_prenatal_subsample", """
select l_orderkey, l_linenumber, MESPRENAT as mes from cohort where in_sens and MESPRENAT between 1 and 9""")
def _(w):
    return (w.cohort.where(F.col("in_sens") & F.col("MESPRENAT").between(1, 9))
            .select(*IDS, F.col("MESPRENAT").alias("mes")))


@query("c12_period_blocks", """
select case when ANO <= 1997 then 'Bloco(1995-1997)' when ANO <= 1999 then 'Bloco(1998-1999)' else 'Bloco(2000-2001)' end as bloco,
  ANO as ano, count(*) as n, cast(sum(ptb) as bigint) as ptb_n
from cohort where in_primary group by 1, 2""")
def _(w):
    return (w.cohort.where("in_primary")
            .groupBy(K.period(F.col("ANO"), S.PERIODS).alias("bloco"), F.col("ANO").alias("ano"))
            .agg(F.count("*").alias("n"), F.sum("ptb").alias("ptb_n")))


@query("c13_state_stratum", """
select UF as uf, raca, count(*) as n, cast(sum(ptb) as bigint) as succ from focus where in_primary group by 1, 2""")
def _(w):
    run = w.run()
    return collapse(run.cells.cells("primary", ("uf_cat", "raca")).where(run.region), "uf_cat", "raca").select(
        F.col("uf_cat").alias("uf"), "raca", "n", "succ")


@query("c14_inclusion_groups", """
select 'Incluidos' as grupo, count(*) as n, count(SEMAGESTAC) as n_semanas from cohort where in_primary
union all select 'Excluidos(so raca-valida)', count(*), count(SEMAGESTAC) from cohort where ok_race and not in_primary
union all select 'Excluidos(cascata completa)', count(*), count(SEMAGESTAC) from cohort where not in_primary""")
def _(w):
    return K.inclusion_groups(w.cohort).groupBy("grupo").agg(
        F.count("*").alias("n"), F.count("SEMAGESTAC").alias("n_semanas"))


@query("c15_complete_cases", """
select raca, cons_cat, estciv_cat, cast(sum(ptb) as bigint) as succ, count(*) as n from cohort
where in_primary and raca is not null and cons_cat is not null and estciv_cat is not null group by 1, 2, 3""")
def _(w):
    cells = collapse_rows(w.cohort.where("in_primary"), "raca", "cons_cat", "estciv_cat")
    return collapse(cells, "raca", "cons_cat", "estciv_cat")


@query("c16_focal_lookup", """
select UF as uf, count(*) as n, round(100 * avg(ptb), 6) as ptb_pct from cohort
where in_primary and raca = 'Indigena' and regiao = 'MIDDLE EAST' group by 1""")
def _(w):
    report = prevalence(w.cohort, "UF", "regiao", "raca")
    return (report.where((F.col("raca") == V.RACE_FOCAL) & (F.col("regiao") == S.FOCUS_REGION_NAME))
            .select(F.col("UF").alias("uf"), "n", r6(F.col("ptb_pct")).alias("ptb_pct")))


@query("c17_fixed_column_order", """
select raca as grupo, count(*) as n, round(100 * avg(ptb), 6) as ptb_pct,
  round(100 * avg(case when idade_cat = '>=35' then 1 else 0 end), 6) as idade_ge35_pct
from cohort where in_primary group by 1""")
def _(w):
    table = w.cohort.where("in_primary").groupBy(F.col("raca").alias("grupo")).agg(
        share(F.col("idade_cat") == ">=35").alias("idade_ge35_pct"),
        share(F.col("ptb")).alias("ptb_pct"), F.count("*").alias("n"))
    return table.select("grupo", "n", r6(F.col("ptb_pct")).alias("ptb_pct"),
                        r6(F.col("idade_ge35_pct")).alias("idade_ge35_pct"))
