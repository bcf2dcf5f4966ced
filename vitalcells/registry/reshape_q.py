"""Windows, sorts, top-k, wide and long forms."""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import r6
from vitalcells.operators import describe as D
from vitalcells.operators import reshape as R
from vitalcells.operators.cohort import cascade
from vitalcells.plans import studies as T
from vitalcells.plans.reports import largest_states, with_attenuation
from vitalcells.registry.aggregates_q import rounded
from vitalcells.registry.base import Workspace, query
from vitalcells.registry.joins_q import crude_sql
from vitalcells.registry.sources_q import CASCADE_SQL
from vitalcells.sources import reports as S
from vitalcells.storage import is_written


@query("f01_step_difference", f"""
with {CASCADE_SQL} select ordem, lag(n) over (order by ordem) - n as excluidos from steps""")
def _(w: Workspace):
    return R.excluded_per_step(cascade(w.cohort, w.rules["ESCMAE"])).select("ordem", "excluidos")


@query("f02_share_of_total", """
with g as (select raca, count(*) as n from cohort where in_primary group by 1)
select raca, n, round(100.0 * n / (select sum(n) from g), 6) as pct from g""")
def _(w):
    counts = w.cohort.where("in_primary").groupBy("raca").agg(F.count("*").alias("n"))
    return rounded(counts.withColumn("pct", R.share_of_total(counts, "n")))


@query("f03_difference_from_reference", """
with g as (select UF as uf, raca, 100 * avg(ptb) as p from cohort where in_primary group by 1, 2)
select uf, raca, round(g.p, 6) as ptb_pct, round(g.p - b.p, 6) as dif_pp
from g left join (select uf, p from g where raca = 'Branca') b using (uf)""")
def _(w):
    table = D.prevalence(w.cohort, "UF", "raca").withColumnRenamed("UF", "uf")
    reference = F.col("raca") == V.RACE_REFERENCE
    return rounded(table.select("uf", "raca", "ptb_pct",
                                R.versus(F.col("ptb_pct"), reference, "uf").alias("dif_pp")))


@query("f04_attenuation", f"""
with {crude_sql("a", "in_primary")}, {crude_sql("v", "in_primary_var")}
select 'M1_Crude' as modelo, grupo, cast(0 as double) as atenuacao_pct, cast(0 as double) as sem_arredondar from a
union all select 'variante', a.grupo,
  round(100 * (round(exp(a.b), 3) - round(exp(v.b), 3)) / (round(exp(a.b), 3) - 1), 6),
  round(100 * (exp(a.b) - exp(v.b)) / (exp(a.b) - 1), 6) from a join v using (grupo)""")
def _(w):
    parts = []
    for arm in ("ESCMAE", "variant"):
        run = w.run(arm, True)
        table = T.effect_table(w.spark, [(run.fit(run.ladder()[0]), "model")])
        parts.append(table if arm == "ESCMAE" else table.withColumn("modelo", F.lit("variante")))
    both = R.union_all(parts)
    exact = with_attenuation(both, None).select(
        "modelo", "grupo", r6(F.col("atenuacao_pct")).alias("sem_arredondar"))
    return with_attenuation(both).select(
        "modelo", "grupo", r6(F.col("atenuacao_pct")).alias("atenuacao_pct")).join(exact, ["modelo", "grupo"])


@query("f05_absolute_gap", """
select UF as uf, round(100 * avg(case when raca = 'Indigena' then ptb end) - 100 * avg(case when raca = 'Branca' then ptb end), 6) as dif_pp
from cohort where in_primary group by 1""")
def _(w):
    def of(group):
        return F.max(F.when(F.col("raca") == group, F.col("ptb_pct")))

    table = D.prevalence(w.cohort, "UF", "raca").groupBy(F.col("UF").alias("uf"))
    return table.agg(r6(of(V.RACE_FOCAL) - of(V.RACE_REFERENCE)).alias("dif_pp"))


@query("f06_sorted_report", """
select UF as uf, ANO as ano, count(*) as n, round(avg(IDADEMAE), 6) as media from cohort where in_primary group by 1, 2""")
def _(w):
    return (w.cohort.where("in_primary").groupBy(F.col("UF").alias("uf"), F.col("ANO").alias("ano"))
            .agg(F.count("*").alias("n"), r6(F.avg("IDADEMAE")).alias("media"))
            .orderBy("ano", F.desc("n"), F.desc("media"), "uf"))


TOP_STATES_SQL = """
with p as (select UF, regiao, count(case when raca = 'Indigena' then 1 end) as n_focal,
    round(100 * avg(case when raca = 'Branca' then ptb end), 6) as branca_pct,
    round(100 * avg(case when raca = 'Indigena' then ptb end), 6) as indigena_pct
  from cohort where in_primary group by 1, 2)
select cast(row_number() over (order by n_focal desc, UF) as int) as posicao, UF as uf, regiao, n_focal, branca_pct, indigena_pct
from p where n_focal > 0 order by n_focal desc, UF limit 20"""


@query("f07_top_states", TOP_STATES_SQL)
def _(w):
    return rounded(largest_states(D.prevalence(w.cohort, "UF", "regiao", "raca")))


@query("f08_latest_file", f"with {CASCADE_SQL} select 'build_20260627' as arquivo, passo, n from steps")
def _(w):
    """Rows of the newest of two written cascades; the older one has the variant rules."""
    folder = f"{w.root}/latest"
    for stamp, rules in (("20260101", "variant"), ("20260627", "ESCMAE")):
        if not is_written(w.spark, f"{folder}/build_{stamp}"):
            rows = cascade(w.cohort, w.rules[rules]).select(F.concat_ws(";", "passo", "n").alias("value"))
            rows.write.mode("overwrite").text(f"{folder}/build_{stamp}")
    lines = S.read_lines(w.spark, folder).withColumn("file", F.regexp_extract("file", r"(build_\d+)", 1))
    cells = F.split("value", ";")
    return S.newest(lines).select(F.col("file").alias("arquivo"), cells[0].alias("passo"),
                                  cells[1].cast("bigint").alias("n"))


WIDE_SQL = ", ".join(
    f"count(case when raca = '{g}' then 1 end) as {g.lower()}_n, round(100 * avg(case when raca = '{g}' then ptb end), 6) as {g.lower()}_pct"
    for g in V.RACE_LEVELS)


@query("f09_long_to_wide", f"select UF as uf, ANO as ano, {WIDE_SQL} from cohort where in_primary group by 1, 2")
def _(w):
    table = D.prevalence(w.cohort, "UF", "ANO", "raca")
    wide = table.groupBy(F.col("UF").alias("uf"), F.col("ANO").alias("ano")).pivot(
        "raca", list(V.RACE_LEVELS)).agg(F.first("n").alias("n"), F.first("ptb_pct").alias("pct"))
    return wide.select("uf", "ano", *[c for g in V.RACE_LEVELS for c in (
        F.coalesce(F.col(f"{g}_n"), F.lit(0)).alias(f"{g.lower()}_n"),
        r6(F.col(f"{g}_pct")).alias(f"{g.lower()}_pct"))])


@query("f10_wide_to_long", """
select UF as uf, 'idade' as medida, round(avg(IDADEMAE), 6) as valor from cohort group by 1
union all select UF, 'semanas', round(avg(SEMAGESTAC), 6) from cohort group by 1
union all select UF, 'filhos', round(avg(QTDFILVIVO), 6) from cohort group by 1""")
def _(w):
    wide = w.cohort.groupBy(F.col("UF").alias("uf")).agg(
        r6(F.avg("IDADEMAE")).alias("idade"), r6(F.avg("SEMAGESTAC")).alias("semanas"),
        r6(F.avg("QTDFILVIVO")).alias("filhos"))
    return wide.unpivot("uf", ["idade", "semanas", "filhos"], "medida", "valor")


@query("f11_union_blocks", """
select 'UF' as bloco, UF as chave, count(*) as n from cohort where in_primary group by 2
union all select 'ANO', cast(ANO as varchar), count(*) from cohort where in_primary group by 2
union all select 'raca', raca, count(*) from cohort where in_primary group by 2""")
def _(w):
    def block(name):
        return w.cohort.where("in_primary").groupBy(F.col(name).cast("string").alias("chave")).agg(
            F.count("*").alias("n")).select(F.lit(name).alias("bloco"), "chave", "n")

    return R.union_all([block(c) for c in ("UF", "ANO", "raca")])
