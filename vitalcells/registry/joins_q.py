"""Lookups and comparisons between result tables.

The second team's tables are those of the variant cohort, which Spark derives from the same input.
"""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import r6, share
from vitalcells.operators import describe as D
from vitalcells.operators.reshape import dense, with_levels
from vitalcells.plans import reconcile as R
from vitalcells.plans import studies as T
from vitalcells.plans.reports import ratios_beside_odds
from vitalcells.registry.base import EXPECTED_FILE_YEARS, IDS, Workspace, query
from vitalcells.registry.newton_sql import (OTHER_EDUCATION, SETTINGS, VARIANT, compared, interval, newton,
                                            standardised)
from vitalcells.sources import star_births as S
from vitalcells.sources.yearly import with_states


def variant_cohort(w: Workspace):
    """The cohort with the variant samples under the usual names."""
    return w.cohort.withColumns({"in_primary": F.col("in_primary_var"),
                                 "in_sens": F.col("in_sens_var")})


def crude_sql(name: str, flag: str, source: str = "cohort") -> str:
    """Closed-form crude odds ratio, its Wald interval and its rate ratio, per group."""
    return f"""
{name}_g as (select raca, cast(sum(ptb) as double) as s, cast(count(*) as double) as n, sum(ptb) / count(*) as p
  from {source} where {flag} group by 1),
{name} as (select g.raca as grupo, ln(g.p / (1 - g.p)) - ln(b.p / (1 - b.p)) as b,
    sqrt(1 / g.s + 1 / (g.n - g.s) + 1 / b.s + 1 / (b.n - b.s)) as se, ln(g.p / b.p) as lrr,
    sqrt((1 - g.p) / g.s + (1 - b.p) / b.s) as se_hc0, sqrt(1 / g.s + 1 / b.s) as se_pois,
    (select cast(sum(n) as bigint) from {name}_g) as nobs,
    (select -2 * sum(s * ln(p) + (n - s) * ln(1 - p)) + 2 * count(*) from {name}_g) as aic,
    (select -2 * sum(s * ln(p) - s) + 2 * count(*) from {name}_g) as aic_pois
  from {name}_g g, {name}_g b where b.raca = 'Branca' and g.raca <> 'Branca')"""


def rounded_ratios(table):
    values = ("nosso", "referencia", "delta")
    return table.select(*[c for c in table.columns if c not in values],
                        *[r6(F.col(c)).alias(c) for c in values])


def national_ratios(w: Workspace, arm: str, names):
    """Effects of the named national models under their short names."""
    run = w.run(arm, True)
    tasks = [t for t in run.national() if t.model.name in names]
    rows = T.effect_table(w.spark, [(f, "model") for f in run.fit_all(tasks)])
    return rows.withColumn("modelo", F.split("modelo", "_")[0])


@query("d01_state_lookup", """
select l_orderkey, l_linenumber, UF as uf, regiao from births""")
def _(w):
    codes = w.raw.select(*IDS, F.substring(F.trim("CODMUNRES"), 1, 2).alias("uf_code"))
    return with_states(codes, w.states).where("UF is not null").select(*IDS, F.col("UF").alias("uf"), "regiao")


SIZES_SQL = " union all ".join(
    f"select '{name}' as amostra, count(case when {{p}} then 1 end) as nosso, count(case when {{v}} then 1 end) as referencia from cohort"
    .format(p=cond.format(p="in_primary", s="in_sens"), v=cond.format(p="in_primary_var", s="in_sens_var"))
    for name, cond in {
        "primaria_M1-5": "{p}", "sensibilidade_M6-8": "{s}", "singletons_primaria": "{p} and singleton",
        "singletons_sensib": "{s} and singleton", "mesprenat_subsample": "{s} and MESPRENAT between 1 and 9",
        "sem_ultimo_ano_primaria": "{p} and ANO <> 2001", "sem_ultimo_ano_sensib": "{s} and ANO <> 2001",
        "ultimo_ano_contribuicao": "{p} and ANO = 2001"}.items())


@query("d02_sample_sizes", f"""
select amostra, cast(nosso as double) as nosso, cast(referencia as double) as referencia,
  cast(nosso - referencia as double) as delta from ({SIZES_SQL})""")
def _(w):
    ours = D.sample_sizes(w.cohort, S.YEARS[1], [])
    theirs = D.sample_sizes(variant_cohort(w), S.YEARS[1], [])
    return R.sample_sizes(ours, theirs)


RATIOS_SQL = f"""
with recursive {newton("a", SETTINGS.ladder(), "cohort")}, {newton("v", SETTINGS.ladder(), "cohort", **VARIANT)}
select modelo, grupo, {compared("exp(a.b)", "exp(v.b)")} from a_effects a join v_effects v using (modelo, grupo)
where grupo = 'Indigena'"""


@query("d03_ratio_by_model_ladder", RATIOS_SQL)
@query("d03_ratio_by_model", RATIOS_SQL)
def _(w):
    """Focal odds ratios of all eight models, ours beside the variant's."""
    tables = [T.effect_table(w.spark, [(f, "model") for f in run.fit_all(run.ladder())])
              for run in (w.run("ESCMAE", True), w.run("variant", True))]
    return rounded_ratios(R.ratios_by_model(*tables))


@query("d04_odds_vs_prevalence_ratio", f"""
with {crude_sql("a", "in_primary")}, {crude_sql("v", "in_primary_var")}
select 'M1' as modelo, grupo, 'OR' as medida, round(exp(a.b), 6) as nosso, round(exp(v.b), 6) as referencia,
  round(exp(a.b) - exp(v.b), 6) as delta from a join v using (grupo) where grupo = 'Indigena'
union all
select 'M1', grupo, 'RR', round(exp(a.lrr), 6), null, null from a where grupo = 'Indigena'""")
def _(w):
    return rounded_ratios(R.ratios_by_measure(national_ratios(w, "ESCMAE", ("M1_logit", "M1_poisson_RR")),
                                              national_ratios(w, "variant", ("M1_logit",))))


@query("d04_odds_vs_prevalence_ratio_models", f"""
with recursive {newton("a", SETTINGS.national(), "cohort")}, {newton("v", SETTINGS.national(), "cohort", **VARIANT)}
select split_part(modelo, '_', 1) as modelo, grupo, case when a.family = 'binomial' then 'OR' else 'RR' end as medida,
  {compared("exp(a.b)", "exp(v.b)")} from a_effects a join v_effects v using (modelo, grupo) where grupo = 'Indigena'""")
def _(w):
    """Odds and prevalence ratios of M1, M5 and M8, ours beside the variant's."""
    names = [t.model.name for t in w.run("ESCMAE", True).national()]
    return rounded_ratios(R.ratios_by_measure(*[national_ratios(w, arm, names) for arm in ("ESCMAE", "variant")]))


@query("d05_adjusted_probability", """
with o as (select raca as grupo, 100 * avg(ptb) as p from cohort where in_primary group by 1),
v as (select raca as grupo, 100 * avg(ptb) as p from cohort where in_primary_var group by 1)
select grupo, round(o.p, 6) as nosso, round(v.p, 6) as referencia, round(o.p - v.p, 6) as delta from o join v using (grupo)""")
def _(w):
    tables = []
    for arm in ("ESCMAE", "variant"):
        run = w.run(arm, True)
        tables.append(T.adjusted_probabilities(run, run.ladder()[0]))
    return R.probabilities(*tables).select("grupo", *[
        r6(F.col(c)).alias(c) for c in ("nosso", "referencia", "delta")])


ADJUSTED_SQL = f"""{newton("a", SETTINGS.ladder()[4:5], "cohort")}, {newton("v", SETTINGS.ladder()[4:5], "cohort", **VARIANT)},
p as (select grupo, {compared("o.v", "r.v")} from ({standardised("a", "M5_PRIMARY")}) o join ({standardised("v", "M5_PRIMARY")}) r using (grupo))"""


@query("d05_adjusted_probability_m5", f"with recursive {ADJUSTED_SQL} select * from p")
def _(w):
    """Probabilities standardised over the covariates of M5, ours beside the variant's."""
    tables = [T.adjusted_probabilities(run, run.ladder()[4])
              for run in (w.run("ESCMAE", True), w.run("variant", True))]
    return rounded_ratios(R.probabilities(*tables))


@query("d06_year_counts", """
with o as (select ANO as ano, count(*) as n from cohort where in_primary group by 1),
v as (select ANO as ano, count(*) as n from cohort where in_primary_var group by 1)
select ano, cast(o.n as double) as nosso, cast(v.n as double) as referencia, cast(o.n - v.n as double) as delta
from o join v using (ano)""")
def _(w):
    def counts(flag):
        return w.cohort.where(flag).groupBy(F.col("ANO").alias("ano")).agg(F.count("*").alias("n"))

    return R.year_counts(counts("in_primary"), counts("in_primary_var"))


@query("d07_ratio_beside_odds", f"""
with {crude_sql("a", "in_primary", "focus")}
select 'M1_Crude' as modelo, grupo, round(exp(b), 6) as odds, round(exp(lrr), 6) as razao,
  round(exp(lrr - 1.959963984540054 * se_hc0), 6) as razao_low, round(exp(lrr + 1.959963984540054 * se_hc0), 6) as razao_high from a""")
def _(w):
    run = w.run()
    odds = T.effect_table(w.spark, [(f, "model") for f in run.fit_all(run.ladder()[:1])])
    rates = T.effect_table(w.spark, [(f, "hc0") for f in run.fit_all(run.or_vs_rr()[1:2])])
    return ratios_beside_odds(odds, rates).select(
        "modelo", "grupo", r6(F.col("estimativa")).alias("odds"),
        *[r6(F.col(c)).alias(c) for c in ("razao", "razao_low", "razao_high")])


# Odds ratios of the ladder beside the prevalence ratios of the models that have them.
ODDS_AND_RATES_SQL = f"""{newton("f", SETTINGS.ladder() + SETTINGS.or_vs_rr()[1::2], "focus")},
o as (select o.modelo, o.grupo, o.nobs, exp(o.b) as odds, {interval("o.b", "o.se", "odds")}, exp(r.b) as razao,
    {interval("r.b", "r.se_hc0", "razao")}
  from f_effects o left join f_effects r on r.family = 'poisson' and r.grupo = o.grupo
    and split_part(r.modelo, '_', 1) = split_part(o.modelo, '_', 1) where o.family = 'binomial')"""


@query("d07_ratio_beside_odds_ladder", f"""
with recursive {ODDS_AND_RATES_SQL}
select modelo, grupo, round(odds, 6) as odds, round(razao, 6) as razao, round(razao_low, 6) as razao_low,
  round(razao_high, 6) as razao_high from o""")
def _(w):
    """Odds ratios of all eight models with the prevalence ratios of M1, M5 and M8 beside them."""
    run = w.run()
    odds = T.effect_table(w.spark, [(f, "model") for f in run.fit_all(run.ladder())])
    rates = T.effect_table(w.spark, [(f, "hc0") for f in run.fit_all(run.or_vs_rr()[1::2])])
    return ratios_beside_odds(odds, rates).select(
        "modelo", "grupo", r6(F.col("estimativa")).alias("odds"),
        *[r6(F.col(c)).alias(c) for c in ("razao", "razao_low", "razao_high")])


def education_sql(p: str, name: str) -> str:
    return f"""select split_part(modelo, '_', 1) as modelo, grupo, case when family = 'binomial' then 'OR' else 'RR' end as medida,
  round(exp(b), 6) as {name}_estimativa, {interval("b", "case when family = 'binomial' then se else se_hc0 end", f"{name}_ic", True)}
  from {p}_effects"""


@query("d08_education_ratios", f"""
with recursive {newton("a", SETTINGS.or_vs_rr()[2:], "focus")}, {newton("v", SETTINGS.or_vs_rr()[2:], "focus", **OTHER_EDUCATION)}
select * from ({education_sql("a", "escmae")}) join ({education_sql("v", "escmae2010")}) using (modelo, grupo, medida)""")
def _(w):
    """Odds and prevalence ratios of M5 and M8 under both education variables."""
    def table(arm, name):
        run = w.run(arm)
        logistic_and_rates = zip(run.fit_all(run.or_vs_rr()[2:]), ("model", "hc0") * 2)
        return T.effect_table(w.spark, list(logistic_and_rates)).select(
            F.split("modelo", "_")[0].alias("modelo"), "grupo", "medida",
            *[r6(F.col(c)).alias(f"{name}_{c}") for c in ("estimativa", "ic_low", "ic_high")])

    return table("ESCMAE", "escmae").join(table("ESCMAE2010", "escmae2010"), ["modelo", "grupo", "medida"])


@query("d08_education_variants", """
with o as (select raca as grupo, count(*) as n, 100 * avg(ptb) as p from cohort where in_primary group by 1),
v as (select raca as grupo, count(*) as n, 100 * avg(ptb) as p from cohort where in_primary_2010 group by 1)
select grupo, o.n as escmae_n, round(o.p, 6) as escmae_pct, v.n as escmae2010_n, round(v.p, 6) as escmae2010_pct
from o join v using (grupo)""")
def _(w):
    flags = {"escmae": "in_primary", "escmae2010": "in_primary_2010"}
    return w.cohort.where("in_primary or in_primary_2010").groupBy(F.col("raca").alias("grupo")).agg(*[
        m for name, flag in flags.items()
        for m in (F.count_if(flag).alias(f"{name}_n"),
                  r6(share(F.when(F.col(flag), F.col("ptb")))).alias(f"{name}_pct"))])


@query("d09_dense_grid", """
select t.n_name as uf, cast(y.ano as int) as ano, count(c.ptb) as n,
  case when count(c.ptb) = 0 then null else round(100.0 * sum(c.ptb) / count(c.ptb), 6) end as ptb_pct
from nation t cross join range(1994, 2003) y(ano)
left join (select UF, ANO, ptb from cohort where in_primary and raca = 'Indigena') c on c.UF = t.n_name and c.ANO = y.ano
group by 1, 2""")
def _(w):
    counts = (w.cohort.where(F.col("in_primary") & (F.col("raca") == V.RACE_FOCAL))
              .groupBy(F.col("UF").alias("uf"), F.col("ANO").alias("ano"))
              .agg(F.count("*").alias("n"), F.sum("ptb").alias("s")))
    grid = dense(counts, w.states.select(F.col("UF").alias("uf")), {"ano": list(EXPECTED_FILE_YEARS)})
    return grid.select("uf", "ano", "n", r6(100 * F.try_divide("s", "n")).alias("ptb_pct"))


@query("d10_order_by_other_key", """
with p as (select UF, raca, count(*) as n, 100 * avg(ptb) as pct from cohort where in_primary and raca in ('Branca', 'Indigena') group by 1, 2)
select i.UF as uf, round(b.pct, 6) as branca_pct, round(i.pct, 6) as indigena_pct, i.n as n_focal
from p i left join p b on i.UF = b.UF and b.raca = 'Branca' where i.raca = 'Indigena'""")
def _(w):
    table = D.prevalence(w.cohort, "UF", "raca")
    wide = table.groupBy("UF").pivot("raca", [V.RACE_REFERENCE, V.RACE_FOCAL]).agg(F.first("ptb_pct"))
    order = table.where(F.col("raca") == V.RACE_FOCAL).select("UF", F.col("n").alias("n_focal"))
    return wide.join(order, "UF").orderBy(F.desc("n_focal"), "UF").select(
        F.col("UF").alias("uf"), r6(F.col(V.RACE_REFERENCE)).alias("branca_pct"),
        r6(F.col(V.RACE_FOCAL)).alias("indigena_pct"), "n_focal")


@query("d11_missing_metrics", """
select t.n_name as uf, r.raca from nation t cross join (select unnest(['Branca', 'Parda', 'Preta', 'Indigena']) as raca) r
where not exists (select 1 from cohort c where c.in_sens and c.mesp1trim = '1' and c.cons_cat = 'Ignorado' and c.UF = t.n_name and c.raca = r.raca)""")
def _(w):
    expected = with_levels(w.states.select(F.col("UF").alias("uf")), {"raca": list(V.RACE_LEVELS)})
    found = (w.cohort.where("in_sens and mesp1trim = '1' and cons_cat = 'Ignorado'")
             .select(F.col("UF").alias("uf"), "raca").distinct())
    return expected.join(found, ["uf", "raca"], "left_anti")


@query("d12_published_ratios", f"""
with {crude_sql("v", "in_primary_var")}
select 'M1' as modelo, round(exp(b), 6) as estimativa, round(aic, 4) as aic, nobs as n, cast(1.781 as double) as publicado from v
where grupo = 'Indigena'""")
def _(w):
    run = w.run("variant", True)
    fits = run.fit_all(run.variant()[:1])
    return R.published_ratios(T.effect_table(w.spark, [(f, "model") for f in fits])).select(
        "modelo", r6(F.col("estimativa")).alias("estimativa"), F.round("aic", 4).alias("aic"), "n", "publicado")


PUBLISHED_SQL = "(values " + ", ".join(f"('{m}', {v})" for m, v in V.PUBLISHED_FOCAL_OR.items()) + ") as p(curto, publicado)"


@query("d12_published_ratios_models", f"""
with recursive {newton("v", SETTINGS.variant(), "cohort", **VARIANT)}
select modelo, round(exp(b), 6) as estimativa, round(aic, 4) as aic, nobs as n, cast(k as int) as n_params, cast(publicado as double) as publicado
from v_effects left join {PUBLISHED_SQL} on curto = split_part(modelo, '_', 1) where grupo = 'Indigena'""")
def _(w):
    """Focal odds ratios of all published models beside the published ones, with their parameters."""
    run = w.run("variant", True)
    fits = run.fit_all(run.variant())
    params = w.spark.createDataFrame([(f.model.name, len(f.terms)) for f in fits], "modelo string, n_params int")
    return R.published_ratios(T.effect_table(w.spark, [(f, "model") for f in fits])).join(params, "modelo").select(
        "modelo", r6(F.col("estimativa")).alias("estimativa"), F.round("aic", 4).alias("aic"), "n", "n_params",
        "publicado")
