"""Models on cells.

Fits with a closed form are compared with it. For the others the fitted totals per factor level,
computed from predictions, are compared with the observed totals, which they equal at the optimum;
their coefficients, errors and AIC are tested against a dense fit in tests/test_models.py.
"""

from pyspark.sql import functions as F

from vitalcells.plans import studies as T
from vitalcells.plans.studies import Task
from vitalcells.operators.glm import Model
from vitalcells.operators import describe as D
from vitalcells.registry.aggregates_q import FOCUS_LABELS, SIZE_CONDITIONS, rounded
from vitalcells.registry.base import Workspace, query
from vitalcells.registry.joins_q import crude_sql
from vitalcells.registry.newton_sql import (OTHER_EDUCATION, SETTINGS, SQL_COLUMN, VARIANT, newton,
                                            standardised)
from vitalcells.sources import star_births as S

Z = "1.959963984540054"
# Two-sided normal p-value from the series of the error function, for |z| below 6.
P_VALUE = ("1 - (2 / sqrt(pi())) * list_sum([(case when k % 2 = 0 then 1 else -1 end) "
           "* exp((2 * k + 1) * ln(greatest(abs({z}) / sqrt(2), 1e-12)) - lgamma(k + 1)) / (2 * k + 1) "
           "for k in range(0, 120)])")



def margins(tasks: list[Task], source: str, primary: str = "in_primary", sens: str = "in_sens",
            columns: dict | None = None, where: dict | None = None) -> str:
    """Observed outcome totals per model, factor and level, over the complete rows of each model."""
    columns = {**SQL_COLUMN, **(columns or {})}
    parts = []
    for task in tasks:
        m = task.model

        def col(f):
            return columns.get(f, f)

        condition = " and ".join([
            sens if task.sample == "sens" else primary, (where or {}).get(m.name, "true"),
            *[f"{col(f)} is not null" for f in m.keys]])
        rows = [(f, f"cast({col(f)} as varchar)", "ptb") for f in m.factors]
        rows += [(x, "'sum'", f"ptb * {col(x)}") for x in m.linear]
        rows += [(f"{f}:{g}", f"{col(f)} || ':' || {col(g)}", "ptb") for f, g in m.interactions]
        parts += [f"select '{m.name}' as modelo, '{f}' as fator, {level} as nivel, "
                  f"round(cast(sum({value}) as double), 3) as ajustado from {source} where {condition} group by 3"
                  for f, level, value in rows]
    return " union all ".join(parts)


def margin_rows(w: Workspace, fits):
    return T.margin_table(w.spark, fits).select(
        "modelo", "fator", "nivel", (F.round("ajustado", 3) + F.lit(0.0)).alias("ajustado"))


def effect_rows(w: Workspace, fits):
    return rounded(T.effect_table(w.spark, fits))


EFFECT_SQL = """
select '{name}' as modelo, grupo, '{measure}' as medida, '{se_type}' as se_tipo, round(exp({b}), 6) as estimativa,
  round(exp({b} - {z} * {se}), 6) as ic_low, round(exp({b} + {z} * {se}), 6) as ic_high,
  round({p}, 6) as p_valor, round({aic}, 6) as aic, nobs as n, 'ok' as situacao from {table}"""


def effect_sql(name, measure, se_type, b, se, aic, table):
    return EFFECT_SQL.format(name=name, measure=measure, se_type=se_type, b=b, se=se, z=Z, aic=aic,
                             table=table, p=P_VALUE.format(z=f"({b} / {se})"))


def cluster_sql(name: str, flag: str, source: str, correction: str, poisson: bool = False) -> str:
    """Crude model with influence summed per town; `correction` is the finite-sample numerator."""
    scale = "n * p" if poisson else "n * p * (1 - p)"
    return f"""
{name}_t as (select raca, CODMUNRES, cast(sum(ptb) as double) as s, cast(count(*) as double) as n from {source} where {flag} group by 1, 2),
{name}_q as (select raca, sum(s) / sum(n) as p, sum(n) as n from {name}_t group by 1),
{name}_i as (select t.raca, t.CODMUNRES, (t.s - t.n * q.p) / (select {scale} from {name}_q z where z.raca = t.raca) as psi
  from {name}_t t join {name}_q q using (raca)),
{name}_k as (select count(distinct CODMUNRES) as g, {correction} as nn from {name}_t),
{name}_se as (select grp.raca as grupo, sqrt(k.g / (k.g - 1.0) * (k.nn - 1.0) / (k.nn - 4.0) * sum(power(coalesce(a.psi, 0) - coalesce(b.psi, 0), 2))) as se
  from (select unnest(['Parda', 'Preta', 'Indigena']) as raca) grp cross join (select distinct CODMUNRES from {name}_t) m cross join {name}_k k
  left join {name}_i a on a.raca = grp.raca and a.CODMUNRES = m.CODMUNRES
  left join {name}_i b on b.raca = 'Branca' and b.CODMUNRES = m.CODMUNRES group by 1, k.g, k.nn)"""


@query("h01_logistic_crude", f"""
with {crude_sql("a", "in_primary")} {effect_sql("M1_logit", "OR", "model", "b", "se", "aic", "a")}""")
def _(w):
    run = w.run(national=True)
    return effect_rows(w, [(run.fit(run.national()[0]), "model")])


@query("h01_logistic_m5_margins", margins(SETTINGS.national()[2:3], "cohort"))
def _(w):
    run = w.run(national=True)
    return margin_rows(w, [run.fit(run.national()[2])])


@query("h02_poisson_crude", f"""
with {crude_sql("a", "in_primary")} {effect_sql("M1_poisson_RR", "RR", "model", "lrr", "se_pois", "aic_pois", "a")}""")
def _(w):
    run = w.run(national=True)
    return effect_rows(w, [(run.fit(run.national()[1]), "model")])


@query("h02_poisson_m5_margins", margins(SETTINGS.national()[3:4], "cohort"))
def _(w):
    run = w.run(national=True)
    return margin_rows(w, [run.fit(run.national()[3])])


@query("h03_hc0_crude", f"""
with {crude_sql("a", "in_primary", "focus")} {effect_sql("M1_Poisson", "RR", "hc0", "lrr", "se_hc0", "aic_pois", "a")}""")
def _(w):
    run = w.run()
    return effect_rows(w, [(run.fit(run.or_vs_rr()[1]), "hc0")])


@query("h04_cluster_crude", f"""
with {crude_sql("a", "in_primary", "focus")},
{cluster_sql("c", "in_primary", "focus", "sum(n)")}, j as (select a.* exclude (se), c_se.se as se from a join c_se using (grupo))
{effect_sql("M1_Logistic", "OR", "cluster", "b", "se", "aic", "j")}""")
def _(w):
    run = w.run()
    return effect_rows(w, [(run.fit(run.or_vs_rr()[0]), "cluster")])


@query("h05_ladder_margins", margins(SETTINGS.ladder(), "focus"))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.ladder()))


def fitted_sql(kinds: list[tuple[str, str, str]], table: str = "f_effects", more: str = "") -> str:
    """Effect rows of models fitted in SQL, per (family, kind of errors, column that holds them)."""
    return " union all ".join(
        EFFECT_SQL.format(name="", measure="OR" if family == "binomial" else "RR", se_type=kind, b="b", se=se, z=Z,
                          aic="aic", p=P_VALUE.format(z=f"(b / {se})"), table=table)
        .replace("select '' as modelo", "select modelo").replace(" as situacao", f" as situacao{more}")
        + f" where family = '{family}'" for family, kind, se in kinds)


LOGISTIC = [("binomial", "model", "se")]
BOTH = [*LOGISTIC, ("poisson", "model", "se")]
YEAR_OF_MODEL = ", case when modelo like 'Ano~_%' escape '~' then cast(split_part(modelo, '_', 2) as int) end as ano"
ROBUST = [("binomial", "cluster", "se_cluster"), ("poisson", "hc0", "se_hc0"), ("poisson", "cluster", "se_cluster")]
# The effects beside the cluster errors.
WITH_CLUSTER = "f_all as (select e.*, c.se as se_cluster from f_effects e join f_cluster c using (modelo, grupo))"


@query("h05_ladder_effects", f"with recursive {newton('f', SETTINGS.ladder(), 'focus')} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.ladder())])


@query("e19_sample_sizes_and_ratio", f"""with recursive {newton('f', SETTINGS.ladder()[7:], 'focus')}
""" + " union all ".join(f"select '{name}' as amostra, cast(count(*) as double) as n from focus where {cond}"
                         for name, cond in SIZE_CONDITIONS.items())
       + " union all select 'OR_M8_canonico_Indig', round(exp(b), 3) from f_effects where grupo = 'Indigena'")
def _(w):
    """The sample sizes, and the full model's focal odds ratio that goes with them."""
    run = w.run()
    return D.with_canonical_ratio(D.sample_sizes(w.focus, S.YEARS[1], w.focus_states),
                                  T.focal_ratios(w.spark, [run.fit(run.ladder()[-1])]))


@query("h06_effect_rows", f"""
with {crude_sql("a", "in_primary", "focus")}, {crude_sql("s", "in_primary and singleton", "focus")}
{effect_sql("M1_Crude", "OR", "model", "b", "se", "aic", "a")} union all
{effect_sql("singletons_M1_Crude", "OR", "model", "b", "se", "aic", "s")}""")
def _(w):
    run = w.run()
    whole, single = run.fit(run.ladder()[0]), run.fit(run.singletons()[0])
    return effect_rows(w, [(whole, "model")]).unionByName(
        effect_rows(w, [(single, "model")]).withColumn("modelo", F.concat(F.lit("singletons_"), "modelo")))


def parameter_count(model: Model, source: str, flag: str) -> str:
    complete = " and ".join([flag, *[f"{SQL_COLUMN.get(f, f)} is not null" for f in model.factors]])
    return "1 + " + " + ".join(f"(select count(distinct {SQL_COLUMN.get(f, f)}) - 1 from {source} where {complete})"
                               for f in model.factors)


@query("h07_design_audit", " union all ".join(
    f"select '{t.model.name}' as modelo, cast({parameter_count(t.model, 'focus', 'in_sens')} as int) as n_params, "
    f"{'parid_cat' in t.model.factors} as tem_paridade, {'estciv_cat' in t.model.factors} as tem_estado_civil, "
    f"{'null' if i == 0 else 'true'} as aic_mudou" for i, t in enumerate(SETTINGS.ladder()[5:])))
def _(w):
    run = w.run()
    return T.design_audit(w.spark, run.fit_all(run.ladder()[5:])).drop("aic")


AUDIT = " union all ".join(f"select '{t.model.name}' as modelo, {i} as ordem, {'parid_cat' in t.model.factors} as tem_paridade, "
                           f"{'estciv_cat' in t.model.factors} as tem_estado_civil"
                           for i, t in enumerate(SETTINGS.ladder()[5:]))


@query("h07_design_audit_effects", f"""with recursive {newton('f', SETTINGS.ladder()[5:], 'focus')}, d as ({AUDIT})
select modelo, cast(e.k as int) as n_params, round(e.aic, 2) as aic, tem_paridade, tem_estado_civil,
  abs(e.aic - lag(e.aic) over (order by ordem)) >= 0.01 as aic_mudou, round(exp(e.b), 6) as focal_or
from d join f_effects e using (modelo) where e.grupo = 'Indigena'""")
def _(w):
    """The whole audit: parameters, AIC, whether it moved, and the focal odds ratio."""
    run = w.run()
    fits = run.fit_all(run.ladder()[5:])
    focal = T.focal_ratios(w.spark, fits).withColumn("focal_or", F.round("focal_or", 6))
    return T.design_audit(w.spark, fits).withColumn("aic", F.round("aic", 2)).join(focal, "modelo")


@query("h08_or_vs_rr_crude", f"""
with {crude_sql("a", "in_primary", "focus")},
{cluster_sql("c", "in_primary", "focus", "sum(n)")}, {cluster_sql("d", "in_primary", "focus", "sum(n)", True)},
j as (select a.* exclude (se), c_se.se as se, d_se.se as se_d from a join c_se using (grupo) join d_se using (grupo))
{effect_sql("M1_Logistic", "OR", "cluster", "b", "se", "aic", "j")} union all
{effect_sql("M1_Poisson", "RR", "hc0", "lrr", "se_hc0", "aic_pois", "j")} union all
{effect_sql("M1_Poisson", "RR", "cluster", "lrr", "se_d", "aic_pois", "j")}""")
def _(w):
    run = w.run()
    logistic, poisson = run.fit_all(run.or_vs_rr()[:2])
    return effect_rows(w, [(logistic, "cluster"), (poisson, "hc0"), (poisson, "cluster")])


@query("h08_or_vs_rr_margins", margins(SETTINGS.or_vs_rr(), "focus"))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.or_vs_rr()))


@query("h08_or_vs_rr_effects", f"with recursive {newton('f', SETTINGS.or_vs_rr(), 'focus', towns=True)}, "
       f"{WITH_CLUSTER} {fitted_sql(ROBUST, 'f_all')}")
def _(w):
    return or_vs_rr(w)


def or_vs_rr(w):
    run = w.run()
    return effect_rows(w, [(f, se) for f in run.fit_all(run.or_vs_rr())
                           for se in (("cluster",) if f.model.family == "binomial" else ("hc0", "cluster"))])


SATURATED = Model("raca_uf", ("raca", "uf_cat"), interactions=(("raca", "uf_cat"),))


@query("h09_standardised_saturated", """
with c as (select raca, UF, avg(ptb) as p from focus where in_primary group by 1, 2),
n as (select UF, count(*) as n from focus where in_primary group by 1),
s as (select raca, 100 * sum(n * p) / sum(n) as v from c join n using (UF) group by 1)
select raca as grupo, round(v, 6) as p_ajustada_pct, round(v - (select v from s where raca = 'Branca'), 6) as dif_pp from s""")
def _(w):
    return rounded(T.adjusted_probabilities(w.run(), Task(SATURATED, "primary")))


@query("h09_standardised_m5", f"with recursive {newton('f', SETTINGS.ladder()[4:5], 'focus')}, "
       f"s as ({standardised('f', 'M5_PRIMARY')}) select grupo, round(v, 6) as p_ajustada_pct, "
       "round(v - (select v from s where grupo = 'Branca'), 6) as dif_pp from s")
def _(w):
    run = w.run()
    return rounded(T.adjusted_probabilities(run, run.ladder()[4]))


@query("h10_coding_margins", margins(SETTINGS.coding(), "focus"))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.coding()))


@query("h10_coding_effects", f"with recursive {newton('f', SETTINGS.coding(), 'focus')} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.coding())])


# The chi-square tail for even degrees of freedom is a finite sum.
@query("h11_interaction_saturated", """
with c as (select raca, UF, cast(sum(ptb) as double) as s, cast(count(*) as double) as n from focus where in_primary group by 1, 2),
g as (select raca, sum(s) as s, sum(n) as n from c group by 1),
l as (select (select sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) from c) as l1, (select count(*) from c) as k1,
             (select sum(s * ln(s / n) + (n - s) * ln(1 - s / n)) from g) as l0, (select count(*) from g) as k0)
select round(2 * (l1 - l0), 6) as lrt_chi2, cast(k1 - k0 as int) as gl,
  round(exp(-(l1 - l0)) * list_sum([exp(i * ln(l1 - l0) - lgamma(i + 1)) for i in range(0, (k1 - k0) // 2)]), 6) as p_valor,
  round(-2 * l0 + 2 * k0, 6) as aic_sem, round(-2 * l1 + 2 * k1, 6) as aic_com from l""")
def _(w):
    run = w.run()
    return rounded(T.interaction_test(w.spark, *run.fit_all(run.interaction_saturated())))


@query("h11_interaction_margins", margins(SETTINGS.interaction(), "focus"))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.interaction()))


@query("h11_interaction_test", f"""with recursive {newton('f', SETTINGS.interaction(), 'focus')},
l as (select max(loglik) - min(loglik) as d, max(k) - min(k) as df, max(case when modelo like '%sem%' then aic end) as aic_sem,
  max(case when modelo like '%com%' then aic end) as aic_com from f_models)
select round(2 * d, 6) as lrt_chi2, cast(df as int) as gl,
  round(exp(-d) * list_sum([exp(i * ln(d) - lgamma(i + 1)) for i in range(0, df // 2)]), 6) as p_valor,
  round(aic_sem, 6) as aic_sem, round(aic_com, 6) as aic_com from l""")
def _(w):
    run = w.run()
    return rounded(T.interaction_test(w.spark, *run.fit_all(run.interaction())))


STRATA = FOCUS_LABELS
STRATUM = {t.model.name: f"UF = '{uf}'" for uf in STRATA for t in SETTINGS.stratified([uf])}
YEAR = {f"Ano_{y}": f"ANO = {y}" for y in range(1995, 2002)}
BLOCK = {name: f"ANO between {low} and {high}" for name, (low, high) in S.PERIODS.items()}
WITHOUT_LAST = {t.model.name: "ANO <> 2001" for t in SETTINGS.last_year() if "sem" in t.model.name}
SINGLE = {t.model.name: "singleton" for t in SETTINGS.singletons()}
KNOWN_MONTH = {t.model.name: "mesp1trim is not null" for t in SETTINGS.prenatal()}


@query("h12_stratified_margins", margins(
    SETTINGS.stratified(STRATA), "focus",
    where=STRATUM))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.stratified(w.focus_states)))


@query("h12_stratified_effects", f"with recursive {newton('f', SETTINGS.stratified(STRATA), 'focus', where=STRATUM)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.stratified(w.focus_states))])


SPARSE_TASKS = {uf: Task(Model(f"M1_{uf}_ignorado", T.M1), "sens", f"uf_cat = '{uf}' and cons_cat = 'Ignorado'") for uf in STRATA}


@query("h12_sparse_strata", """
with t as (select 'M1_' || UF || '_ignorado' as modelo, raca, cast(sum(ptb) as double) as s, cast(count(*) as double) as n
  from focus where in_sens and cons_cat = 'Ignorado' group by 1, 2),
j as (select g.modelo, g.raca as grupo, g.s, g.n, b.s as bs, b.n as bn, (select sum(n) from t z where z.modelo = g.modelo) as nobs,
  g.s > 0 and g.s < g.n and b.s > 0 and b.s < b.n as both_ways from t g join t b on b.modelo = g.modelo and b.raca = 'Branca' where g.raca <> 'Branca')
select modelo, grupo, case when both_ways then 'ok' else 'separada' end as situacao, cast(nobs as bigint) as n,
  case when both_ways then round((s / (n - s)) / (bs / (bn - bs)), 6) end as estimativa,
  case when both_ways then round(exp(ln((s / (n - s)) / (bs / (bn - bs))) - 1.959963984540054 * sqrt(1 / s + 1 / (n - s) + 1 / bs + 1 / (bn - bs))), 6) end as ic_low
from j""")
def _(w):
    """Small strata, where some groups always or never have the outcome: a reason in place of a number,
    and the other groups' ratios."""
    run = w.run()
    tasks = [SPARSE_TASKS[uf] for uf in w.focus_states]
    return effect_rows(w, [(f, "model") for f in run.fit_all(tasks)]).select(
        "modelo", "grupo", "situacao", "n", "estimativa", "ic_low")


@query("h13_yearly_margins", margins(
    SETTINGS.yearly(), "focus", where=YEAR))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.yearly()))


@query("h13_block_margins", margins(
    SETTINGS.blocks(), "focus",
    where=BLOCK))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.blocks()))


@query("h13_temporal_effects", f"with recursive {newton('f', SETTINGS.yearly() + SETTINGS.blocks(), 'focus', where=YEAR | BLOCK)} {fitted_sql(LOGISTIC, more=YEAR_OF_MODEL)}")
def _(w):
    run = w.run()
    return T.by_year(effect_rows(w, [(f, "model") for f in run.fit_all(run.yearly() + run.blocks())]))


@query("h14_last_year_margins", margins(
    SETTINGS.last_year(), "focus",
    where=WITHOUT_LAST))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.last_year()))


@query("h14_last_year_effects", f"with recursive {newton('f', SETTINGS.last_year(), 'focus', where=WITHOUT_LAST)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.last_year())])


@query("h15_singleton_margins", margins(
    SETTINGS.singletons(), "focus", where=SINGLE))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.singletons()))


@query("h15_singleton_effects", f"with recursive {newton('f', SETTINGS.singletons(), 'focus', where=SINGLE)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.singletons())])


@query("h16_prenatal_margins", margins(
    SETTINGS.prenatal(), "focus",
    where=KNOWN_MONTH))
def _(w):
    run = w.run()
    return margin_rows(w, run.fit_all(run.prenatal()))


@query("h16_prenatal_effects", f"with recursive {newton('f', SETTINGS.prenatal(), 'focus', where=KNOWN_MONTH)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run()
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.prenatal())])


@query("h17_national_margins", margins(SETTINGS.national(), "cohort"))
def _(w):
    run = w.run(national=True)
    return margin_rows(w, run.fit_all(run.national()))


@query("h17_national_effects", f"with recursive {newton('f', SETTINGS.national(), 'cohort')} {fitted_sql(BOTH)}")
def _(w):
    run = w.run(national=True)
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.national())])


@query("h18_national_cluster", f"""
with {crude_sql("a", "in_primary")},
{cluster_sql("c", "in_primary", "cohort", "count(*)")}, j as (select a.* exclude (se), c_se.se as se from a join c_se using (grupo))
{effect_sql("M1_logit_cluster_muni", "OR", "cluster", "b", "se", "aic", "j")}""")
def _(w):
    run = w.run(national=True)
    return effect_rows(w, [(run.fit(run.national_cluster()[0]), "cluster")])


@query("h19_national_yearly_margins", margins(
    SETTINGS.yearly(), "cohort", where=YEAR))
def _(w):
    run = w.run(national=True)
    return margin_rows(w, run.fit_all(run.yearly()))


@query("h19_national_yearly_effects", f"with recursive {newton('f', SETTINGS.yearly(), 'cohort', where=YEAR)} {fitted_sql(LOGISTIC, more=YEAR_OF_MODEL)}")
def _(w):
    run = w.run(national=True)
    return T.by_year(effect_rows(w, [(f, "model") for f in run.fit_all(run.yearly())]))


@query("h20_variant_margins", margins(
    SETTINGS.variant(), "focus", **VARIANT))
def _(w):
    run = w.run("variant")
    return margin_rows(w, run.fit_all(run.variant()))


@query("h20_variant_effects", f"with recursive {newton('f', SETTINGS.variant(), 'focus', **VARIANT)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run("variant")
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.variant())])


@query("h21_other_education_margins", margins(
    SETTINGS.ladder(), "focus", **OTHER_EDUCATION))
def _(w):
    run = w.run("ESCMAE2010")
    return margin_rows(w, run.fit_all(run.ladder()))


@query("h21_other_education_effects", f"with recursive {newton('f', SETTINGS.ladder(), 'focus', **OTHER_EDUCATION)} {fitted_sql(LOGISTIC)}")
def _(w):
    run = w.run("ESCMAE2010")
    return effect_rows(w, [(f, "model") for f in run.fit_all(run.ladder())])
