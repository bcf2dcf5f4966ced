"""Report tables and the data behind the figures."""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.text import count_text, decimal_text, interval_text
from vitalcells.operators import describe as D
from vitalcells.operators.reshape import excluded_per_step, union_all
from vitalcells.plans import cube as Q
from vitalcells.plans import reconcile as C
from vitalcells.plans import reports as R
from vitalcells.plans import studies as T
from vitalcells.registry.aggregates_q import (EXPOSURE_GRID_SQL, MISSING_CONDITIONS, STUDY_YEARS,
                                              rounded)
from vitalcells.registry.base import Workspace, query
from vitalcells.registry.joins_q import (ADJUSTED_SQL, ODDS_AND_RATES_SQL, PUBLISHED_SQL, crude_sql,
                                         variant_cohort)
from vitalcells.registry.models_q import (BLOCK, KNOWN_MONTH, STRATA, STRATUM, WITH_CLUSTER, YEAR, Z,
                                          cluster_sql)
from vitalcells.registry.newton_sql import (OTHER_EDUCATION, SETTINGS, VARIANT, compared, newton,
                                            standardised)
from vitalcells.registry.normalise_q import br_sql
from vitalcells.registry.reshape_q import TOP_STATES_SQL
from vitalcells.registry.sources_q import CASCADE_SQL
from vitalcells.sources import star_births as S


def odds_and_rates(w: Workspace, models: int | None = None):
    """Ladder odds ratios, and the HC0 prevalence ratios of the models that have them."""
    run = w.run()
    poisson = [t for t in run.or_vs_rr() if t.model.family == "poisson"]
    odds = T.effect_table(w.spark, [(f, "model") for f in run.fit_all(run.ladder()[:models])])
    rates = T.effect_table(w.spark, [(f, "hc0") for f in run.fit_all(poisson[:models])])
    return odds, rates


def group_cells(g: str) -> str:
    def one(value):
        return f"max(case when grupo = '{g}' then {value} end)"

    low, high = f"exp(b - {Z} * se)", f"exp(b + {Z} * se)"
    plow, phigh = f"exp(lrr - {Z} * se_hc0)", f"exp(lrr + {Z} * se_hc0)"
    key = g.lower()
    return (f"{br_sql(one('exp(b)'), 3)} as {key}_or, {br_sql(one(low), 3)} || '–' || {br_sql(one(high), 3)} as {key}_ic, "
            f"{br_sql(one('exp(lrr)'), 3)} as {key}_pr, {br_sql(one(plow), 3)} || '–' || {br_sql(one(phigh), 3)} as {key}_pr_ic")


@query("i01_revised_table2_crude", f"""
with {crude_sql("a", "in_primary", "focus")}
select 'M1 Crude' as modelo, {br_sql("max(nobs)", 0)} as n, {", ".join(group_cells(g) for g in V.RACE_LEVELS[1:])},
  '0,0' as indigena_pct_atenuacao from a""")
def _(w):
    odds, rates = odds_and_rates(w, 1)
    return R.revised_table2(odds, rates)


def table2_cell(g: str) -> str:
    """Text cells of one group; a model without prevalence ratio has blanks."""
    def one(value):
        return f"max(case when grupo = '{g}' then {value} end)"

    def ends(name):
        return f"{br_sql(one(f'{name}_low'), 3)} || '–' || {br_sql(one(f'{name}_high'), 3)}"

    key = g.lower()
    return (f"{br_sql(one('odds'), 3)} as {key}_or, {ends('odds')} as {key}_ic, {br_sql(one('razao'), 3)} as {key}_pr, "
            f"case when {one('razao')} is null then '' else {ends('razao')} end as {key}_pr_ic")


REMOVED = "100 * (round(c.odds, 3) - round(o.odds, 3)) / (round(c.odds, 3) - 1)"


@query("i01_revised_table2", f"""
with recursive {ODDS_AND_RATES_SQL},
r as (select o.*, case when {REMOVED} = 0 then 0 else {REMOVED} end as removed from o join o c on c.modelo = 'M1_Crude' and c.grupo = o.grupo)
select replace(modelo, '_', ' ') as modelo, {br_sql("max(nobs)", 0)} as n, {", ".join(table2_cell(g) for g in V.RACE_LEVELS[1:])},
  {br_sql("max(case when grupo = 'Indigena' then removed end)", 1)} as indigena_pct_atenuacao from r group by modelo""")
def _(w):
    return R.revised_table2(*odds_and_rates(w))


RECONCILED_SQL = f"""
with {crude_sql("a", "in_primary")}, {crude_sql("v", "in_primary_var")},
yo as (select ANO, count(*) as n from cohort where in_primary group by 1),
yv as (select ANO, count(*) as n from cohort where in_primary_var group by 1),
po as (select raca, 100 * avg(ptb) as p from cohort where in_primary group by 1),
pv as (select raca, 100 * avg(ptb) as p from cohort where in_primary_var group by 1),
parts as (
  select 'amostras' as secao, 'primaria_M1-5' as metrica, cast(count(case when in_primary then 1 end) as double) as nosso,
    cast(count(case when in_primary_var then 1 end) as double) as referencia from cohort
  union all select 'amostras', 'sensibilidade_M6-8', count(case when in_sens then 1 end), count(case when in_sens_var then 1 end) from cohort
  union all select 'amostras', 'singletons_primaria', count(case when in_primary and singleton then 1 end), count(case when in_primary_var and singleton then 1 end) from cohort
  union all select 'amostras', 'singletons_sensib', count(case when in_sens and singleton then 1 end), count(case when in_sens_var and singleton then 1 end) from cohort
  union all select 'amostras', 'mesprenat_subsample', count(case when in_sens and mesp1trim is not null then 1 end), count(case when in_sens_var and mesp1trim is not null then 1 end) from cohort
  union all select 'amostras', 'sem_ultimo_ano_primaria', count(case when in_primary and ANO < 2001 then 1 end), count(case when in_primary_var and ANO < 2001 then 1 end) from cohort
  union all select 'amostras', 'sem_ultimo_ano_sensib', count(case when in_sens and ANO < 2001 then 1 end), count(case when in_sens_var and ANO < 2001 then 1 end) from cohort
  union all select 'amostras', 'ultimo_ano_contribuicao', count(case when in_primary and ANO = 2001 then 1 end), count(case when in_primary_var and ANO = 2001 then 1 end) from cohort
  union all select 'or_modelo', 'M1_Crude', exp(a.b), exp(v.b) from a join v using (grupo) where grupo = 'Indigena'
  union all select 'probabilidades', raca, po.p, pv.p from po join pv using (raca)
  union all select 'anos', cast(ANO as varchar), yo.n, yv.n from yo join yv using (ANO))
select secao, metrica, round(nosso, 6) as nosso, round(referencia, 6) as referencia, round(nosso - referencia, 6) as delta from parts"""


@query("i02_reconciliation", RECONCILED_SQL)
def _(w):
    ours, theirs = w.cohort, variant_cohort(w)
    runs = [w.run("ESCMAE", True), w.run("variant", True)]
    crude = [T.effect_table(w.spark, [(run.fit(run.ladder()[0]), "model")]) for run in runs]
    adjusted = [T.adjusted_probabilities(run, run.ladder()[0]) for run in runs]
    years = [c.where("in_primary").groupBy(F.col("ANO").alias("ano")).agg(F.count("*").alias("n"))
             for c in (ours, theirs)]
    sizes = [D.sample_sizes(c, S.YEARS[1], []) for c in (ours, theirs)]
    return rounded(union_all([
        C.section(C.sample_sizes(*sizes), "amostras", F.col("amostra")),
        C.section(C.ratios_by_model(*crude), "or_modelo", F.col("modelo")),
        C.section(C.probabilities(*adjusted), "probabilidades", F.col("grupo")),
        C.section(C.year_counts(*years), "anos", F.col("ano")),
    ]))


@query("i02_reconciliation_adjusted", f"with recursive {ADJUSTED_SQL} select * from p")
def _(w):
    """Adjusted probabilities of the primary model (M5), ours beside the variant cohort's. The rows of
    i02_reconciliation are of the crude model, which has SQL."""
    runs = [w.run("ESCMAE", True), w.run("variant", True)]
    return rounded(C.probabilities(*[T.adjusted_probabilities(run, run.ladder()[4]) for run in runs]))


SIDES = {"o": ("in_primary", "in_sens"), "r": ("in_primary_var", "in_sens_var")}


def size_counts(primary: str, sens: str) -> dict[str, str]:
    return {"primaria_M1-5": primary, "sensibilidade_M6-8": sens, "singletons_primaria": f"{primary} and singleton",
            "singletons_sensib": f"{sens} and singleton", "mesprenat_subsample": f"{sens} and MESPRENAT between 1 and 9",
            "sem_ultimo_ano_primaria": f"{primary} and ANO < 2001", "sem_ultimo_ano_sensib": f"{sens} and ANO < 2001",
            "ultimo_ano_contribuicao": f"{primary} and ANO = 2001"}


def sizes_sql(side: str) -> str:
    return " union all ".join(f"select 'amostras' as secao, '{name}' as metrica, cast(count(*) as double) as v from cohort where {cond}"
                              for name, cond in size_counts(*SIDES[side]).items())


def excluded_sql(side: str) -> str:
    primary = SIDES[side][0]
    groups = {"Incluidos": primary, "Excluidos(so raca-valida)": f"ok_race and not {primary}", "Excluidos(cascata completa)": f"not {primary}"}
    values = {"n": "cast(count(*) as double)", "ptb_pct": "100 * avg(ptb)",
              "raca_indigena_pct": "coalesce(100.0 * count(case when raca = 'Indigena' then 1 end) / nullif(count(raca), 0), 0)",
              "raca_outra_missing_pct": "100.0 * count(case when RACACORMAE is null or RACACORMAE = 3 then 1 end) / nullif(count(*), 0)"}
    return " union all ".join(f"select 'excluidos' as secao, '{g} {name}' as metrica, {value} as v from cohort where {cond}"
                              for g, cond in groups.items() for name, value in values.items())


def models_sql(p: str, side: str) -> str:
    """The sections that come from fits named by the prefix p."""
    focal = f"from {p}_effects where grupo = 'Indigena'"
    later = "('M6_+Prenat', 'M7_+Paridade', 'M8_FULL')"
    return f"""
select 'or_modelo' as secao, modelo as metrica, exp(b) as v {focal} and family = 'binomial'
union all select 'desenho', modelo || ' n_params', cast(k as double) {focal} and modelo in {later}
union all select 'desenho', modelo || ' aic', round(aic, 2) {focal} and modelo in {later}
union all select 'or_pr', 'OR ' || split_part(modelo, '_', 1), exp(b) {focal} and modelo in ('M1_Crude', 'M5_PRIMARY', 'M8_FULL')
union all select 'or_pr', 'PR ' || split_part(modelo, '_', 1), exp(b) {focal} and family = 'poisson'
union all select 'probabilidades', grupo, v from ({standardised(p, "M5_PRIMARY")})
union all select 'anos', cast(ANO as varchar), cast(count(*) as double) from cohort where {SIDES[side][0]} group by ANO"""


RECONCILED_TASKS = SETTINGS.ladder() + SETTINGS.or_vs_rr()[1::2]


@query("i02_reconciliation_models", f"""
with recursive {newton("a", RECONCILED_TASKS, "cohort")}, {newton("v", RECONCILED_TASKS, "cohort", **VARIANT)},
o as ({sizes_sql("o")} union all {models_sql("a", "o")} union all {excluded_sql("o")}),
r as ({sizes_sql("r")} union all {models_sql("v", "r")} union all {excluded_sql("r")}),
parts as (select secao, metrica, o.v as nosso, r.v as referencia from o join r using (secao, metrica)
  union all select 'publicado', e.modelo, exp(e.b), p.publicado from v_effects e join {PUBLISHED_SQL} on curto = split_part(e.modelo, '_', 1)
    where e.grupo = 'Indigena' and e.family = 'binomial')
select secao, metrica, {compared("nosso", "referencia")} from parts""")
def _(w):
    """All sections of the reconciliation over all models: ours beside the variant cohort's, and the
    variant's focal ratios beside the published ones. Counts come from the cube."""
    runs = {"ours": w.run("ESCMAE", True), "theirs": w.run("variant", True)}
    fits = {p: run.fit_all(run.ladder()) for p, run in runs.items()}
    odds = {p: T.effect_table(w.spark, [(f, "model") for f in fits[p]]) for p in runs}
    rates = {p: T.effect_table(w.spark, [(f, "hc0") for f in run.fit_all(run.or_vs_rr()[1::2])])
             for p, run in runs.items()}
    audits = {p: C.audit_numbers(T.design_audit(w.spark, fits[p][5:])) for p in runs}
    measured = {p: odds[p].where(F.split("modelo", "_")[0].isin("M1", "M5", "M8")).unionByName(rates[p])
                .withColumn("modelo", F.split("modelo", "_")[0]) for p in runs}
    adjusted = [T.adjusted_probabilities(run, run.ladder()[4]) for run in runs.values()]
    published = C.published_ratios(odds["theirs"]).where("publicado is not null").select(
        "modelo", F.col("estimativa").alias("nosso"), F.col("publicado").alias("referencia"),
        (F.col("estimativa") - F.col("publicado")).alias("delta"))
    return rounded(union_all([
        C.section(C.sample_sizes(*[Q.sizes(w.cube, p, S.YEARS[1]) for p in runs]), "amostras", F.col("amostra")),
        C.section(C.ratios_by_model(*odds.values()), "or_modelo", F.col("modelo")),
        C.section(C.compare(*audits.values(), ["metrica"], "valor"), "desenho", F.col("metrica")),
        C.section(C.ratios_by_measure(*measured.values()), "or_pr", F.concat_ws(
            " ", F.when(F.col("medida") == "RR", "PR").otherwise(F.col("medida")), "modelo")),
        C.section(C.probabilities(*adjusted), "probabilidades", F.col("grupo")),
        C.section(C.year_counts(*[Q.year_counts(w.cube, p) for p in runs]), "anos", F.col("ano")),
        C.section(published, "publicado", F.col("modelo")),
        C.section(C.compare(*[C.exclusion_numbers(Q.included_vs_excluded(w.cube, p)) for p in runs],
                            ["metrica"], "valor"), "excluidos", F.col("metrica")),
    ]))


EXPECTED = (("amostras", "primaria_M1-5"), ("amostras", "PR_por_UF"), ("cascata", "0_CO_bruto"),
            ("tabela2", "M1_Crude"), ("tabela2", "M9"), ("heterogeneidade", "pr_estratificado"))


@query("i03_consolidated_numbers", f"""
with {CASCADE_SQL}, {crude_sql("a", "in_primary", "focus")},
fsteps as (select 0 as ordem, '0_CO_bruto' as passo, count(*) as n from focus
  union all select 1, '1_raca_valida(excl Amarela/null)', count(*) from focus where ok_race
  union all select 2, '2_SEMAGESTAC 22-44 nao-missing', count(*) from focus where ok_race and ok_weeks
  union all select 3, '3_ESCMAE presente', count(*) from focus where ok_race and ok_weeks and ok_edu
  union all select 4, '4_IDADEMAE 10-60', count(*) from focus where in_primary
  union all select 5, '5_ano/UF/municipio presente', count(*) from focus where in_primary
  union all select 6, '6_sensib(+cons,parid,estciv)', count(*) from focus where in_sens),
grid as ({EXPOSURE_GRID_SQL}),
p as (select raca, 100 * avg(ptb) as v from focus where in_primary group by 1),
u as (select UF, raca, 100 * avg(ptb) as v from focus where in_primary group by 1, 2),
m as (select raca, 100.0 * count(case when SEMAGESTAC is null or SEMAGESTAC not between 22 and 44 then 1 end) / count(*) as v
      from focus where ok_race group by 1),
rows as (
  select 'amostras' as secao, 'primaria_M1-5' as metrica, '' as chave, cast(count(case when in_primary then 1 end) as double) as valor,
    {br_sql("count(case when in_primary then 1 end)", 0)} as texto from focus
  union all select 'cascata', passo, cast(ordem as varchar), n, {br_sql("n", 0)} from fsteps
  union all select 'tabela2', 'M1_Crude', grupo, exp(b), {br_sql("exp(b)", 3)} || ' (' || {br_sql(f"exp(b - {Z} * se)", 3)} || '–' || {br_sql(f"exp(b + {Z} * se)", 3)} || ')' from a
  union all select 'prevalencia', 'ptb_pct', raca, v, {br_sql("v", 1)} from p
  union all select 'prevalencia', 'diferenca_pp', 'Indigena', (select v from p where raca = 'Indigena') - (select v from p where raca = 'Branca'),
    {br_sql("(select v from p where raca = 'Indigena') - (select v from p where raca = 'Branca')", 1)}
  union all select 'heterogeneidade', UF, raca, v, {br_sql("v", 2)} from u
  union all select 'missing', 'Idade gestacional', raca, v, {br_sql("v", 2)} from m
  union all select 'missing', 'media_uf', uf, avg(missing_pct), {br_sql("avg(missing_pct)", 2)} from grid group by uf
  union all select 'pendencias', 'PR_por_UF', '', null, 'FALTA: amostras PR_por_UF'
  union all select 'pendencias', 'M9', '', null, 'FALTA: tabela2 M9'
  union all select 'pendencias', 'pr_estratificado', '', null, 'FALTA: heterogeneidade pr_estratificado')
select secao, metrica, chave, round(valor, 6) as valor, texto, cast(null as double) as referencia, cast(null as double) as delta from rows""")
def _(w):
    odds, _rates = odds_and_rates(w, 1)
    return rounded(consolidated(w, odds))


#: Samples of the report's first section.
REPORTED_SAMPLES = ("primaria_M1-5", "sensibilidade_M6-8", "singletons_primaria", "singletons_sensib",
                    "mesprenat_subsample")


def exclusions(w):
    """Included against excluded rows, and the range of missing exposure with its state and year."""
    groups = Q.included_vs_excluded(w.focus_cube, "ours")
    edges = R.extremes(rounded(focus_grid(w)), "missing_pct")
    shares = (("ptb_pct", 2), (f"raca_{V.RACE_FOCAL.lower()}_pct", 1), ("raca_outra_missing_pct", 1))
    return [
        R.numbers("incluidos_excluidos", groups, F.lit("n"), F.col("grupo"), F.col("n"), count_text(F.col("n"))),
        *[R.numbers("incluidos_excluidos", groups, F.lit(name), F.col("grupo"), F.col(name),
                    decimal_text(F.col(name), digits)) for name, digits in shares],
        *[R.numbers("missing", edges, F.lit(f"raca_{name}"), F.concat_ws(" ", f"{at}_uf", f"{at}_ano"),
                    F.col(name), decimal_text(F.col(name), 3))
          for name, at in (("minimo", "min"), ("maximo", "max"))]]


def focus_grid(w):
    """Missing exposure by year and focus state, from the cube."""
    states = w.states.where(F.col("uf_code").isin(*S.FOCUS_CODES)).select("UF")
    return Q.exposure_grid(w.focus_cube, STUDY_YEARS, states).withColumnsRenamed({"ANO": "ano", "UF": "uf"})


def consolidated(w, odds, extra=(), whole=False):
    """The numbers that need no model beyond the given odds ratios, plus any extra sections. All counts
    come from the cube. The short form has one sample and one missing variable, as its SQL; the whole
    has those of the report, and the other team's sample sizes beside ours."""
    cube, blank = w.focus_cube, F.lit("")
    sizes = Q.sizes(cube, "ours", S.YEARS[1]).where(
        F.col("amostra").isin(*REPORTED_SAMPLES) if whole else "amostra = 'primaria_M1-5'")
    reference = None
    if whole:
        theirs = Q.sizes(cube, "theirs", S.YEARS[1]).withColumnRenamed("n", "theirs")
        sizes, reference = sizes.join(theirs, "amostra"), F.col("theirs")
    steps = excluded_per_step(Q.cascade(cube, w.rules["ESCMAE"]))
    groups = Q.prevalence(cube, "ours", "raca")
    states = Q.prevalence(cube, "ours", "UF", "raca")
    pct = F.col("ptb_pct")
    gap = groups.agg((F.max(F.when(F.col("raca") == V.RACE_FOCAL, pct))
                      - F.max(F.when(F.col("raca") == V.RACE_REFERENCE, pct))).alias("gap"))
    missing = Q.missing_by_group(cube)
    if not whole:
        missing = missing.where("variavel = 'Idade gestacional'")
    by_state = rounded(focus_grid(w)).groupBy("uf").agg(F.avg("missing_pct").alias("media"))
    estimate = F.concat(decimal_text(F.col("estimativa")), F.lit(" ("),
                        interval_text(F.col("ic_low"), F.col("ic_high")), F.lit(")"))
    sections = [
        R.numbers("amostras", sizes, F.col("amostra"), blank, F.col("n"), count_text(F.col("n")), reference),
        R.numbers("cascata", steps, F.col("passo"), F.col("ordem"), F.col("n"), count_text(F.col("n"))),
        R.numbers("tabela2", odds, F.col("modelo"), F.col("grupo"), F.col("estimativa"), estimate),
        R.numbers("prevalencia", groups, F.lit("ptb_pct"), F.col("raca"), pct, decimal_text(pct, 1)),
        R.numbers("prevalencia", gap, F.lit("diferenca_pp"), F.lit(V.RACE_FOCAL), F.col("gap"),
                  decimal_text(F.col("gap"), 1)),
        R.numbers("heterogeneidade", states, F.col("UF"), F.col("raca"), pct, decimal_text(pct, 2)),
        R.numbers("missing", missing, F.col("variavel"), F.col("grupo"), F.col("missing_pct"),
                  decimal_text(F.col("missing_pct"), 2)),
        R.numbers("missing", by_state, F.lit("media_uf"), F.col("uf"), F.col("media"),
                  decimal_text(F.col("media"), 2)),
        *(exclusions(w) if whole else ()),
        *extra]
    expected = w.spark.createDataFrame(list(EXPECTED), "secao string, metrica string")
    return R.consolidated(sections, expected)


NUMBER_TASKS = (SETTINGS.ladder() + SETTINGS.or_vs_rr()[1::2] + SETTINGS.interaction() + SETTINGS.stratified(STRATA)
                + SETTINGS.yearly() + SETTINGS.blocks() + SETTINGS.prenatal())
LADDER_NAMES = ", ".join(f"'{t.model.name}'" for t in SETTINGS.ladder())


def focal_numbers(section: str, tasks, p: str = "f") -> str:
    names = ", ".join(f"'{t.model.name}'" for t in tasks)
    return (f"select '{section}', modelo, grupo, exp(b), {br_sql('exp(b)', 3)} from {p}_effects "
            f"where grupo = 'Indigena' and modelo in ({names})")


def percent_numbers(section: str, metric: str, key: str, value: str, digits: int, source: str) -> str:
    return f"select '{section}', {metric}, {key}, {value}, {br_sql(value, digits)} from {source}"


def sample_numbers() -> str:
    ours, theirs = size_counts(*SIDES["o"]), size_counts(*SIDES["r"])
    return " union all ".join(
        f"select 'amostras' as secao, '{name}' as metrica, '' as chave, cast(count(case when {ours[name]} then 1 end) as double) as valor, "
        f"{br_sql(f'count(case when {ours[name]} then 1 end)', 0)} as texto, "
        f"cast(count(case when {theirs[name]} then 1 end) as double) as referencia from focus" for name in REPORTED_SAMPLES)


INCLUSION_SQL = " union all ".join(
    f"select '{g}' as grupo, count(*) as n, 100 * avg(ptb) as ptb_pct, "
    "coalesce(100.0 * count(case when raca = 'Indigena' then 1 end) / nullif(count(raca), 0), 0) as raca_indigena_pct, "
    "100.0 * count(case when RACACORMAE is null or RACACORMAE = 3 then 1 end) / nullif(count(*), 0) as raca_outra_missing_pct "
    f"from focus where {cond}" for g, cond in (("Incluidos", "in_primary"), ("Excluidos(so raca-valida)", "ok_race and not in_primary"),
                                               ("Excluidos(cascata completa)", "not in_primary")))

WHOLE_NUMBERS_SQL = f"""
with recursive {newton("f", NUMBER_TASKS, "focus", where=YEAR | BLOCK | STRATUM | KNOWN_MONTH)},
{newton("g", SETTINGS.ladder(), "focus", **OTHER_EDUCATION)},
fsteps as ({" union all ".join(f"select {i} as ordem, '{name}' as passo, count(*) as n from focus where {cond}" for i, (name, cond) in enumerate((
    ("0_CO_bruto", "true"), ("1_raca_valida(excl Amarela/null)", "ok_race"), ("2_SEMAGESTAC 22-44 nao-missing", "ok_race and ok_weeks"),
    ("3_ESCMAE presente", "ok_race and ok_weeks and ok_edu"), ("4_IDADEMAE 10-60", "in_primary"),
    ("5_ano/UF/municipio presente", "in_primary"), ("6_sensib(+cons,parid,estciv)", "in_sens"))))}),
grid as ({EXPOSURE_GRID_SQL}),
p as (select raca, 100 * avg(ptb) as v from focus where in_primary group by 1),
d as (select (select v from p where raca = 'Indigena') - (select v from p where raca = 'Branca') as v),
u as (select UF, raca, 100 * avg(ptb) as v from focus where in_primary group by 1, 2),
pool as (select * from focus where ok_race),
m as ({" union all ".join(f"select '{V.MISSING_LABELS[c]}' as variavel, raca, 100.0 * count(case when {cond} then 1 end) / count(*) as v from pool group by 2" for c, cond in MISSING_CONDITIONS.items())}),
gm as (select uf, avg(missing_pct) as v from grid group by 1),
lo as (select * from grid where missing_pct is not null order by missing_pct, ano, uf limit 1),
hi as (select * from grid where missing_pct is not null order by missing_pct desc, ano, uf limit 1),
inc as ({INCLUSION_SQL}),
adj as ({standardised("f", "M5_PRIMARY")}),
lr as (select 2 * (max(loglik) - min(loglik)) as chi2, max(k) - min(k) as df from f_models where modelo like '%_interacao'),
lrp as (select chi2, df, exp(-chi2 / 2) * list_sum([exp(i * ln(chi2 / 2) - lgamma(i + 1)) for i in range(0, df // 2)]) as pv from lr),
st as (select raca, 100.0 * count(case when MESPRENAT between 1 and 3 then 1 end) / count(case when MESPRENAT between 1 and 9 then 1 end) as v
  from focus where in_sens group by 1),
numbers as (
  select 'cascata' as secao, passo as metrica, cast(ordem as varchar) as chave, cast(n as double) as valor, {br_sql("n", 0)} as texto from fsteps
  union all select 'tabela2', modelo, grupo, exp(b), {br_sql("exp(b)", 3)} || ' (' || {br_sql(f"exp(b - {Z} * se)", 3)} || '–' || {br_sql(f"exp(b + {Z} * se)", 3)} || ')'
    from f_effects where modelo in ({LADDER_NAMES})
  union all select distinct 'tabela2', 'AIC ' || modelo, cast(k as varchar), round(aic, 10), {br_sql("aic", 1)} from f_models where modelo in ('M6_+Prenat', 'M7_+Paridade', 'M8_FULL')
  union all {percent_numbers("prevalencia", "'ptb_pct'", "raca", "v", 1, "p")}
  union all {percent_numbers("prevalencia", "'diferenca_pp'", "'Indigena'", "v", 1, "d")}
  union all {percent_numbers("heterogeneidade", "UF", "raca", "v", 2, "u")}
  union all {percent_numbers("missing", "variavel", "raca", "v", 2, "m")}
  union all {percent_numbers("missing", "'media_uf'", "uf", "v", 2, "gm")}
  union all {percent_numbers("missing", "'raca_minimo'", "uf || ' ' || ano", "missing_pct", 3, "lo")}
  union all {percent_numbers("missing", "'raca_maximo'", "uf || ' ' || ano", "missing_pct", 3, "hi")}
  union all {percent_numbers("incluidos_excluidos", "'n'", "grupo", "n", 0, "inc")}
  union all {percent_numbers("incluidos_excluidos", "'ptb_pct'", "grupo", "ptb_pct", 2, "inc")}
  union all {percent_numbers("incluidos_excluidos", "'raca_indigena_pct'", "grupo", "raca_indigena_pct", 1, "inc")}
  union all {percent_numbers("incluidos_excluidos", "'raca_outra_missing_pct'", "grupo", "raca_outra_missing_pct", 1, "inc")}
  union all select 'pr', modelo, grupo, exp(b), {br_sql("exp(b)", 3)} from f_effects where family = 'poisson'
  union all {percent_numbers("probabilidades", "'p_ajustada_pct'", "grupo", "v", 3, "adj")}
  union all select 'heterogeneidade', 'lrt_chi2', cast(df as varchar), chi2, {br_sql("pv", 4)} from lrp
  union all {focal_numbers("heterogeneidade", SETTINGS.stratified(STRATA))}
  union all {focal_numbers("temporal", SETTINGS.yearly() + SETTINGS.blocks())}
  union all {focal_numbers("prenatal", SETTINGS.prenatal())}
  union all {percent_numbers("prenatal", "'inicio_1trim_pct'", "raca", "v", 1, "st")}
  union all {focal_numbers("escmae2010", SETTINGS.ladder(), "g")}
  union all select 'pendencias', 'PR_por_UF', '', null, 'FALTA: amostras PR_por_UF'
  union all select 'pendencias', 'M9', '', null, 'FALTA: tabela2 M9'
  union all select 'pendencias', 'pr_estratificado', '', null, 'FALTA: heterogeneidade pr_estratificado'),
rows as ({sample_numbers()} union all select *, cast(null as double) from numbers)
select secao, metrica, chave, round(valor, 6) as valor, texto, round(referencia, 6) as referencia, round(valor - referencia, 6) as delta from rows"""


@query("i03_consolidated_numbers_models", WHOLE_NUMBERS_SQL)
def _(w):
    """The whole numbers: every model of the ladder, the model-based studies, all reported samples and
    missing variables, and the exclusions."""
    odds, rates = odds_and_rates(w)
    run = w.run()

    def effects(name, tasks):
        table = T.effect_table(w.spark, [(f, "model") for f in run.fit_all(tasks)])
        focal = C.focal_rows(table)
        return R.numbers(name, focal, F.col("modelo"), F.col("grupo"), F.col("estimativa"),
                         decimal_text(F.col("estimativa")))

    other = w.run("ESCMAE2010")
    other_odds = C.focal_rows(T.effect_table(
        w.spark, [(f, "model") for f in other.fit_all(other.ladder())]))
    audit = T.design_audit(w.spark, run.fit_all(run.ladder()[5:]))
    test = T.interaction_test(w.spark, *run.fit_all(run.interaction()))
    adjusted = T.adjusted_probabilities(run, run.ladder()[4])
    starts = Q.first_trimester(w.focus_cube, "ours")
    ratio, value = F.col("estimativa"), F.col("p_ajustada_pct")
    extra = [
        R.numbers("tabela2", audit, F.concat(F.lit("AIC "), F.col("modelo")), F.col("n_params"),
                  F.col("aic"), decimal_text(F.col("aic"), 1)),
        R.numbers("pr", rates, F.col("modelo"), F.col("grupo"), ratio, decimal_text(ratio)),
        R.numbers("probabilidades", adjusted, F.lit("p_ajustada_pct"), F.col("grupo"), value,
                  decimal_text(value)),
        R.numbers("heterogeneidade", test, F.lit("lrt_chi2"), F.col("gl"), F.col("lrt_chi2"),
                  decimal_text(F.col("p_valor"), 4)),
        effects("heterogeneidade", run.stratified(w.focus_states)),
        effects("temporal", run.yearly() + run.blocks()),
        effects("prenatal", run.prenatal()),
        R.numbers("prenatal", starts, F.lit("inicio_1trim_pct"), F.col("grupo"),
                  F.col("inicio_1trim_pct"), decimal_text(F.col("inicio_1trim_pct"), 1)),
        R.numbers("escmae2010", other_odds, F.col("modelo"), F.col("grupo"), ratio,
                  decimal_text(ratio)),
    ]
    return rounded(consolidated(w, odds, extra, whole=True))


@query("i04_forest_crude", f"""
with {crude_sql("a", "in_primary", "focus")}, {cluster_sql("c", "in_primary", "focus", "sum(n)")},
j as (select a.* exclude (se), c_se.se as se from a join c_se using (grupo))
select 'M1' as modelo, grupo, 'OR' as serie, round(exp(b), 6) as estimativa, round(exp(b - {Z} * se), 6) as ic_low, round(exp(b + {Z} * se), 6) as ic_high from j
union all select 'M1', grupo, 'PR', round(exp(lrr), 6), round(exp(lrr - {Z} * se_hc0), 6), round(exp(lrr + {Z} * se_hc0), 6) from j""")
def _(w):
    return forest(w, 2)


def forest(w, tasks=None):
    run = w.run()
    fits = run.fit_all(run.or_vs_rr()[:tasks])
    odds = T.effect_table(w.spark, [(f, "cluster") for f in fits if f.model.family == "binomial"])
    rates = T.effect_table(w.spark, [(f, "hc0") for f in fits if f.model.family == "poisson"])
    return rounded(R.forest(odds, rates))


@query("i04_forest", f"""with recursive {newton("f", SETTINGS.or_vs_rr(), "focus", towns=True)}, {WITH_CLUSTER},
e as (select *, case when family = 'binomial' then se_cluster else se_hc0 end as own from f_all)
select split_part(modelo, '_', 1) as modelo, grupo, case when family = 'binomial' then 'OR' else 'PR' end as serie,
  round(exp(b), 6) as estimativa, round(exp(b - {Z} * own), 6) as ic_low, round(exp(b + {Z} * own), 6) as ic_high from e""")
def _(w):
    return forest(w)


def crude_year_sql() -> str:
    return """
g as (select ANO, raca, nullif(cast(sum(ptb) as double), 0) as s, cast(count(*) as double) as n from focus where in_primary and raca in ('Branca', 'Indigena') group by 1, 2),
t as (select ANO, count(*) as n from focus where in_primary group by 1)"""


@query("i05_yearly_series_crude", f"""
with {crude_year_sql()}
select i.ANO as ano, round((i.s / (i.n - i.s)) / (b.s / (b.n - b.s)), 6) as estimativa,
  round(exp(ln((i.s / (i.n - i.s)) / (b.s / (b.n - b.s))) - {Z} * sqrt(1 / i.s + 1 / (i.n - i.s) + 1 / b.s + 1 / (b.n - b.s))), 6) as ic_low,
  round(exp(ln((i.s / (i.n - i.s)) / (b.s / (b.n - b.s))) + {Z} * sqrt(1 / i.s + 1 / (i.n - i.s) + 1 / b.s + 1 / (b.n - b.s))), 6) as ic_high, t.n
from g i join g b on b.ANO = i.ANO and b.raca = 'Branca' join t on t.ANO = i.ANO where i.raca = 'Indigena'""")
def _(w):
    """The yearly series with the crude model, which has a closed form."""
    run = w.run()
    tasks = [T.Task(T.Model(t.model.name, T.M1), t.sample, t.where) for t in run.yearly()]
    fits = run.fit_all(tasks)
    return rounded(R.yearly_series(T.effect_table(w.spark, [(f, "model") for f in fits])))


@query("i05_yearly_series", f"""with recursive {newton("f", SETTINGS.yearly(), "focus", where=YEAR)}
select cast(split_part(modelo, '_', 2) as int) as ano, round(exp(b), 6) as estimativa, round(exp(b - {Z} * se), 6) as ic_low,
  round(exp(b + {Z} * se), 6) as ic_high, nobs as n from f_effects where grupo = 'Indigena'""")
def _(w):
    run = w.run()
    fits = run.fit_all(run.yearly())
    return rounded(R.yearly_series(T.effect_table(w.spark, [(f, "model") for f in fits])))


@query("i06_state_dumbbell", TOP_STATES_SQL)
def _(w):
    return rounded(R.largest_states(D.prevalence(w.cohort, "UF", "regiao", "raca")))
