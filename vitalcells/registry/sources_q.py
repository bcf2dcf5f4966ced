"""Yearly files, report files and schema reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.functions.derive import r6
from vitalcells.operators import profile as P
from vitalcells.operators.cohort import cascade
from vitalcells.operators.describe import prevalence
from vitalcells.registry.base import (EXPECTED_FILE_YEARS, GESTACAO_FROM, IDS, NUMERIC_FILE_YEAR,
                                      Workspace, query)
from vitalcells.sources import reports as R
from vitalcells.sources import star_births as S
from vitalcells.sources import yearly as Y
from vitalcells.storage import is_written

PROVENANCE = "vitalcells | seed 42 | anos 1995-2001"


BIRTH_COLUMNS = ("CODMUNRES", "UF", "regiao", *V.NUMERIC_COLUMNS, "ANO", "ANO_ARQUIVO")


@query("a01_load_region", f"""
select l_orderkey, l_linenumber, {", ".join(BIRTH_COLUMNS)} from births
where uf_code in ('15', '20', '25', '30', '35')""")
def _(w: Workspace):
    return Y.load_years(w.files, w.states, list(S.FOCUS_CODES), S.YEARS, IDS).select(
        *IDS, *BIRTH_COLUMNS)


@query("a02_column_subset", """
select ANO_ARQUIVO as ano, count(*) as n, count(ESCMAE2010) as n_esc2010 from births_raw group by 1""")
def _(w):
    return w.files.united(lambda table: Y.columns_of(table, ["ESCMAE2010", "ESCMAE2010", Y.FILE_YEAR])
                          .groupBy(F.col(Y.FILE_YEAR).alias("ano"))
                          .agg(F.count("*").alias("n"), F.count("ESCMAE2010").alias("n_esc2010")))


@query("a03_lazy_scan", """
select ANO_ARQUIVO as ano, count(nullif(trim(SEMAGESTAC), '')) as n_semanas,
  count(case when ANO_ARQUIVO >= 1998 then nullif(trim(SEMAGESTAC), '') end) as n_gestacao
from births_raw group by 1""")
def _(w):
    return Y.scan_years(w.files, ("SEMAGESTAC", "GESTACAO")).groupBy("ano").agg(
        F.count("SEMAGESTAC").alias("n_semanas"), F.count("GESTACAO").alias("n_gestacao"))


@query("a04_union_years", """
select l_orderkey, l_linenumber, ANO_ARQUIVO as ano_arquivo from births""")
def _(w):
    codes = [str(c) for c in range(11, 36)]
    return Y.load_years(w.files, w.states, codes, S.YEARS, IDS).select(
        *IDS, F.col("ANO_ARQUIVO").alias("ano_arquivo"))


YEAR_ROWS = """
y as (select ANO_ARQUIVO as ano, count(*) as n_linhas,
        case when ANO_ARQUIVO >= 1998 then 15 else 14 end as n_colunas from births_raw group by 1)"""


@query("a05_inventory", f"""
with {YEAR_ROWS}
select cast(e.ano as int) as ano, y.ano is not null as existe, y.n_linhas, cast(y.n_colunas as bigint) as n_colunas,
  case when y.ano is null then 'ausente' else 'presente' end as escopo
from range(1994, 2003) e(ano) left join y on y.ano = e.ano""")
def _(w):
    return Y.inventory(w.spark, w.yearly_paths, w.files).drop("tamanho_mb")


@query("a05_inventory_sizes")
def _(w):
    return Y.inventory(w.spark, w.yearly_paths, w.files).select("ano", "tamanho_mb")


# The file of one year stores numbers, so text that is no number is null there.
FILLED = " union all ".join([
    *[f"select ANO_ARQUIVO as ano, '{c}' as coluna, count(*) as preenchidos from births_raw group by 1" for c in IDS],
    *[f"select ANO_ARQUIVO, '{c}', count(case when ANO_ARQUIVO <> {NUMERIC_FILE_YEAR} "
      f"or try_cast(nullif(trim({c}), '') as double) is not null then {c} end) from births_raw group by 1"
      for c in S.RECORD_COLUMNS if c != "ANO_ARQUIVO"],
    "select ANO_ARQUIVO, 'GESTACAO', count(nullif(SEMAGESTAC, '')) from births_raw group by 1"])
SCHEMA_ROWS = f"""
cols as (select unnest(['l_orderkey','l_linenumber','CODMUNRES','RACACORMAE','SEMAGESTAC','ESCMAE','ESCMAE2010',
   'IDADEMAE','DTNASC','CONSULTAS','QTDFILVIVO','ESTCIVMAE','GRAVIDEZ','MESPRENAT','GESTACAO']) as coluna,
   unnest(range(15)) as posicao),
sch as (select y.ano, c.coluna, c.posicao,
   case when c.coluna = 'l_orderkey' then 'bigint' when c.coluna = 'l_linenumber' then 'int'
        when y.ano = 2000 then 'double' else 'string' end as tipo
  from (select distinct ANO_ARQUIVO as ano from births_raw) y
  join cols c on c.coluna <> 'GESTACAO' or y.ano >= 1998),
filled as ({FILLED}),
full_sch as (select sch.*, f.preenchidos from sch join filled f using (ano, coluna))"""


@query("a06_columns_not_in_all_years", f"""
with {SCHEMA_ROWS}
select coluna, count(*) as n_anos, string_agg(cast(ano as varchar), ',' order by ano) as anos,
  cast(sum(preenchidos) as bigint) as preenchidos
from full_sch group by 1 having count(*) < (select count(distinct ano) from sch)""")
def _(w):
    return Y.columns_not_everywhere(w.filled)


@query("a07_type_drift", f"""
with {SCHEMA_ROWS}
select coluna, {", ".join(f"max(case when ano = {y} then tipo end) as ano_{y}" for y in range(1995, 2002))},
  cast(sum(preenchidos) as bigint) as preenchidos
from full_sch group by 1 having count(distinct tipo) > 1 and count(*) = (select count(distinct ano) from sch)""")
def _(w):
    return Y.type_drift(w.filled, list(w.files))


@query("a08_column_list", f"""
with {SCHEMA_ROWS}
select ano, count(*) as n_colunas, string_agg(coluna, ',' order by posicao) as colunas,
  string_agg(cast(preenchidos as varchar), ',' order by posicao) as preenchidos from full_sch group by 1""")
def _(w):
    return Y.column_list(w.filled)


@query("a09_variable_dictionary", f"""
with {SCHEMA_ROWS},
roles as (select unnest([{", ".join(f"'{r}'" for r, _ in V.ROLES)}, 'Perfil', 'Perfil']) as papel,
  unnest([{", ".join(f"'{c}'" for _, c in V.ROLES)}, 'GESTACAO', 'CONSPRENAT']) as alvo)
select papel, alvo, count(ano) as n_anos,
  case when count(ano) = 0 then 'ausente' when count(ano) = (select count(distinct ano) from sch) then 'todos'
       else 'parcial' end as presenca, cast(coalesce(sum(preenchidos), 0) as bigint) as preenchidos
from roles left join full_sch on coluna = alvo group by 1, 2""")
def _(w):
    return Y.variable_dictionary(w.spark, w.filled)


PREVALENCE_SQL = """
select UF as uf, raca, count(*) as n, cast(sum(ptb) as bigint) as ptb_n, round(100 * avg(ptb), 6) as ptb_pct
from cohort where in_primary group by 1, 2"""
PREVALENCE_SCHEMA = "uf string, raca string, n bigint, ptb_n bigint, ptb_pct double"


def written_prevalence(w) -> str:
    """Write the state prevalence report as CSV and give its path."""
    path = f"{w.root}/reports/prevalence"
    if not is_written(w.spark, path):
        report = prevalence(w.cohort, "UF", "raca").select(
            F.col("UF").alias("uf"), "raca", "n", "ptb_n", r6(F.col("ptb_pct")).alias("ptb_pct"))
        R.write_csv(report, path, PROVENANCE)
    return path


@query("a10_csv_sink", f"""
select '# {PROVENANCE}' as provenance, (select count(*) from (select distinct UF, raca from cohort where in_primary)) as n_linhas""")
def _(w):
    path = written_prevalence(w)
    lines = R.read_provenance(w.spark, path)
    return lines.withColumn("n_linhas", F.lit(R.read_csv(w.spark, path, PREVALENCE_SCHEMA).count()).cast("bigint"))


@query("a11_csv_source", PREVALENCE_SQL)
def _(w):
    return R.read_csv(w.spark, written_prevalence(w), PREVALENCE_SCHEMA)


@query("a12_cohort_cache", """
select ANO as ano, count(*) as n, cast(sum(ptb) as bigint) as ptb_n,
  count(case when in_sens then 1 end) as n_sens
from cohort where in_primary group by 1""")
def _(w):
    """The primary sample as a lasting table by region, reused by later processes."""
    cached = w.store.table("primary_sample", lambda: w.cohort.where("in_primary"), ("regiao",))
    return cached.groupBy(F.col("ANO").alias("ano")).agg(
        F.count("*").alias("n"), F.sum("ptb").alias("ptb_n"),
        F.count_if("in_sens").alias("n_sens"))


MISSINGNESS_SQL = f"""
with u as (
  select ANO_ARQUIVO as ano, variavel, nullif(trim(valor), '') as valor from (
    select ANO_ARQUIVO, {", ".join(c for c in V.PROFILED if c not in ("GESTACAO", "CONSPRENAT", "IDADEMAE"))},
      case when ANO_ARQUIVO <> {NUMERIC_FILE_YEAR} or IDADEMAE <> 'x' then IDADEMAE end as IDADEMAE,
      case when ANO_ARQUIVO >= {GESTACAO_FROM} then coalesce(cast(try_cast(nullif(SEMAGESTAC, '') as int) % 6 + 1 as varchar), '') end as GESTACAO
    from births_raw) t
  unpivot include nulls (valor for variavel in ({", ".join(c for c in V.PROFILED if c != "CONSPRENAT")}))),
ign as (select unnest([{", ".join(f"'{c}'" for c in V.UNKNOWN_CODE)}]) as variavel,
               unnest([{", ".join(f"'{c}'" for c in V.UNKNOWN_CODE.values())}]) as cod_ign),
g as (
  select ano, u.variavel, any_value(i.cod_ign) as cod_ign, count(*) as n, count(*) - count(valor) as n_null,
    case when any_value(i.cod_ign) is not null then count(case when valor = i.cod_ign then 1 end) end as n_ign
  from u left join ign i on i.variavel = u.variavel
  where not (u.variavel = 'GESTACAO' and ano < {GESTACAO_FROM}) group by 1, 2),
yr as (select ANO_ARQUIVO as ano, count(*) as n from births_raw group by 1)
select ano, variavel, n, n_null, round(100.0 * n_null / n, 6) as pct_null, cod_ign, n_ign,
  round(100.0 * n_ign / n, 6) as pct_ign, 'ok' as status from g
union all select ano, 'CONSPRENAT', n, null, null, null, null, null, 'AUSENTE' from yr
union all select ano, 'GESTACAO', n, null, null, null, null, null, 'AUSENTE' from yr where ano < {GESTACAO_FROM}"""
MISSINGNESS_SCHEMA = ("ano int, variavel string, n bigint, n_null bigint, pct_null double, cod_ign string, "
                      "n_ign bigint, pct_ign double, status string")


def missingness_table(w) -> DataFrame:
    return P.missingness(w.profiled, w.schemas.select("ano", F.col("coluna").alias("variavel"))).withColumns(
        {c: r6(F.col(c)) for c in ("pct_null", "pct_ign")})


@query("a13_profile_csv", MISSINGNESS_SQL)
def _(w):
    path = f"{w.root}/reports/missingness"
    if not is_written(w.spark, path):
        R.write_csv(missingness_table(w), path, PROVENANCE)
    return R.read_csv(w.spark, path, MISSINGNESS_SCHEMA)


@query("a14_gap_list", """
select 'FALTA: ' || cast(e.ano as varchar) as pendencia from range(1994, 2003) e(ano)
where e.ano not in (select ANO_ARQUIVO from births_raw)""")
def _(w):
    expected = w.spark.createDataFrame([(y,) for y in EXPECTED_FILE_YEARS], "ano int")
    found = P.rows_per_year(w.profiled)
    return expected.join(found, "ano", "left_anti").select(
        F.concat(F.lit("FALTA: "), F.col("ano").cast("string")).alias("pendencia"))


CASCADE_SQL = """
steps as (
  select 0 as ordem, '0_CO_bruto' as passo, count(*) as n from cohort
  union all select 1, '1_raca_valida(excl Amarela/null)', count(*) from cohort where ok_race
  union all select 2, '2_SEMAGESTAC 22-44 nao-missing', count(*) from cohort where ok_race and ok_weeks
  union all select 3, '3_ESCMAE presente', count(*) from cohort where ok_race and ok_weeks and ok_edu
  union all select 4, '4_IDADEMAE 10-60', count(*) from cohort where in_primary
  union all select 5, '5_ano/UF/municipio presente', count(*) from cohort where in_primary
  union all select 6, '6_sensib(+cons,parid,estciv)', count(*) from cohort where in_sens)"""


@query("a15_cascade_from_log", f"with {CASCADE_SQL} select passo, n from steps where ordem < 6")
def _(w):
    folder = f"{w.root}/logs"
    for stamp, rules in (("20260101", w.rules["variant"]), ("20260627", w.rules["ESCMAE"])):
        path = f"{folder}/build_{stamp}"
        if not is_written(w.spark, path):
            lines = cascade(w.cohort, rules).select(F.concat(
                F.lit("[info]     cascata "), "passo", F.lit(": "), F.format_number("n", 0)).alias("value"))
            lines.write.mode("overwrite").text(path)
    lines = R.read_lines(w.spark, folder).withColumn("file", F.regexp_extract("file", r"build_(\d+)", 1))
    return R.cascade_from_log(R.newest(lines)).where(~F.col("passo").startswith("6"))


@query("a16_markdown_lookup", """
select 'sem_gravidez_multipla' as chave, cast(count(case when in_primary and singleton then 1 end) as varchar) as n_esc,
  cast(count(case when in_primary_var and singleton then 1 end) as varchar) as n_variante from cohort
union all
select 'primaria', cast(count(case when in_primary then 1 end) as varchar),
  cast(count(case when in_primary_var then 1 end) as varchar) from cohort""")
def _(w):
    path, names = f"{w.root}/reports/markdown", ["chave", "n_esc", "n_variante"]
    if not is_written(w.spark, path):
        def count(extra):
            return [F.count_if(F.col(flag) & extra).cast("string") for flag in ("in_primary", "in_primary_var")]

        rows = {"primaria": count(F.lit(True)), "sem_gravidez_multipla": count(F.col("singleton"))}
        header = [F.lit("| chave | n_esc | n_variante |"), F.lit("|---|--:|--:|")]
        table = w.cohort.agg(F.array(
            *header, *[R.markdown_row(F.lit(k), *cells) for k, cells in rows.items()]).alias("lines"))
        table.select(F.explode("lines").alias("value")).write.mode("overwrite").text(path)
    return R.markdown_cells(R.read_lines(w.spark, path), names)
