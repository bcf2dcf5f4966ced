"""Models fitted in SQL, to check the fits made by Spark.

The SQL shares nothing with the other side: it groups the cohort's rows by a model's columns, numbers
the dummies, and takes Newton steps in a recursive query. A step sums score and information over the
pairs of nonzero columns of each cell and solves them by elimination, one list per row. All models of a
query are fitted at the same time.
"""

from vitalcells.operators.glm import EXPOSURE
from vitalcells.plans.studies import Run, Task
from vitalcells.sources import star_births as S

# The task lists need only the settings, so the SQL is built from the same model names.
SETTINGS = Run(None, None, S.YEARS, S.PERIODS)
SQL_COLUMN = {"uf_cat": "UF", "esc_lin": "ESCMAE", "cons_lin": "CONSULTAS"}
REFERENCE = "Branca"
STEPS = 11
# Samples and columns of the other two arms.
VARIANT = {"primary": "in_primary_var", "sens": "in_sens_var",
           "columns": {"esc_cat": "esc2010_code", "parid_cat": "parid_known"}}
OTHER_EDUCATION = {"primary": "in_primary_2010", "sens": "in_sens_2010", "columns": {"esc_cat": "esc2010_cat"}}

# Rows are lists of right sides, then coefficients; `left` is the number of right sides.
_ELIMINATE = """list_reduce(
  list_prepend({{'p': 0, 'm': {m}}}, list_transform(range(1, {k} + 1), lambda q: {{'p': q::int, 'm': null::double[][]}})),
  lambda a, y: {{'p': y.p, 'm': list_transform(a.m, lambda r, i: case when i = y.p
    then list_transform(r, lambda v: v / r[y.p + {left}])
    else list_transform(list_zip(r, a.m[y.p]), lambda z: z[1] - z[2] * (r[y.p + {left}] / a.m[y.p][y.p + {left}])) end)}}).m"""


def _mu(eta: str) -> str:
    return f"case when family = 'binomial' then 1 / (1 + exp(-({eta}))) else exp({eta}) end"


def _eta(b: str = "b") -> str:
    return f"list_sum(list_transform(x, lambda e: e.v * {b}[e.i]))"


def newton(p: str, tasks: list[Task], source: str, primary: str = "in_primary", sens: str = "in_sens",
           columns: dict | None = None, where: dict | None = None, towns: bool = False) -> str:
    """CTEs named with the prefix `p`: {p}_effects (modelo, grupo, family, b, se, se_hc0, aic, nobs, k),
    {p}_models (modelo, family, k, loglik, aic, nobs), and {p}_cluster (modelo, grupo, se) with `towns`."""
    columns = {**SQL_COLUMN, **(columns or {})}

    def col(f):
        return columns.get(f, f)

    cells, towned, empty, products = [], [], [], []
    for task in tasks:
        m = task.model
        assert m.factors[0] == EXPOSURE
        condition = " and ".join([sens if task.sample == "sens" else primary, (where or {}).get(m.name, "true"),
                                  *[f"{col(f)} is not null" for f in m.keys]])
        levels = [f"cast({col(f)} as varchar)" for f in m.factors]
        levels += [f"{col(f)} || ':' || {col(g)}" for f, g in m.interactions]
        products += [f"('{m.name}', {len(m.factors) + i + 1}, {m.factors.index(g) + 1})"
                     for i, (f, g) in enumerate(m.interactions)]
        head = (f"select '{m.name}' as modelo, '{m.family}' as family, [{', '.join(levels)}] as lv, "
                f"cast([{', '.join(col(x) for x in m.linear)}] as double[]) as num")
        body = f"cast(sum(ptb) as double) as s, cast(count(*) as double) as n from {source} where {condition} group by all"
        cells.append(f"{head}, {body}")
        towned.append(f"{head}, CODMUNRES, {body}")
        empty.append(f"select '{m.name}', '{m.family}', cast([] as varchar[]), cast([] as double[]), 0, 0")
    product = (f"and not exists (select 1 from (values {', '.join(products)}) as q(modelo, f, g) "
               f"join {p}_ref r2 on r2.modelo = q.modelo and r2.f = q.g where q.modelo = d.modelo and q.f = d.f "
               f"and (split_part(d.level, ':', 1) = '{REFERENCE}' or split_part(d.level, ':', 2) = r2.ref))"
               if products else "")
    sql = f"""
{p}_cells as materialized (select row_number() over () as cell, * from ({" union all ".join(cells + empty)})),
{p}_long as materialized (select modelo, cell, unnest(lv) as level, generate_subscripts(lv, 1) as f from {p}_cells),
{p}_ref as (select modelo, f, case when f = 1 then '{REFERENCE}' else min(level) end as ref from {p}_long group by 1, 2),
{p}_dummies as materialized (select d.modelo, d.f, d.level, 1 + row_number() over (partition by d.modelo order by d.f, d.level) as i
  from (select distinct modelo, f, level from {p}_long) d join {p}_ref using (modelo, f) where d.level <> ref {product}),
{p}_k as materialized (select c.modelo, 1 + coalesce(max(d.n), 0) as base, 1 + coalesce(max(d.n), 0) + max(len(c.num)) as k
  from {p}_cells c left join (select modelo, count(*) as n from {p}_dummies group by 1) d using (modelo) group by 1),
{p}_entries as materialized (
  select modelo, cell, 1 as i, cast(1 as double) as v from {p}_cells
  union all select l.modelo, l.cell, d.i, 1 from {p}_long l join {p}_dummies d using (modelo, f, level)
  union all select c.modelo, c.cell, k.base + generate_subscripts(num, 1), unnest(num) from {p}_cells c join {p}_k k using (modelo)),
{p}_rows as materialized (select c.cell, c.modelo, c.family, c.s, c.n, e.x from {p}_cells c
  join (select cell, list({{'i': i, 'v': v}}) as x from {p}_entries group by 1) e using (cell)),
{p}_pairs as materialized (
  select a.cell, a.i, b.i as j, a.v * b.v as v from {p}_entries a join {p}_entries b using (cell)
  union all select cell, i, 0, v from {p}_entries
  union all select c.cell, a.i, b.j, 0 from {p}_cells c join {p}_k k using (modelo), lateral (select unnest(range(1, k.k + 1)) as i) a,
    lateral (select unnest(range(0, k.k + 1)) as j) b where c.n = 0),
{p}_newton as (
  select 0 as t, modelo, list_transform(range(k), lambda q: cast(0 as double)) as b, k from {p}_k
  union all
  select t + 1, modelo, list_transform(list_zip(b, list_transform({_ELIMINATE.format(m="m", k="k", left=1)}, lambda r: r[1])), lambda z: z[1] + z[2]), k
  from (
    select t, modelo, any_value(b) as b, any_value(k) as k,
      list_transform(range(any_value(k)), lambda q: list(val order by i, j)[q * (any_value(k) + 1) + 1 : (q + 1) * (any_value(k) + 1)]) as m
    from (
      select t, modelo, any_value(b) as b, any_value(k) as k, q.i, q.j, sum(case when q.j = 0 then score else w end * q.v) as val
      from (
        select t, modelo, b, k, cell, s - n * mu as score, n * case when family = 'binomial' then mu * (1 - mu) else mu end as w
        from (select w.t, r.modelo, w.b, w.k, r.cell, r.s, r.n, r.family, {_mu(_eta("w.b"))} as mu
              from {p}_newton w join {p}_rows r using (modelo) where w.t < {STEPS}))
      join {p}_pairs q using (cell) group by t, modelo, q.i, q.j)
    group by t, modelo)),
{p}_fitted as materialized (select r.*, {_mu(_eta("w.b"))} as mu from {p}_rows r join {p}_newton w using (modelo) where w.t = {STEPS}),
{p}_inverse as materialized (
  select modelo, list_transform({_ELIMINATE.format(m="m", k="k", left="k")}, lambda r: r[1:k]) as inv from (
    select modelo, k, list_transform(range(k), lambda q: list_concat(
      list_transform(range(k), lambda c: case when c = q then cast(1 as double) else 0 end), flat[q * k + 1 : (q + 1) * k])) as m
    from (select modelo, any_value(k) as k, list(val order by i, j) as flat from (
      select f.modelo, any_value(k.k) as k, q.i, q.j, sum(n * case when family = 'binomial' then mu * (1 - mu) else mu end * q.v) as val
      from {p}_fitted f join {p}_k k using (modelo) join {p}_pairs q using (cell) where q.j > 0 group by f.modelo, q.i, q.j) group by modelo))),
{p}_models as materialized (select modelo, any_value(family) as family, any_value(k) as k, sum(ll) as loglik,
    -2 * sum(ll) + 2 * any_value(k) as aic, cast(sum(n) as bigint) as nobs
  from (select modelo, family, k, n, case when n = 0 then 0 when family = 'binomial'
      then (case when s > 0 then s * ln(mu) else 0 end) + (case when n > s then (n - s) * ln(1 - mu) else 0 end)
      else (case when s > 0 then s * ln(mu) else 0 end) - n * mu end as ll from {p}_fitted join {p}_k using (modelo)) group by modelo),
{p}_influence as materialized (select f.cell, f.modelo, d.level as grupo, s, n, mu, list_sum(list_transform(x, lambda e: e.v * v.inv[d.i][e.i])) as h
  from {p}_fitted f join {p}_inverse v using (modelo) join {p}_dummies d on d.modelo = f.modelo and d.f = 1 where n > 0),
{p}_hc0 as (select modelo, grupo, sqrt(sum((s * (1 - mu) * (1 - mu) + (n - s) * mu * mu) * h * h)) as se_hc0 from {p}_influence group by 1, 2),
{p}_effects as materialized (select d.modelo, d.level as grupo, m.family, w.b[d.i] as b, sqrt(v.inv[d.i][d.i]) as se, h.se_hc0, m.aic, m.nobs, m.k
  from {p}_dummies d join {p}_newton w on w.modelo = d.modelo and w.t = {STEPS} join {p}_inverse v on v.modelo = d.modelo
  join {p}_models m on m.modelo = d.modelo join {p}_hc0 h on h.modelo = d.modelo and h.grupo = d.level where d.f = 1)"""
    if towns:
        sql += f""",
{p}_towns as (select t.modelo, i.grupo, t.CODMUNRES, sum((t.s - t.n * i.mu) * i.h) as u from ({" union all ".join(towned)}) t
  join {p}_cells c on c.modelo = t.modelo and c.lv = t.lv and c.num = t.num join {p}_influence i on i.cell = c.cell group by 1, 2, 3),
{p}_cluster as (select t.modelo, t.grupo, sqrt(sum(u * u) * count(*) / (count(*) - 1.0) * (any_value(m.nobs) - 1.0) / (any_value(m.nobs) - any_value(m.k))) as se
  from {p}_towns t join {p}_models m using (modelo) group by 1, 2)"""
    return sql


def compared(ours: str, theirs: str) -> str:
    """Both values and their difference, rounded."""
    return (f"round({ours}, 6) as nosso, round({theirs}, 6) as referencia, "
            f"round({ours} - {theirs}, 6) as delta")


def interval(b: str, se: str, name: str, rounded: bool = False) -> str:
    """Both ends of a ratio's 95 % interval."""
    ends = [(f"exp({b} {sign} 1.959963984540054 * ({se}))", f"{name}_{end}") for sign, end in (("-", "low"), ("+", "high"))]
    return ", ".join(f"{'round(' if rounded else ''}{sql}{', 6)' if rounded else ''} as {column}" for sql, column in ends)


def standardised(p: str, model: str) -> str:
    """Mean prediction of one model of {p} with the exposure set to each group: (grupo, v in percent)."""
    return f"""
select g.grupo, 100 * sum(n / (1 + exp(-(eta - coalesce(own.b, 0) + coalesce(g.b, 0))))) / sum(n) as v
from (select r.cell, r.n, c.lv[1] as raca, {_eta("w.b")} as eta from {p}_rows r join {p}_cells c using (cell)
      join {p}_newton w on w.modelo = r.modelo and w.t = {STEPS} where r.modelo = '{model}' and r.n > 0) z
left join (select grupo, b from {p}_effects where modelo = '{model}') own on own.grupo = z.raca
cross join (select grupo, b from {p}_effects where modelo = '{model}' union all select '{REFERENCE}', 0) g group by 1"""
