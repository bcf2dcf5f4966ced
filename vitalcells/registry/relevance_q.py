"""Relevance tiering over the whole text table.

The texts are invented prose, so beside the scan's own phrases some are searched that such texts hold;
eligibility and deadline come from columns of the table.
"""

from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.plans import relevance as R
from vitalcells.registry.base import Workspace, query
from vitalcells.storage import exists

PHRASES = (*V.KEYWORDS, "license", "token", "rights reserved", "creative commons", "public license", "copyright")
CENTRAL_HITS = 2

PHRASE_LIST = ", ".join(
    f"case when regexp_matches(low, '{R.whole_words(p)}') then '{p}' end" for p in PHRASES)
SCORED_SQL = f"""
with scored as (
  select doc_id, source, lang, n_chars, list_filter([{PHRASE_LIST}], lambda x: x is not null) as achados,
    lang = 'en' as elegivel, n_chars < 5000 as prazo
  from (select *, lower(text) as low from documents)),
tiers as (select *, len(achados) as n_achados, case when len(achados) >= 2 and elegivel and prazo then 'Alta'
    when len(achados) >= 1 and (elegivel or prazo) then 'Média' else 'Baixa' end as aderencia from scored)"""


def scored(w: Workspace):
    rows = R.with_hits(w.table("documents"), "text", PHRASES)
    return rows.select(
        "doc_id", "source", "lang", "n_chars", "achados", "n_achados",
        (F.col("lang") == "en").alias("elegivel"), (F.col("n_chars") < 5000).alias("prazo"))


def tiered(w):
    return scored(w).withColumn("aderencia", R.tier(
        F.col("n_achados"), CENTRAL_HITS, F.col("elegivel"), F.col("prazo")))


@query("r01_phrase_hits", SCORED_SQL + """
select doc_id, array_to_string(achados, '; ') as achados, cast(n_achados as int) as n_achados from tiers""")
def _(w):
    return scored(w).select("doc_id", F.array_join("achados", "; ").alias("achados"), "n_achados")


@query("r02_tier", SCORED_SQL + """
select lang, aderencia, count(*) as n, cast(sum(n_achados) as bigint) as achados from tiers group by 1, 2""")
def _(w):
    return tiered(w).groupBy("lang", "aderencia").agg(
        F.count("*").alias("n"), F.sum("n_achados").alias("achados"))


@query("r03_ordered_report", SCORED_SQL + """
select doc_id as titulo, source as fonte, aderencia, prazo, n_chars as valor, elegivel as elegibilidade from tiers""")
def _(w):
    rows = tiered(w).select(
        F.col("doc_id").alias("titulo"), F.col("source").alias("fonte"), "aderencia", "prazo",
        F.col("n_chars").alias("valor"), F.col("elegivel").alias("elegibilidade"))
    return R.report(rows, ["fonte", "titulo"])


@query("r04_snapshot", SCORED_SQL + """
select cast(d as varchar) as data, aderencia, count(*) as n from tiers, (select unnest(['2026-07-06', '2026-07-13']) as d) group by 1, 2""")
def _(w):
    folder = f"{w.root}/snapshots"
    for date in ("2026-07-06", "2026-07-13"):
        if not exists(w.spark, f"{folder}/data={date}"):
            R.write_snapshot(tiered(w).select("doc_id", "aderencia", "n_achados"), folder, date)
    return (w.spark.read.parquet(folder)
            .groupBy(F.col("data").cast("string").alias("data"), "aderencia").agg(F.count("*").alias("n")))
