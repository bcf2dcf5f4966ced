"""Yearly files and report files."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vitalcells import fixed_values as V
from vitalcells.operators import profile as P
from vitalcells.plans import relevance as R
from vitalcells.sources import reports as S
from vitalcells.sources import yearly as Y
from vitalcells.storage import Store, shared_folder, small, stored

TEXT = dict(CODMUNRES=" 520870", RACACORMAE="1", SEMAGESTAC="36", ESCMAE="4", ESCMAE2010="",
            IDADEMAE="x", DTNASC="1012022", CONSULTAS="9", QTDFILVIVO="99", ESTCIVMAE=" 2 ",
            GRAVIDEZ="1", MESPRENAT="2")
NUMBERS = dict(CODMUNRES=510340.0, RACACORMAE=5.0, SEMAGESTAC=40.0, ESCMAE=2.0, ESCMAE2010=1.0,
               IDADEMAE=30.0, DTNASC=12012023.0, CONSULTAS=4.0, QTDFILVIVO=None, ESTCIVMAE=1.0,
               GRAVIDEZ=1.0, MESPRENAT=99.0)


@pytest.fixture
def files(spark, tmp_path):
    schema = {2022: "string", 2023: "double"}
    paths = {}
    for year, row in ((2022, TEXT), (2023, NUMBERS)):
        columns = ", ".join(f"{c} {schema[year]}" for c in V.COLUMNS)
        paths[year] = str(tmp_path / f"births_{year}.parquet")
        spark.createDataFrame([tuple(row.values())], columns).write.parquet(paths[year])
    paths[2024] = str(tmp_path / "births_2024.parquet")
    return paths


def test_years_of_different_types_are_united(spark, files):
    opened = Y.open_years(spark, files)
    births = Y.load_years(opened, Y.national_states(spark), Y.focus_codes())
    rows = {r.ANO_ARQUIVO: r for r in births.collect()}
    assert (rows[2022].CODMUNRES, rows[2022].UF, rows[2022].ANO) == ("520870", "GO", 2022)
    assert (rows[2022].IDADEMAE, rows[2022].ESCMAE2010, rows[2022].ESTCIVMAE) == (None, None, 2.0)
    assert (rows[2023].CODMUNRES, rows[2023].UF, rows[2023].ANO) == ("510340", "MT", 2023)
    assert rows[2023].regiao == "Centro-Oeste"


def test_region_filter_drops_other_states(spark, files):
    births = Y.load_years(Y.open_years(spark, files), Y.national_states(spark), ["51"])
    assert [r.UF for r in births.collect()] == ["MT"]


def test_absent_year_is_flagged(spark, files):
    rows = {r.ano: r for r in Y.inventory(spark, files, Y.open_years(spark, files)).collect()}
    assert (rows[2024].existe, rows[2024].n_linhas, rows[2024].escopo) == (False, None, "ausente")
    assert (rows[2022].n_linhas, rows[2022].n_colunas) == (1, 12)


def test_type_drift_is_reported(spark, files):
    schemas = Y.schema_rows(spark, Y.open_years(spark, files))
    drift = Y.type_drift(schemas, [2022, 2023]).collect()
    assert len(drift) == 12 and {(r.ano_2022, r.ano_2023) for r in drift} == {("string", "double")}
    assert Y.columns_not_everywhere(schemas).count() == 0


def test_national_states_cover_five_regions(spark):
    rows = Y.national_states(spark).collect()
    assert len(rows) == 27 and len({r.regiao for r in rows}) == 5


def test_absent_column_has_a_status_row(spark, files):
    opened = Y.open_years(spark, files)
    present = Y.schema_rows(spark, opened).select("ano", F.col("coluna").alias("variavel"))
    table = P.missingness(Y.scan_years(opened, V.PROFILED), present)
    rows = {(r.ano, r.variavel): r for r in table.collect()}
    assert (rows[2022, "GESTACAO"].status, rows[2022, "GESTACAO"].n_null) == ("AUSENTE", None)
    assert (rows[2022, "CONSULTAS"].n_ign, rows[2022, "ESCMAE2010"].n_null) == (1, 1)
    assert rows[2023, "MESPRENAT"].n_ign == 1


def test_absent_column_has_no_profile(spark, files):
    opened = Y.open_years(spark, files)
    assert len(opened.having("GESTACAO")) == 0
    kept = Y.scan_years(opened.having("GRAVIDEZ"), ("GRAVIDEZ",))
    assert P.code_distribution(kept, "GRAVIDEZ", {}).select("ano").distinct().count() == 2


def test_one_scan_per_schema(spark, tmp_path):
    paths = {}
    for year in range(2015, 2021):
        paths[year] = str(tmp_path / f"births_{year}.parquet")
        kind = "double" if year == 2017 else "string"
        spark.createDataFrame([(str(year), 1)], "x string, k int").select(
            F.col("x").cast(kind).alias("x"), "k").write.parquet(paths[year])
    paths[2014] = str(tmp_path / "births 2014=a")
    spark.range(3).select(F.lit("2014").alias("x"), F.lit(1).alias("k")).write.parquet(paths[2014])
    opened = Y.open_years(spark, paths)
    scan = Y.scan_years(opened, ("x",))
    assert {(r.ano, r.x) for r in scan.collect()} == {(y, str(y)) for y in range(2014, 2021)}
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(opened.tables) == 2
    assert opened[2014].count() == 3 and len(opened) == 7


def test_schema_rows_carry_counts_of_values(spark, files):
    opened = Y.open_years(spark, files)
    filled = Y.with_filled(Y.schema_rows(spark, opened), opened)
    rows = {(r.ano, r.coluna): r.preenchidos for r in filled.collect()}
    assert len(rows) == sum(len(f.columns) for f in opened.values())
    for (year, column), n in rows.items():
        assert n == opened[year].where(F.col(column).isNotNull()).count()


def test_percentiles_are_nearest_rank(spark):
    scan = spark.createDataFrame([(2020, v) for v in ("10", "20", "30", "40", "", "x")], "ano int, v string")
    scan = scan.withColumn("v", F.nullif("v", F.lit("")))
    row = P.number_range(scan, "v", 15, 35).first()
    assert (row.min, row.max, row.p1, row.p50, row.p99) == (10, 40, 10, 30, 40)
    assert (row.n_lt, row.n_gt, row.pct_null) == (1, 1, pytest.approx(100 / 6))


def test_csv_comment_lines_are_skipped(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("# provenance\nModelo,OR\nM1,1.5\nM2,\n")
    rows = S.read_csv(spark, str(path), "Modelo string, OR double").collect()
    assert [(r.Modelo, r.OR) for r in rows] == [("M1", 1.5), ("M2", None)]


def test_csv_round_trip_keeps_provenance_apart(spark, tmp_path):
    path = str(tmp_path / "report")
    S.write_csv(spark.range(3), path, "seed 42")
    assert S.read_csv(spark, path, "id bigint").count() == 3
    assert S.read_provenance(spark, path).first().provenance == "# seed 42"
    assert S.read_if_present(spark, path, "id bigint").count() == 3
    assert S.read_if_present(spark, path + "-none", "id bigint").count() == 0


def test_markdown_and_log_lines(spark):
    lines = spark.createDataFrame([("| a | b |",), ("|---|--:|",), ("| x | 1,234 |",), ("text",)], "value string")
    assert [tuple(r) for r in S.markdown_cells(lines, ["a", "b"]).collect()] == [("x", "1,234")]
    log = spark.createDataFrame([("[t]     cascata 1_raca: 12,345",), ("other",)], "value string")
    assert [tuple(r) for r in S.cascade_from_log(log).collect()] == [("1_raca", 12345)]


def test_stored_table_is_reused(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path, lambda: spark.range(3)).count() == 3
    assert stored(spark, path, lambda: spark.range(9)).count() == 3


OTHER_PROCESS = """
import json, sys
sys.path.insert(0, sys.argv[1])
from vitalcells.session import local_session
from vitalcells.storage import Store
spark = local_session(2)
store = Store(spark, sys.argv[2], [sys.argv[3]], sys.argv[4])
built = []
def build():
    built.append(1)
    return spark.read.parquet(sys.argv[3]).withColumn("half", __import__("pyspark").sql.functions.expr("id % 2"))
rows = store.table("t", build, ("half",)).count()
print("RESULT", json.dumps([len(built), rows, store.manifest("t")["inputs"][0]["files"] > 0]))
"""


def test_another_process_reuses_a_stored_table(spark, tmp_path):
    source, root = str(tmp_path / "in.parquet"), str(tmp_path / "store")
    here = str(Path(__file__).resolve().parents[1])

    def other(rules):
        run = subprocess.run([sys.executable, "-c", OTHER_PROCESS, here, root, source, rules],
                             capture_output=True, text=True, timeout=300)
        line = [x for x in run.stdout.splitlines() if x.startswith("RESULT")]
        assert line, run.stderr[-2000:]
        return json.loads(line[0][7:])

    def builds(rules):
        built = []
        store = Store(spark, root, [source], rules)
        rows = store.table("t", lambda: built.append(1) or spark.read.parquet(source).withColumn("half", F.expr("id % 2")),
                           ("half",)).count()
        return len(built), rows

    spark.range(10).write.parquet(source)
    assert builds("a") == (1, 10) and builds("a") == (0, 10)
    assert other("a") == [0, 10, True]
    assert builds("b") == (1, 10)  # other rules: a table of their own, beside the first
    assert len(list((tmp_path / "store" / "t").iterdir())) == 2
    spark.range(25).write.mode("overwrite").parquet(source)
    assert other("a") == [1, 25, True]  # a changed input rebuilds it and removes the old one
    assert len(list((tmp_path / "store" / "t").iterdir())) == 2
    assert builds("a") == (0, 25) and builds("b") == (1, 25)
    plan = Store(spark, root, [source], "a").table("t", lambda: None).where("half = 1")
    assert "PartitionFilters: [isnotnull(half" in plan._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_checkpoint_folder(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_small_lookups_are_marked_for_broadcast(spark):
    def marked(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    assert marked(small(spark.range(5), 5)) and not marked(small(spark.range(6), 5))


def test_snapshot_is_never_replaced(spark, tmp_path):
    R.write_snapshot(spark.range(1), str(tmp_path), "2026-07-06")
    with pytest.raises(AnalysisException):
        R.write_snapshot(spark.range(2), str(tmp_path), "2026-07-06")


def test_phrases_are_found_anywhere_in_the_text(spark):
    long = "x" * 200_000 + " Saúde Digital"
    df = spark.createDataFrame([(1, long), (2, "nada"), (3, None)], "id int, t string")
    rows = {r.id: r for r in R.with_hits(df, "t", V.KEYWORDS).collect()}
    assert rows[1].achados == ["saúde digital"] and rows[2].n_achados == 0 and rows[3].n_achados == 0


def test_tiers(spark):
    df = spark.createDataFrame([(2, True, True), (1, True, False), (1, False, False), (0, True, True),
                                (5, None, True)], "k int, e boolean, d boolean")
    out = df.select(R.tier(F.col("k"), 2, F.col("e"), F.col("d")).alias("t")).collect()
    assert [r.t for r in out] == ["Alta", "Média", "Baixa", "Baixa", "Média"]


def test_phrases_of_several_words(spark):
    df = spark.createDataFrame([
        (1, "Clima e Saúde; clima  e saúde"), (2, "xclima e saúde, saúde materno-infantil!"), (3, "SIM sim simples"),
        (4, "saúde pública_saúde digital3"), (5, "")], "id int, t string")
    rows = {r.id: r.achados for r in R.with_hits(df, "t", V.KEYWORDS).collect()}
    assert rows == {1: ["clima e saúde"], 2: ["saúde materno-infantil"], 3: ["SIM"],
                    4: ["saúde digital", "saúde pública"], 5: []}
    many = [f"palavra{chr(97 + i // 26)}{chr(97 + i % 26)} nova" for i in range(500)]
    assert R.with_hits(df, "t", [*V.KEYWORDS, *many]).where("n_achados = 1").count() == 3
    with pytest.raises(ValueError):
        R.with_hits(df, "t", ["3 dias"])
