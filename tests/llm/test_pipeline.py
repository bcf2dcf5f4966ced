from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_ngram_jaccard import brute as components
from test_phrases import brute_hits

import corpus_pipeline as P
from vitalcells.llm import quality_rules, secret_scan

SF = "/root/testdata/sf0.001"


def write(spark, tmp_path, rows):
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    kept = P.quality(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    one = P.near_duplicates(spark, kept, SF)
    first = {d for d, _, c in components([(d, rows[d]) for d in sorted(good)]) if d == c}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == first
    clean = P.decontaminated(spark, one, SF)
    items = [(r.item_id, r.text) for r in bench.collect()]
    free = {r[0] for r in brute_hits([(d, rows[d]) for d in first], items) if not r[5]}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == free
    safe = P.secrets(spark, clean, SF)
    found = defaultdict(set)
    for r in secret_scan.scan(clean).where("secret").collect():
        found[r.doc_id].add(r.value)
    for r in safe.collect():
        assert not any(v in r.text for v in found[r.doc_id])
        if not found[r.doc_id]:
            assert r.text == rows[r.doc_id]
    assert safe.count() == len(free)
    assert {r.doc_id for r in P.mixed(spark, safe, SF).collect()} == free


def test_run_is_its_stages(spark):
    got = P.run(spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
    assert got == docs.orderBy("doc_id").collect()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0)]])
def test_odd_tables(spark, tmp_path, rows):
    assert P.run(spark, write(spark, tmp_path, rows)).count() == 0


def test_repeated_and_null_rows_leave_one(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "a"), (4, text, "b"), (4, text, "c"), (9, text + " x", "d"), (5, None, "e")],
                                 "doc_id long, text string, set_id string")
    got = P.near_duplicates(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in got.where(F.col("text").isNotNull()).collect()) == [(4, text)]
    assert got.count() == 2
