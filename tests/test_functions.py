"""Scalar rules on literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalcells.functions import derive as D
from vitalcells.functions import normalize as N
from vitalcells.functions import text as X


def values(spark, rows, dtype, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {dtype}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("dtype, rows, expected", [
    ("string", [" 4 ", "", "  ", "\t7\n", "\u00a09\u2003", "a b", "é", None],
     ["4", None, None, "7", "9", "a b", "é", None]),
    ("double", [9.0, 12012023.0, 520870.0, 1.5, float("nan"), None],
     ["9", "12012023", "520870", "1.5", None, None]),
    ("int", [9, None], ["9", None]),
])
def test_clean(spark, dtype, rows, expected):
    kind = T._parse_datatype_string(dtype)
    assert values(spark, rows, dtype, lambda c: N.clean(c, kind)) == expected


def test_number_rejects_what_is_not_plainly_numeric(spark):
    rows = ["4", "-1.5", "x", "1d", "0x10", "0x1p3", "1f", "nan", "inf", "", "1e2", "7.", ".", "1/2", None]
    assert values(spark, rows, "string", N.number) == [
        4.0, -1.5, None, None, None, None, None, None, None, None, 100.0, 7.0, None, None, None]


def test_pad_keeps_longer_values(spark):
    assert values(spark, ["7", "5208707", None], "string", lambda c: N.pad_left(c, 6)) == [
        "000007", "5208707", None]


def test_year_of_date(spark):
    rows = ["1012023", "01012023", "31129999", "abc", None]
    assert values(spark, rows, "string", N.date_year) == [2023, 2023, 9999, None, None]


def test_year_outside_window_uses_file_year(spark):
    assert values(spark, [2023, 9999, None], "int",
                  lambda c: N.year_or_file_year(c, F.lit(2020), (2015, 2024))) == [2023, 2020, 2020]


def test_age_bands(spark):
    rows = [9.0, 10.0, 19.0, 20.0, 34.0, 35.0, 60.0, 61.0, None]
    assert values(spark, rows, "double", D.age_band) == [
        None, "<20", "<20", "20-34", "20-34", ">=35", ">=35", None, None]


def test_parity(spark):
    rows = [None, 0.0, 2.0, 3.0, 7.0, 99.0]
    assert values(spark, rows, "double", D.parity) == ["0", "0", "2", "3", "3", "Ign"]
    assert values(spark, rows, "double", lambda c: D.parity(c, null_is_zero=False)) == [
        None, "0", "2", "3", "3", "Ign"]


@settings(max_examples=10, deadline=None)
@given(counts=st.lists(st.integers(0, 120), min_size=1, max_size=30))
def test_parity_is_capped_for_any_count(spark, counts):
    expected = ["Ign" if c == 99 else str(min(c, 3)) for c in counts]
    assert values(spark, [float(c) for c in counts], "double", D.parity) == expected


def test_outcome(spark):
    assert values(spark, [22.0, 36.0, 37.0, 44.0, None], "double", D.preterm) == [1, 1, 0, 0, None]


def test_visits_keep_unknown_and_drop_unmapped(spark):
    assert values(spark, [0.0, 1.0, 4.0, 9.0, None], "double", D.visits) == [
        None, "None", "7plus", "Ignorado", None]


def test_share_skips_unknown(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (99,), (None,)], "m int")
    assert df.agg(D.share(F.col("m").between(1, 3)).alias("s")).first().s == pytest.approx(200 / 3)


def test_code_text(spark):
    assert values(spark, [9.0, 2023.0, None], "double", N.code_text) == ["9", "2023", None]


def test_number_text(spark):
    assert values(spark, [1234567.8912, 0.5, None], "double", X.decimal_text) == [
        "1.234.567,891", "0,500", ""]
    assert values(spark, [2156674], "bigint", X.count_text) == ["2.156.674"]
    assert values(spark, [1.5], "double", lambda c: X.interval_text(c, c * 2)) == ["1,500–3,000"]
