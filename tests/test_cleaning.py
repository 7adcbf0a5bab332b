import datetime

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import cleaning as c
from ledgerspark.operators.prefix import code_depth, code_depth_label, group_code, subgroup_code


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x").alias("y")).first().y


@pytest.mark.parametrize(
    "text, value",
    [
        ("1.188.854,66", 1188854.66), ("1.000,00", 1000.0), ("500,75", 500.75), ("0,00", 0.0), ("-2.500,30", -2500.3),
        (" 340818,85 ", 340818.85), ("N/A", None), ("n/d", None), ("#REF!", None), ("", None), ("   ", None), ("1,2,3", None),
    ],
)
def test_numbers(spark, text, value):
    assert one(spark, text, c.clean_number) == value


@pytest.mark.parametrize(
    "text, day",
    [
        ("31/12/2023", (2023, 12, 31)), ("01/01/2014", (2014, 1, 1)), ("15-06-2020", (2020, 6, 15)), ("2019-03-31", (2019, 3, 31)),
        ("20180101", (2018, 1, 1)), ("1/2/2023", (2023, 2, 1)), ("31/12/23", (2023, 12, 31)), ("31/12/95", (1995, 12, 31)),
        (" 05/06/68 ", (2068, 6, 5)), ("32/01/2020", None), ("2020-13-01", None), ("01/02-2020", None), ("soon", None), ("", None), ("2020", None),
    ],
)
def test_dates(spark, text, day):
    assert one(spark, text, c.clean_date) == (datetime.date(*day) if day else None)


def test_comma_number_keeps_dots(spark):
    assert one(spark, "1.5", c.comma_number) == 1.5
    assert one(spark, "1.000,50", c.comma_number) is None


@pytest.mark.parametrize("text, ok", [("1710034065", True), ("1710034064", False), ("9910034065", False), ("17100340", False), (None, False)])
def test_national_id(spark, text, ok):
    assert one(spark, text, c.national_id_valid) is ok


def test_ruc_reasons(spark):
    assert one(spark, "1790016919001", c.ruc_problem) is None
    assert "tiene 12 caracteres" in one(spark, "179001691900", c.ruc_problem)
    assert "tiene '002'" in one(spark, "1790016919002", c.ruc_problem)


def test_service_span(spark):
    df = spark.sql("select date'2016-02-29' a, date'2023-02-28' b").select(
        c.full_years("a", "b").alias("y"), c.calendar_months("a", "b").alias("m"), c.days_apart("a", "b").alias("d")
    )
    assert tuple(df.first()) == (6, 84, 2556)


def test_price_stock_and_keys(spark):
    assert one(spark, "£1,051.77", c.price_clean) == 1051.77
    assert one(spark, " In stock (3) ", c.stock_label) == "In Stock"
    assert one(spark, "Cía. Ñandú & Hijos  S.A.", c.file_key) == "CÍA_ÑANDÚ_HIJOS_SA"


@pytest.mark.parametrize(
    "code, depth, label, group, sub",
    [
        ("1", 1, "clase", None, None), ("101", 2, "grupo", "101", None), ("10101", 3, "subgrupo", "101", "10101"),
        ("1010101", 4, "detalle", "101", "10101"), ("502.03.08", 3, "subgrupo", "502", "502.03"), ("101.02.02.02.08", 5, "detalle", "101", "101.02"),
        ("98", 4, "detalle", None, None),
    ],
)
def test_codes(spark, code, depth, label, group, sub):
    row = spark.createDataFrame([(code,)], "account_code string").select(
        code_depth().alias("d"), code_depth_label().alias("l"), group_code().alias("g"), subgroup_code().alias("s")
    ).first()
    assert tuple(row) == (depth, label, group, sub)


def test_template(spark):
    df = spark.createDataFrame([("Ana",)], "n string").select(c.fill_template("Hola [nombre], [mes]", {"nombre": F.col("n"), "mes": F.lit("enero")}).alias("t"))
    assert df.first().t == "Hola Ana, enero"
