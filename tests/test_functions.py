"""Scalar functions on hand-made values."""

from datetime import date


from stockloom.functions import dates as D
from stockloom.functions import pricing as P
from stockloom.functions import text as T


def values(spark, rows, col):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r[0] for r in df.select(col).collect()]


def test_product_ids(spark):
    got = values(spark, ["1000.0", " 1000 ", "001000", "", "nan", None, "A-7"], T.normalize_product_id("x"))
    assert got == ["1000", "1000", "1000", None, None, None, "A-7"]


def test_text_cleaning(spark):
    assert values(spark, ["HidrataciÃ³n", "5Â €", "ok", None], T.fix_mojibake("x")) == ["Hidratación", "5 €", "ok", None]
    assert values(spark, ["  a   b\t c ", None], T.collapse_spaces("x")) == ["a b c", None]
    assert values(spark, ["  Añejo  CAFÉ ", None], T.normalize_category_text("x")) == ["anejo cafe", None]
    assert values(spark, ["¡Niño & Té!"], T.slugify("x")) == ["nino-te"]


def test_pack_sizes(spark):
    names = ["Gel x 60 ml", "Creatina 500 gr", "Sal 1,5 g", "sin unidad", "90 cápsulas", "pack 3 uds x 20 g"]
    assert values(spark, names, T.pack_size("x")) == [60.0, 500.0, 1.5, None, 90.0, 20.0]
    assert values(spark, names, T.pack_unit("x")) == ["ml", "g", "g", None, "capsulas", "g"]


def test_unit_conflicts(spark):
    df = spark.createDataFrame([("Gel 40 g", "Otros", "g"), ("x", "Bebidas", "g"), ("x", "Proteínas", "ml"), ("x", "Proteínas", "g"), ("x", None, None)], "n string, c string, u string")
    assert [r[0] for r in df.select(T.unit_conflict("n", "c", "u")).collect()] == [True, True, True, False, False]


def test_numbers_and_flags(spark):
    assert values(spark, ["1.234,56 €", "abc", "1.234 €", "-0,5", None], T.parse_localized_number("x")) == [1234.56, None, 1234.0, -0.5, None]
    assert values(spark, ["Sí", "0", "no", None, "verdadero"], T.normalize_bool("x")) == [True, False, False, False, True]
    assert values(spark, ["1|2", "3, 4", "", None], T.parse_scope_values("x")) == [[1, 2], [3, 4], [], []]


def test_dates(spark):
    got = values(spark, ["2024-02-29T10:00", "2024-02-30", "2024-01-05 08:00:00", "x", None], D.parse_flexible_date("x"))
    assert got == [date(2024, 2, 29), None, date(2024, 1, 5), None, None]
    df = spark.createDataFrame([(date(2024, 2, 29),), (date(2023, 2, 28),)], "d date")
    row = df.select(D.relabel_year("d", 2023), D.was_relabelled("d", 2023)).collect()
    assert [tuple(r) for r in row] == [(date(2023, 2, 28), True), (date(2023, 2, 28), False)]


def test_feasts(spark):
    df = spark.createDataFrame([(2022,), (2023,), (2024,), (2025,)], "y int")
    assert [r[0] for r in df.select(D.easter("y")).collect()] == [date(2022, 4, 17), date(2023, 4, 9), date(2024, 3, 31), date(2025, 4, 20)]
    got = df.where("y = 2024").select(D.black_friday("y"), D.black_friday("y", "fourth"), D.prime_day("y"), D.nth_weekday("y", 1, 0, 3)).first()
    assert tuple(got) == (date(2024, 11, 29), date(2024, 11, 22), date(2024, 7, 9), date(2024, 1, 15))


def test_multiples_and_multipliers(spark):
    df = spark.createDataFrame([(7, 6), (7, 0), (7, 1), (7, None), (-3, 6), (0, 6), (12, 6)], "x int, m int")
    assert [r[0] for r in df.select(P.ceil_to_multiple("x", "m")).collect()] == [12, 7, 7, 7, 0, 0, 12]
    caps = spark.createDataFrame([(-0.25, 1, False), (-0.99, 2, True), (-0.99, 2, False), (5.0, 2, False)], "d double, c int, e boolean")
    got = [round(r[0], 4) for r in caps.select(P.elasticity_multiplier("d", "c", "e")).collect()]
    assert got == [1.3333, 4.2, 2.8, 0.5]


def test_buckets_and_factors(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (5,), (7,), (8,), (None,)], "d int")
    assert [r[0] for r in df.select(P.lead_time_bucket("d")).collect()] == ["10-15", "2-4", "2-4", "5-7", "5-7", "10-15", None]
    f = spark.createDataFrame([(1.0, 1.1, 0.9), (1.0, 1.0, 1.0)], "M_b double, M_a double, M_c double")
    assert [r[0] for r in f.select(P.factors_applied(["M_b", "M_a", "M_c"])).collect()] == ["a|c", "None"]


def test_formatting(spark):
    df = spark.createDataFrame([(1234567.2,), (3.0,)], "x double")
    assert [r[0] for r in df.select(T.format_units_ceil("x")).collect()] == ["1.234.568", "3"]
    assert values(spark, ["Prov. S.L.", None], T.order_id("x", "s")) == ["PO_ProvSL_s", "PO_NA_s"]
    assert [c for c in T.normalize_headers(spark.createDataFrame([(1, 2)], ["﻿ID Producto", "Précio"]), {"product_id": ["id_producto"]}).columns] == ["product_id", "precio"]


def test_ids_of_any_length_and_letters(spark):
    got = values(spark, ["001234567890123456789", "12D", "7f", "-005.00", "1e3", "000"], T.normalize_product_id("x"))
    assert got == ["1234567890123456789", "12D", "7f", "-5", "1e3", "0"]


def test_headers_that_clash_are_an_error(spark):
    import pytest

    df = spark.createDataFrame([(1, 2)], ["Precio", "price"])
    with pytest.raises(ValueError):
        T.normalize_headers(df, {"precio": ["price"]})
    assert T.normalize_headers(spark.createDataFrame([(1,)], ["Id/Producto-Num.,x"])).columns == ["id_producto_num_x"]
