import datetime as dt

from pyspark.sql import functions as F

from mailgrid.functions import columns as fn


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_half_even_matches_python(spark):
    values = [i / 2 for i in range(-9, 10)] + [35 / 30 * 3, 15 / 30 * 7, 2.4999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", fn.half_even("v").alias("r")).collect():
        assert r.r == int(round(r.v, 0))


def test_floors(spark):
    r = one(
        spark,
        a=fn.pct_floor(F.lit(99), 50),
        b=fn.pct_floor(F.lit(-1), 20),
    )
    assert tuple(r) == (1, -1)


def test_hour_to_zero_keeps_the_rest_whatever_its_length(spark):
    text = "2026-01-02T10:30:00." + "0" * 200 + "Z"
    assert one(spark, a=fn.hour_to_zero(F.lit(text))).a == text.replace("T10:", "T00:")


def test_keys_skip_nulls_but_labels_do_not(spark):
    none = F.lit(None).cast("string")
    r = one(
        spark,
        key=fn.compose_key(F.lit("s"), none, F.lit("RS")),
        label=fn.series_label(F.lit("AQ"), none),
        full=fn.series_label(F.lit("AQ"), F.lit("K1")),
    )
    assert tuple(r) == ("s~RS", None, "AQ - K1")


def test_product_flags_both_ways(spark):
    df = spark.createDataFrame(
        [(["890", "RS"], True, None), (["AR"], False, True), (None, True, True)],
        "products array<string>, p890 boolean, p_ar boolean",
    )
    out = df.select(
        *[c.alias(f"f_{k}") for k, c in fn.products_to_flags("products").items()],
        fn.flags_to_products().alias("export"),
        fn.flags_to_products(style="sheet").alias("sheet"),
    ).collect()
    assert [tuple(r) for r in out] == [
        (True, False, True, "890,RS", "890"),
        (False, True, False, "AR,RS", "AR"),
        (False, False, False, "890,AR,RS", "890-AR"),
    ]


def test_labels(spark):
    df = spark.createDataFrame([(0, "No picchi"), (1, ">=50% picchi"), (None, "?")], "p int, b string")
    out = [tuple(r) for r in df.select(fn.label_peak("p"), fn.band_ordinal("b")).collect()]
    assert out == [("Assente", 0), ("Presente", 2), (None, None)]


def test_parsing(spark):
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    r = one(
        spark,
        day=fn.parse_dmy(F.lit("20/10/2025")),
        bad=fn.parse_dmy(F.lit("no date")),
        zero=fn.parse_ts(fn.hour_to_zero(F.lit("2026-02-02T10:30:15.000Z")), iso).cast("string"),
        iso=fn.iso_ms(F.lit("2026-02-02 00:00:00").cast("timestamp_ntz")),
        off=fn.flag_text(F.lit("0")),
        on=fn.flag_text(F.lit(None).cast("string")),
    )
    assert tuple(r) == (
        dt.date(2025, 10, 20),
        None,
        "2026-02-02 00:30:15",
        "2026-02-02T00:00:00.000Z",
        False,
        True,
    )


def test_path_parts(spark):
    parts = fn.path_parts(F.lit("bucket/input/2026/01/20/2026-02/2026-02-09/part-0.csv"), 2)
    r = one(spark, **parts)
    assert tuple(r) == (dt.date(2026, 1, 20), "2026-02", "part-0.csv")


def test_malformed_body_gives_null(spark):
    r = one(spark, a=fn.decode_body(F.lit("{oops"), "x int")["x"])
    assert r.a is None
