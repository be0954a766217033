import datetime as dt
import json

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.plans import overrides

NOW = "2026-02-10 00:00:00"


def typed(province, start, capacity, real, base, flag="1", product="890-AR"):
    day = dt.datetime.strptime(start, "%d/%m/%Y") + dt.timedelta(days=6)
    return {
        "regione": "R", "cod_sigla_provincia": province, "product": product,
        "postalizzazioni_mensili": "460", "postalizzazioni_settimanali": "153",
        "inizioPeriodoValidita": start, "finePeriodoValidita": day.strftime("%d/%m/%Y"),
        "capacita": str(capacity), "capacita_reale": str(real), "capacita_bau_originale": str(base),
        "flag_default": flag,
    }


def load(spark, doc):
    return overrides.load_overrides(spark.createDataFrame([(1, json.dumps(doc))], "run_id int, body string"))


DOC = {
    "K1": [typed("AQ", "09/02/2026", 70, 50, 40, product="AR"), typed("AQ", "02/02/2026", 60, 51, 41, "0"),
           typed("TE", "02/02/2026", 5, 6, 7)],
    "K2": [typed("AQ", "02/02/2026", 1, 2, 3)],
}


def test_load(spark, rows):
    out = load(spark, DOC)
    assert rows(out, "courier", "province", "from_ts", "to_ts", "capacity", "p890", "p_ar", "is_default") == [
        ("K1", "AQ", dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 8, 23, 59, 59), 60, True, True, False),
        ("K1", "AQ", dt.datetime(2026, 2, 9), dt.datetime(2026, 2, 15, 23, 59, 59), 70, False, True, True),
        ("K1", "TE", dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 8, 23, 59, 59), 5, True, True, True),
        ("K2", "AQ", dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 8, 23, 59, 59), 1, True, True, True)]


def test_tails(spark, rows):
    for kind, first, flag in [("BAU", 51, True), ("Combinata", 41, True), ("Picco", 51, False)]:
        out = overrides.append_tails(load(spark, DOC), F.lit(kind), NOW)
        assert out.count() == 3
        assert rows(out.filter("courier = 'K1' and province = 'AQ'"),
                    "from_ts", "to_ts", "capacity", "p890", "p_ar", "is_default", "sum_weekly") == [
            (dt.datetime(2026, 2, 16), None, first, False, True, flag, 153)]


def test_apply(spark, rows):
    def stored(run, courier, province, start, end, capacity):
        start = dt.datetime.fromisoformat(start)
        end = end and dt.datetime.fromisoformat(end)
        return (courier, start, end, capacity, 1, 2, "R", province, True, True, start, True, run)

    table = spark.createDataFrame([
        stored(1, "K1", "AQ", "2026-02-02", "2026-02-08", 10),
        stored(1, "K1", "ZZ", "2026-02-02", "2026-02-08", 11),
        stored(1, "K1", "AQ", "2026-02-16", None, 12),
        stored(2, "K1", "AQ", "2026-02-16", None, 13),
        stored(1, None, "AQ", "2026-02-02", "2026-02-08", 14),
    ], schemas.RUN_CAPACITY)
    out = overrides.apply_overrides(table, load(spark, DOC), F.lit("BAU"), NOW)
    assert rows(out, "run_id", "courier", "province", "from_ts", "capacity", "sum_weekly", "is_default") == sorted([
        (1, "K1", "AQ", dt.datetime(2026, 2, 2), 60, 2, False),
        (1, "K1", "ZZ", dt.datetime(2026, 2, 2), 11, 2, True),
        (2, "K1", "AQ", dt.datetime(2026, 2, 16), 13, 2, True),
        (1, None, "AQ", dt.datetime(2026, 2, 2), 14, 2, True),
        (1, "K1", "AQ", dt.datetime(2026, 2, 9), 70, 0, True),
        (1, "K1", "TE", dt.datetime(2026, 2, 2), 5, 0, True),
        (1, "K2", "AQ", dt.datetime(2026, 2, 2), 1, 0, True),
        (1, "K1", "AQ", dt.datetime(2026, 2, 16), 51, 153, True),
        (1, "K1", "TE", dt.datetime(2026, 2, 9), 6, 153, True),
        (1, "K2", "AQ", dt.datetime(2026, 2, 9), 2, 153, True),
    ], key=lambda r: [(v is None, str(v)) for v in r])


def test_last_typed_row_of_a_key_counts(spark, rows):
    doc = {"K": [typed("AQ", "02/02/2026", 1, 1, 1), typed("AQ", "02/02/2026", 2, 2, 2)]}
    empty = spark.createDataFrame([], schemas.RUN_CAPACITY)
    out = overrides.apply_overrides(empty, load(spark, doc), F.lit("BAU"), NOW).filter("to_ts is not null")
    assert rows(out, "capacity") == [(2,)]


def test_saving_updates_inserts_and_puts_rs_rows_back(spark, rows):
    start, end = dt.datetime(2026, 2, 2), dt.datetime(2026, 2, 8)
    table = spark.createDataFrame([
        ("K1", start, end, 10, 1, 2, "R", "AQ", True, True, start, True, 1),
        ("K9", start, None, 8, 0, 0, None, "AQ", False, False, start, True, 1),
        ("K1", start, end, 20, 1, 2, "R", "AQ", True, True, start, True, 7),
    ], schemas.RUN_CAPACITY)
    declared = spark.createDataFrame(
        [(3, "AQ", "t", False, False, True, "t", "K9", start, 5, start, None, "pk", 4, start)],
        schemas.DECLARED_CAPACITY)
    runs = spark.createDataFrame(
        [(i, "r", None, None, None, None, "2026-02", kind, "Manuale") for i, kind in [(1, "Picco"), (2, "BAU"), (7, "BAU")]],
        schemas.RUNS)
    doc = {"K1": [typed("AQ", "02/02/2026", 60, 50, 40)]}
    both = load(spark, doc).unionByName(load(spark, doc).withColumn("run_id", F.lit(2)))
    out = overrides.save_run_capacity(table, both, declared, runs, NOW)
    assert rows(out, "run_id", "courier", "from_ts", "to_ts", "capacity", "p890", "is_default") == sorted([
        (1, "K1", start, end, 60, True, True),
        (1, "K1", dt.datetime(2026, 2, 9), None, 50, True, False),
        (1, "K9", start, None, 5, False, False),
        (2, "K1", start, dt.datetime(2026, 2, 8, 23, 59, 59), 60, True, True),
        (2, "K1", dt.datetime(2026, 2, 9), None, 50, True, True),
        (2, "K9", start, None, 3, False, True),
        (7, "K1", start, end, 20, True, True),
    ], key=lambda r: [(v is None, str(v)) for v in r])
