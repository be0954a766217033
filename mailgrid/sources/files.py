"""Delimited files and dated snapshot folders."""

import datetime as dt
import os
from contextlib import contextmanager

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.functions import columns as fn


def read_capacity_csv(spark, path):
    """Postal capacities from ';' files with the export header."""
    renamed = schemas.POSTAL_CAPACITY.replace("timestamp_ntz", "timestamp")
    for ours, theirs in schemas.CSV_CAPACITY_HEADER.items():
        renamed = renamed.replace(f"{ours} ", f"{theirs} ", 1)
    df = spark.read.schema(renamed).option("sep", ";").option("header", True).csv(path)
    names = {theirs: ours for ours, theirs in schemas.CSV_CAPACITY_HEADER.items()}
    df = df.withColumnsRenamed(names)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_ts", "to_ts")})


# Files a task keeps open at once where the rows of a folder are not sorted together.
OPEN_FILES = 128


@contextmanager
def _open_files(spark, number):
    """Lets tasks write that many folders at once, instead of sorting their rows by folder; of
    more folders the rest is sorted."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(number))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _csv(writer, quote_all):
    return (
        writer.mode("overwrite")
        .option("sep", ";")
        .option("header", True)
        .option("quoteAll", quote_all)
    )


def write_csv_batches(
    df, path, max_rows=schemas.MAX_CSV_ROWS, quote_all=False, by=None, compression=None, placed=False
):
    """CSV files of at most ``max_rows`` rows, optionally one folder per value of ``by``.

    Each task starts a new file when one is full: no row has to be counted or moved first. A
    folder column only adds a rebalance, which AQE cuts into even parts, so that a small
    folder gets few files and a huge one is written by many tasks. Rows whose tasks have few
    folders each already are ``placed``: they are neither moved nor sorted.
    """
    if by and not placed:
        df = df.hint("rebalance", by)
    writer = _csv(df.write, quote_all).option("maxRecordsPerFile", max_rows)
    if compression:
        writer = writer.option("compression", compression)
    with _open_files(df.sparkSession, OPEN_FILES if by and placed else 0):
        (writer.partitionBy(by) if by else writer).csv(path)


def write_by_week(
    df, path, max_rows=schemas.MAX_CSV_ROWS, quote_all=True, compression=None, placed=False
):
    """One folder per delivery-week label, in a single pass over the pieces."""
    write_csv_batches(
        df, path, max_rows, quote_all, by="week_label", compression=compression, placed=placed
    )


def province_capacity_rows(run_capacity, run_id=None, modified_only=False):
    """Rows of the province-capacity file: rows without any product flag are left out, the end
    of an open window is empty, and the peak column repeats the capacity."""
    df = run_capacity.filter(F.col("p890").isNotNull() | F.col("p_ar").isNotNull())
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    if modified_only:
        df = df.filter(~F.col("is_default"))
    return df.select(
        "run_id",
        F.col("courier").alias("unifiedDeliveryDriver"),
        F.col("province").alias("geoKey"),
        "capacity",
        F.col("capacity").alias("peakCapacity"),
        fn.iso_ms("from_ts").alias("activationDateFrom"),
        fn.iso_ms("to_ts").alias("activationDateTo"),
        fn.flags_to_products().alias("products"),
    )


def export_province_capacity(run_capacity, path, run_id=None, modified_only=False):
    """The province-capacity file of one run, or one folder for each run."""
    rows = province_capacity_rows(run_capacity, run_id, modified_only)
    if run_id is None:
        write_csv_batches(rows, path, schemas.MAX_UPLOAD_ROWS, by="run_id")
    else:
        write_csv_batches(rows.drop("run_id"), path, schemas.MAX_UPLOAD_ROWS)


def read_province_capacity(spark, path):
    """Province-capacity files read back, with the run id where they lie in folders of runs."""
    schema = (
        "unifiedDeliveryDriver string, geoKey string, capacity bigint, peakCapacity bigint, "
        "activationDateFrom string, activationDateTo string, products string, run_id int"
    )
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def postal_capacity_rows(assigned):
    """Rows of the postal-capacity file: products stay empty."""
    out = assigned.withColumn("products", F.lit(None).cast("string"))
    return out.select(*[F.col(a).alias(b) for a, b in schemas.CSV_CAPACITY_HEADER.items()])


def export_courier_view(view, path, month):
    rows = view.filter(F.col("month") == month).select(
        F.col("month").alias("DELIVERY_DATE"),
        F.col("courier").alias("UNIFIED_DELIVERY_DRIVER"),
        F.col("region").alias("REGIONE"),
        F.col("product").alias("PRODUCT_TYPE"),
        F.col("sum_monthly").alias("SUM_MONTHLY_ESTIMATE"),
    )
    write_csv_batches(rows, path)


def piece_rows(pieces):
    """Rows of the pieces file, with the week label that names their folder."""
    return pieces.select(
        *[F.col(a).alias(b) for a, b in schemas.CSV_PIECE_HEADER.items()],
        cal.next_monday("week").alias("week_label"),
    )


def path_exists(spark, path):
    """Whether the path is there, on whatever storage; other errors rise."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def write_snapshot(df, base, extract_date, month):
    """Adds a month's extract of one day as ``base/extract_date=.../month=...``."""
    path = os.path.join(base, f"extract_date={extract_date}", f"month={month}")
    df.write.mode("overwrite").parquet(path)


def write_snapshots(df, base, placed=False):
    """Adds the extracts of all days and months the rows name in extract_date and month, in the
    folders of ``write_snapshot``. Rows whose tasks have few folders each already are ``placed``:
    they are neither moved nor sorted."""
    by = ["extract_date", "month"]
    if not placed:
        df = df.hint("rebalance", *by)
    with _open_files(df.sparkSession, OPEN_FILES if placed else 0):
        df.write.partitionBy(*by).parquet(base)


def read_latest_snapshot(
    spark, base, month, as_of, lookback_days=schemas.LOOKBACK_DAYS, required=True
):
    """The month's newest extract of the last ``lookback_days`` days, ``as_of`` included.

    Months are compared whole. Only folders of the window's days are listed, and only the one
    folder is read. Without any extract it fails, or has no rows and no columns when not
    ``required``.
    """
    as_of = dt.date.fromisoformat(str(as_of))
    oldest = as_of - dt.timedelta(days=lookback_days - 1)
    day = oldest
    found = []
    while day <= as_of:
        path = os.path.join(base, f"extract_date={day}", f"month={month}")
        if path_exists(spark, path):
            found.append(path)
        day += dt.timedelta(days=1)
    if not found and required:
        raise FileNotFoundError(f"no extract of {month} in {base} since {oldest}")
    return spark.read.option("basePath", base).parquet(found[-1]) if found else spark.range(0).select()


def extract_folder(base, day, month):
    """Folder of a month's extract of one day: ``base/yyyy/MM/dd/yyyy-MM``."""
    return os.path.join(base, f"{day:%Y/%m/%d}", month)


def latest_extract_folder(
    spark, base, month, as_of, lookback_days=schemas.LOOKBACK_DAYS, required=True
):
    """The newest such folder of the last ``lookback_days`` days that holds a CSV file, or None
    if none is ``required``. Only the window's own folders are listed, no file is read."""
    as_of = dt.date.fromisoformat(str(as_of))
    oldest = as_of - dt.timedelta(days=lookback_days - 1)
    newest, day = None, as_of
    while newest is None and day >= oldest:
        folder = extract_folder(base, day, month)
        if path_exists(spark, folder):
            listing = spark.read.format("binaryFile").option("recursiveFileLookup", True)
            found = listing.option("pathGlobFilter", "*.csv").load(folder).select("path")
            newest = None if found.isEmpty() else day
        day -= dt.timedelta(days=1)
    if newest is None and required:
        raise FileNotFoundError(f"no extract of {month} in {base} since {oldest}")
    return newest and extract_folder(base, newest, month)
