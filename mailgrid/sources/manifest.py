"""Which files lie in which week folder, and whether all of them were loaded."""

from pyspark.sql import Window
from pyspark.sql import functions as F


# Exported files, compressed or not.
CSV_FILES = "*.{csv,csv.gz}"


def list_files(spark, base):
    """Path, length and week of every CSV file in a week folder; contents are not read.

    Files outside a week folder, such as postal capacities and residuals, are left out.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_FILES)
        .load(base)
        .select("path", "length")
    )
    week = F.regexp_extract("path", r"/(?:week_label=)?(\d{4}-\d{2}-\d{2})/[^/]+$", 1)
    return found.withColumn("week", F.to_date(F.nullif(week, F.lit("")))).filter(
        F.col("week").isNotNull()
    )


def number_weeks(files, slots=6):
    """Gives each file its week's position in the month; positions without files come once
    with NULL fields, so that at least ``slots`` weeks are listed."""
    order = Window.orderBy("week")
    weeks = files.select("week").distinct().withColumn("week_no", F.row_number().over(order))
    spark = files.sparkSession
    missing = (
        spark.range(1, slots + 1)
        .select(F.col("id").cast("int").alias("week_no"))
        .join(weeks, "week_no", "left_anti")
    )
    return files.join(weeks, "week").unionByName(missing, allowMissingColumns=True)


def week_manifest(spark, base, slots=6):
    """Files of each week, numbered from the first week."""
    return number_weeks(list_files(spark, base), slots)


def manifest_counts(manifest):
    return manifest.groupBy("week_no", "week").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")
    )


def reconcile_manifest(expected, loaded, key="file_name"):
    """Files by status: 'loaded', 'missing' or 'unexpected', with the count on each side."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("l")).unionByName(
        loaded.select(key, F.lit(0).alias("e"), F.lit(1).alias("l"))
    )
    sides = both.groupBy(key).agg(
        F.sum("e").cast("bigint").alias("expected"), F.sum("l").cast("bigint").alias("loaded")
    )
    status = (
        F.when(F.col("loaded") == 0, "missing")
        .when(F.col("expected") == 0, "unexpected")
        .otherwise("loaded")
    )
    return sides.withColumn("status", status)


def plain_path(column):
    """A path without its scheme, which the sources write in different ways."""
    return F.regexp_replace(column, "^[a-z0-9]+:/+", "/")


def listed_rows(spark, base):
    """Every CSV file in a week folder with its week and the rows it holds: its lines but the
    header. Spark's readers do not list files without a byte."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", CSV_FILES)
        .text(base)
        .groupBy(plain_path(F.col("_metadata.file_path")).alias("file"))
        .agg((F.count(F.lit(1)) - 1).alias("_rows"))
    )
    files = list_files(spark, base).select(plain_path("path").alias("file"), "week")
    return files.join(lines, "file", "left").select(
        "file", "week", F.coalesce("_rows", F.lit(0)).alias("listed")
    )


def loaded_rows(loaded):
    """Rows loaded from each file; ``loaded`` is a frame read from files."""
    path = plain_path(F.col("_metadata.file_path"))
    return loaded.select(path.alias("file")).groupBy("file").agg(
        F.count(F.lit(1)).alias("loaded")
    )


def reconcile_files(listed, loaded):
    """Every file with the rows it holds and the rows loaded from it, and its status: 'loaded',
    'partial', 'missing', or 'unexpected' for a file that is not listed."""
    both = listed.join(loaded, "file", "full_outer")
    rows = F.coalesce("loaded", F.lit(0))
    status = (
        F.when(F.col("listed").isNull(), "unexpected")
        .when(F.col("listed") == rows, "loaded")
        .when(rows == 0, "missing")
        .otherwise("partial")
    )
    return both.withColumn("status", status).withColumn("loaded", rows)


def require_complete(reconciled):
    """Fails when any expected file is missing or any other one was loaded."""
    bad = (
        reconciled.filter(F.col("status") != "loaded")
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("files"), F.min(reconciled.columns[0]).alias("example"))
        .collect()
    )
    if bad:
        raise ValueError(f"files do not reconcile: {[tuple(row) for row in bad]}")
    return reconciled
