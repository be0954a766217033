"""Tables stored in one folder per run or month, changed one partition at a time.

An upsert, a deletion or a dedup reads and replaces the partitions it concerns and leaves all
other files alone. The partition column has to follow from the key, as the month of a date in
the key or the run id does: then a row and its newer version lie in the same partition. New files
of a partition are written aside first and take the place of the old ones when the job is done.
"""

from pyspark.sql import functions as F

from mailgrid.operators.merge import merge_upsert
from mailgrid.operators.relational import counted_rows, hot_join
from mailgrid.session import checkpointed
from mailgrid.sources.files import path_exists


def store(df, path, by):
    """Writes a whole table with one folder for each value of ``by``."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def read_stored(spark, path, schema):
    """The stored table; the schema keeps the partition column's type."""
    return spark.read.schema(schema).parquet(path)


def replace_partitions(df, path, by):
    """Replaces the partitions the rows belong to; others keep their files."""
    writer = df.hint("rebalance", by).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def remove_partitions(values, path, by):
    """Deletes the folders of the partitions named by a frame's column ``by``.

    Only names of partitions come to the driver, as for any listing of the table.
    """
    spark = values.sparkSession
    for row in values.select(F.col(by).cast("string")).distinct().collect():
        name = "__HIVE_DEFAULT_PARTITION__" if row[0] is None else row[0]
        folder = f"{path}/{by}={name}"
        if path_exists(spark, folder):
            there = spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            files.delete(there, True)


def upsert_stored(delta, path, schema, keys, by, newer_by="updated_at"):
    """``merge_upsert`` into a stored table, in the partitions the delta names.

    The delta is kept first, as it is read several times. Its distinct partition values prune
    the scan of the table while the query runs. Rows without a partition value have a NULL key,
    which never matches: they are added beside what is there.
    """
    spark = delta.sparkSession
    delta = checkpointed(delta)
    known = delta.filter(F.col(by).isNotNull())
    table = read_stored(spark, path, schema)
    concerned = table.join(known.select(by).distinct(), by, "left_semi")
    replace_partitions(merge_upsert(concerned.select(*table.columns), known, keys, newer_by), path, by)
    nameless = delta.filter(F.col(by).isNull())
    aligned = table.limit(0).unionByName(nameless, allowMissingColumns=True)
    aligned.select(*table.columns).write.mode("append").partitionBy(by).parquet(path)


def delete_stored(path, runs, by="run_id"):
    """Deletes the runs' partitions; no row is read or rewritten."""
    remove_partitions(runs, path, by)


def drop_rows_stored(spark, path, schema, unwanted, by):
    """Deletes the rows a condition selects, rewriting only partitions that have some.

    A partition of which nothing is left is removed, as a write leaves it alone.
    """
    table = read_stored(spark, path, schema)
    hit = checkpointed(table.filter(unwanted).select(by).distinct())
    concerned = hot_join(table, hit, [by], "left_semi")
    left = checkpointed(concerned.filter(~F.coalesce(unwanted, F.lit(False))))
    emptied = hot_join(hit, left.select(by).distinct(), [by], "left_anti")
    replace_partitions(left.select(*table.columns), path, by)
    remove_partitions(emptied, path, by)


def clear_staging(spark, path):
    """Empties a stored staging table once it is merged; its columns stay."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def merge_staged(spark, staging, path, schema, keys, by, message):
    """The weekly load: upserts a staging table into the stored one, then empties it.

    An empty staging table is an error; it is counted by the job that reads it, and nothing is
    changed then.
    """
    delta = counted_rows(spark.read.parquet(staging), message)
    upsert_stored(delta, path, schema, keys, by)
    clear_staging(spark, staging)
