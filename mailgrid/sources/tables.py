"""Relational and columnar tables."""

import os


def read_table(spark, source, name, where=None):
    """Reads a table from JDBC or from a folder of parquet tables.

    ``source`` is a folder, or a dict of JDBC options (url, user, password, driver; with
    partitionColumn, lowerBound, upperBound and numPartitions the read is parallel). The
    ``where`` column is pushed down to either.
    """
    if isinstance(source, dict):
        df = spark.read.format("jdbc").options(**source).option("dbtable", name).load()
    else:
        df = spark.read.parquet(os.path.join(source, f"{name}.parquet"))
    return df if where is None else df.filter(where)


def append_table(df, target, name):
    """Appends to a JDBC table or to a parquet table folder."""
    if isinstance(target, dict):
        df.write.format("jdbc").options(**target).option("dbtable", name).mode("append").save()
    else:
        df.write.mode("append").parquet(os.path.join(target, f"{name}.parquet"))


def reload_dim(spark, csv_path, target, name, schema):
    """Replaces a reference table by the rows of a CSV file with a header."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(csv_path)
    if isinstance(target, dict):
        writer = df.write.format("jdbc").options(**target).option("dbtable", name)
        writer.option("truncate", True).mode("overwrite").save()
    else:
        df.write.mode("overwrite").parquet(os.path.join(target, f"{name}.parquet"))
    return df
