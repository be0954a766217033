"""Sorted lists and top members of the run reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailgrid.operators.relational import first_by, hot_join


def _metric(metric, desc):
    col = F.col(metric)
    return col.desc_nulls_last() if desc else col.asc_nulls_last()


def rank_members(df, metric, desc=True, tie="sender"):
    """Members of each run with their position by a metric, those without a value last."""
    run = Window.partitionBy("run_id").orderBy(_metric(metric, desc), F.col(tie))
    return df.withColumn("position", F.row_number().over(run))


def top_members(summary, metric, n, desc=True, member="sender"):
    """The first n members of each run by a metric."""
    return first_by(summary, ["run_id"], [_metric(metric, desc), F.col(member)], n)


def top_series(results, summary, metric, n, desc=True, member="sender"):
    """Weekly series of the top members."""
    top = top_members(summary, metric, n, desc, member).select("run_id", member)
    return hot_join(results, top, ["run_id", member], "left_semi")


def first_members(df, n=5, member="sender"):
    """The first n member names of each run in alphabetical order."""
    return first_by(df.select("run_id", member).distinct(), ["run_id"], [F.col(member)], n)
