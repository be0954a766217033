"""Connected components of an edge table, by alternating large and small stars."""

from pyspark.sql import functions as F

from mailgrid.operators.relational import hot_join
from mailgrid.session import checkpointed

# Rows of a table that are worth a task. A round has about ten shuffles, so with a task for each
# shuffle partition the files and the bookkeeping of a small table outgrow its rows.
ROWS = 1000


def _state(edges):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges):
    """(node, root) of every node of the edges (a, b); the root is the smallest node.

    Each round joins neighbours to the smallest one they have (first among larger nodes, then
    among smaller ones), which halves the depth of the trees; the table never has more rows
    than the edges. Minima combine before the shuffle, and a hub's rows can be split. A table of
    few rows goes to few tasks; one of many keeps all tasks the session gives it.
    """
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    before = None
    while (now := _state(edges)) != before:
        before, tasks = now, 1 + now[0] // ROWS
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        low = low.coalesce(tasks)
        large = (
            hot_join(both.filter("b > a"), low, ["a"])
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        small_low = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        joined = hot_join(large, small_low, ["a"])
        edges = checkpointed(
            joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(small_low.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
    roots = edges.select("b").distinct().coalesce(tasks)
    roots = roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
