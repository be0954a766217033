"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters (Spark's ``approx_top_k``, which keeps a bounded number of them per task
and merges them) name every digest that may hold a notable share of the rows. Their true sizes
and winners are then computed exactly and broadcast: at most ``counters`` rows, so rows of a
frequent digest are settled where they are read and never meet in one task. All other digests
are shuffled the ordinary way; each holds less than about rows / ``tracked``.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailgrid.llm.common import fresh
from mailgrid.session import checkpointed


def normalized(text):
    """Runs of the six ASCII white space characters become one space; NULL the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digest(text):
    return F.sha2(normalized(text), 256)


def frequent_winners(keyed, value, order, counters, tracked):
    """The frequent values of a column with their exact size and first row by ``order``."""
    guess = keyed.agg(F.expr(f"approx_top_k(`{value}`, {counters}, {tracked})").alias("_top"))
    named = guess.select(F.explode("_top.item").alias("_name"))
    rows = keyed.join(F.broadcast(named), keyed[value] == named["_name"])
    exact = rows.groupBy(F.col("_name")).agg(
        F.count(F.lit(1)).alias("_size"), F.min(order).alias("_first")
    )
    return checkpointed(exact.filter("_size > 1"))


def exact_duplicates(docs, key="doc_id", text="text", counters=256, tracked=8192):
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space became one
    space; NULL counts as empty. Of equal texts the smallest key stays; NULL keys come last.
    Of repeated rows (same key, same text) exactly one stays. Without rows the result is empty.
    """
    keyed = checkpointed(
        docs.select(
            F.col(key).alias("_id"),
            digest(F.col(text).cast("string")).alias("_digest"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), "_row")
    winners = frequent_winners(keyed, "_digest", order, counters, tracked)
    split = keyed.join(F.broadcast(winners), F.col("_digest") == F.col("_name"), "left")
    heavy = split.filter(F.col("_size").isNotNull())
    same = Window.partitionBy("_digest")
    light = (
        split.filter(F.col("_size").isNull())
        .select("_id", "_digest", "_row")
        .withColumn("_size", F.count(F.lit(1)).over(same))
        .withColumn("_first", F.min(order).over(same))
    )
    wanted = [
        F.col("_id").alias(key),
        F.col("_first.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_first._row")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    ]
    return heavy.select(*wanted).unionByName(light.select(*wanted))


def drop_exact_duplicates(docs, key="doc_id", text="text", counters=256, tracked=8192):
    """The documents that stay, with all their columns; same rule as ``exact_duplicates``.

    Rows of frequent digests other than their winner are dropped before the shuffle.
    """
    name, size, first = (fresh(docs, n) for n in ("_name", "_size", "_first"))
    mark, null, number = (fresh(docs, n) for n in ("_digest", "_null", "_number"))
    keyed = docs.select(
        F.col(key).alias("_id"), digest(F.col(text).cast("string")).alias("_digest")
    )
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"))
    winners = frequent_winners(keyed, "_digest", order, counters, tracked).select(
        F.col("_name").alias(name), F.col("_size").alias(size), F.col("_first").alias(first)
    )
    marked = docs.withColumn(mark, digest(F.col(text).cast("string"))).join(
        F.broadcast(winners), F.col(mark) == F.col(name), "left"
    )
    left = marked.filter(F.col(size).isNull() | F.col(key).eqNullSafe(F.col(f"{first}.id")))
    best = Window.partitionBy(mark).orderBy(F.col(null), F.col(key))
    return (
        left.withColumn(null, F.col(key).isNull())
        .withColumn(number, F.row_number().over(best))
        .filter(F.col(number) == 1)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
