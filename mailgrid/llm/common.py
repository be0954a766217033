"""Helpers the operators share: free column names, samples, text batches."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F


def reachable(spark):
    """Lets Python workers import this package where only the driver's own search path has it.

    On a cluster the package is installed or shipped with --py-files; then nothing changes.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    own = spark.sparkContext.environment
    if root not in known and root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [own.get("PYTHONPATH"), root]))


def table(spark, folder, name):
    reachable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df, stem):
    """A column name that the frame does not have yet, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def key_remainder(column, n):
    """crc32 of the key as text, modulo n; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_pieces(column, limit=1 << 19):
    """Cuts an Arrow string column into runs of whole texts of about ``limit`` bytes.

    Yields (first row, bytes as uint8, bounds): text i of the run lies in
    bytes[bounds[i]:bounds[i + 1]]. NULL is an empty text; one longer text is a run of its own.
    """
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, whole[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def remove_folder(spark, path):
    """Deletes a folder on whatever storage it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def smallest_by_hash(keyed, key, group, most):
    """A sample of at most ``most`` keys of each group, a column or a literal: the first by a
    hash of the key, so it is bounded and does not depend on how the rows are stored.

    Only rows whose hash lies so low that about twice as many keys are expected in the group are
    shuffled and ranked, once for each key, so what meets in one task is bounded, too. The sizes
    of the groups are broadcast: the sample has a place for each group as well.
    """
    span = 1 << 30
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(span))
    sizes = keyed.groupBy(F.col(group).alias("_group")).agg(
        F.approx_count_distinct(key).alias("_rows")
    )
    low = keyed.withColumn("_place", place).join(
        F.broadcast(sizes), F.col(group) == F.col("_group")
    )
    low = low.filter(F.col("_place") * F.col("_rows") <= F.lit(2 * most * span))
    ranked = Window.partitionBy("_group").orderBy("_place", key)
    return (
        low.dropDuplicates([key, "_group"])
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= most)
        .drop("_place", "_group", "_rows", "_rank")
    )


def labelled_sample(docs, labels, label, key, text, learn, most):
    """(text, label) of a bounded sample: at most ``most[value]`` documents of each label 0 and
    1 that ``learn``, a condition on the key, admits. Contradicting labels of a key count by
    their mean; NULL keys and labels are left out."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & learn)
        .groupBy(key)
        .agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    )
    picked = smallest_by_hash(known.filter("_label = 0"), key, "_label", most[0]).unionByName(
        smallest_by_hash(known.filter("_label = 1"), key, "_label", most[1])
    )
    # At most sum(most) rows, so a broadcast has a fixed bound.
    texts = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), F.col("_key") == F.col(key))
    # A key that comes with several texts counts once, with the least of them.
    return found.groupBy(F.col("_key").alias("key")).agg(
        F.min("text").alias("text"), F.max("_label").alias("label")
    )
