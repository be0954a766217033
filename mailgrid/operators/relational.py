"""Projections, keyed picks and group facts.

Group steps are written so that one key may hold a large part of the rows: aggregates combine
before the shuffle, ``row_number() <= k`` is limited per task before the shuffle, and a group
fact of large groups is joined back (AQE splits the large side) instead of being computed in a
window that would hold the whole group.
"""

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailgrid.functions.columns import as_col
from mailgrid.session import checkpointed


def hot_join(left, right, keys, how="inner", nulls=False):
    """Equi-join in which AQE can split the left rows of a frequent key.

    AQE only splits a join whose inputs both come straight from a shuffle. A right side that is
    grouped by the keys already would not be shuffled again, so the join also compares a hash of
    the keys: that makes it shuffle both sides. Small right sides are broadcast all the same.
    With ``nulls`` a NULL key equals NULL; the keys of the left side stay.
    """
    mark = F.xxhash64(*[F.col(k) for k in keys])
    left, right = left.withColumn("_hash", mark), right.withColumn("_hash", mark)
    if not nulls:
        return left.join(right, [*keys, "_hash"], how).drop("_hash")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in [*keys, "_hash"]})
    same = F.col("_hash") == F.col("_right__hash")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    joined = left.join(renamed, same, how)
    return joined.drop("_hash", "_right__hash", *[f"_right_{k}" for k in keys])


# --- projections ---------------------------------------------------------------------------


def conform(df, schema, mapping=None):
    """Renames by ``mapping`` (old to new), then keeps the schema's columns in its types."""
    renamed = df.withColumnsRenamed(mapping or {})
    fields = StructType.fromDDL(schema).fields
    return renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def stamp(df, run_id=None, updated_at=None):
    """Adds the run id and the load timestamp; the timestamp is given, so reruns agree."""
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
    if updated_at is not None:
        df = df.withColumn("updated_at", F.lit(updated_at).cast("timestamp_ntz"))
    return df


def series_for(df, **members):
    """Rows whose columns equal the value, are in the list, or in the frame's column of the same
    name, given for each; an empty list or frame selects nothing."""
    for name, wanted in members.items():
        if isinstance(wanted, DataFrame):
            df = hot_join(df, wanted.select(name).distinct(), [name], "left_semi")
        elif isinstance(wanted, (list, tuple, set)):
            df = df.filter(F.col(name).isin(list(wanted)) if wanted else F.lit(False))
        else:
            df = df.filter(F.col(name) == wanted)
    return df


def spread_rows(df):
    """The rows dealt over all tasks, for steps that turn a row into many.

    The number of tasks is given, because AQE merges partitions by the bytes it sees, not by
    the rows they turn into.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *df.columns)


def repeat_rows(df, n, chunk=1000, ordinal="ordinal", by=None, shares=8, placed=False):
    """One row per unit of ``n``, numbered from 1; rows with ``n`` below 1 disappear.

    Every row is first cut into chunks, which are spread over the tasks, so no task unfolds a
    huge row alone and no array grows past ``chunk`` entries. The number of tasks is given,
    because AQE would merge the chunks again: it sees their few bytes, not the rows they turn
    into. With ``by`` the chunks of each value of that column go to at most ``shares`` tasks, so
    that a task has few values and its rows can be written without another shuffle.

    Rows that all tasks have their part of already are ``placed``: they unfold where they are,
    and only those of more than ``chunk`` units are moved. The frame is then read twice, so its
    rows must be the same each time.
    """
    if placed:
        units = as_col(n).cast("bigint")
        few = df.filter((units >= 1) & (units <= chunk)).withColumn(
            ordinal, F.explode(F.sequence(F.lit(1).cast("bigint"), units))
        )
        many = repeat_rows(df.filter(units > chunk), n, chunk, ordinal, by, shares)
        return few.unionByName(many)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [*df.columns, "_from"]
    if by:
        place = [by, F.pmod(F.xxhash64(*place), F.lit(shares))]
    n, one = as_col(n).cast("bigint"), F.lit(1).cast("bigint")
    start = F.sequence(one, n, F.lit(chunk).cast("bigint"))
    return (
        df.filter(n >= 1)
        .withColumn("_from", F.explode(start))
        .repartition(tasks, *place)
        .withColumn(
            ordinal, F.explode(F.sequence("_from", F.least(n, F.col("_from") + chunk - 1)))
        )
        .drop("_from")
    )


# --- keyed picks ---------------------------------------------------------------------------


def first_by(df, keys, order, n=1):
    """The first ``n`` rows of each key in the given order."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= n).drop("_rn")


def pick_one(df, keys, order=None):
    """One row per key; without an order all other columns decide, so the pick is stable."""
    rest = [F.col(c) for c in df.columns if c not in keys]
    return first_by(df, keys, list(order or []) + rest or [F.lit(1)])


def dedup_latest(df, keys, newest=(), then=()):
    """Keeps the newest row of each key: ``newest`` columns descending with NULL last, then
    the ``then`` columns, then all remaining ones, so that exactly one row always wins."""
    order = [F.col(c).desc_nulls_last() for c in newest] + [F.col(c) for c in then]
    return pick_one(df, keys, order)


def distinct_values(df, *cols):
    return df.select(*cols).distinct()


def new_keys(source, target, keys):
    """Source rows whose key the target does not have; NULL keys are always new."""
    return hot_join(source, target.select(*keys).distinct(), keys, "left_anti")


def matched_keys(target, source, keys):
    """Keys of the target rows that have a partner in the source, once or more often.

    The rebalance after the join leaves AQE free to split a hot key of the target; a distinct
    right behind the join would tie each key to one task.
    """
    found = hot_join(target.select(*keys), source.select(*keys), keys, "left_semi")
    return found.hint("rebalance")


def require_rows(df, message):
    """Fails when the frame is empty, else returns it; for frames that are stored already."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def counted_rows(df, message):
    """The rows, kept on storage; fails when there are none.

    The rows are counted by the job that keeps them, so the frame's plan runs once, however
    often the result is read.
    """
    seen = Observation()
    kept = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    if not seen.get["rows"]:
        raise ValueError(message)
    return kept


# --- group facts ---------------------------------------------------------------------------


def distinct_by(df, keys, member, name="count_request"):
    """Exact number of distinct members per key. A member is one column or a list of columns;
    rows with a NULL in one of them do not count.

    If the rows are partitioned by one of the columns already, as after a join on it, they are
    not shuffled again.
    """
    members = [member] if isinstance(member, str) else list(member)
    return df.groupBy(*keys).agg(F.count_distinct(*members).alias(name))


def max_over_group(df, keys, value, name):
    """Adds the group's maximum to each row; rows with a NULL key get NULL.

    One scan and one shuffle; for groups of a few rows, which share a task.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.withColumn(name, F.when(complete, F.max(value).over(Window.partitionBy(*keys))))


def count_over_group(df, keys, name):
    """Adds the number of rows of the group; NULL keys form a group of their own."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    facts = sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(facts, same).drop(*[f"_{k}" for k in keys])


def any_flag(df, keys, flag, name):
    """1 when any row of the group has the flag set, else 0."""
    return df.groupBy(*keys).agg(F.max(F.coalesce(flag.cast("int"), F.lit(0))).alias(name))


def classify_flags(df, keys, flag="is_default", name="flag_class"):
    """'all' when every flag of the group is true, 'none' when every one is false, else
    'mixed'; a NULL flag makes a group mixed."""
    true = F.count_if(F.col(flag))
    false = F.count_if(~F.col(flag))
    rows = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.when(rows == true, "all").when(rows == false, "none").otherwise("mixed").alias(name)
    )


def number_in_groups(df, keys, order, name):
    """Adds the row's number in its group, from 1, in the given order, which must be total.

    No group is held by one task: the rows are range-partitioned by keys and order and kept, so
    a group is a stretch of one or more partitions. Only the sizes of the stretches, one row
    per group and partition it touches, are added up and joined back by partition number.
    NULL keys form a group of their own.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    # The upper bits of this id are the partition, the lower 33 the place in it.
    placed = checkpointed(
        df.repartitionByRange(tasks, *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33).cast("int"))
    )
    stretches = placed.groupBy(*keys, "_part").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    if keys:
        earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1
        )
        before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
        shifts = stretches.select(*keys, "_part", (before - F.col("_first") + 1).alias("_shift"))
    else:
        shifts = _running_shifts(stretches)
    numbered = hot_join(placed, shifts, [*keys, "_part"], nulls=True)
    return numbered.withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)


def _running_shifts(stretches):
    """The shift of each partition, as a table; of the rows, one number per task is added up."""
    shifts, total = [], 0
    for part, first, rows in stretches.orderBy("_part").collect():
        shifts.append((part, total - first + 1))
        total += rows
    return stretches.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")


def with_row_id(df, order, name="id"):
    """Consecutive ids over the whole frame in the given order, which must be total.

    The shifts are joined by partition number, so the plan does not grow with the partitions.
    """
    return number_in_groups(df, [], [as_col(c) for c in order], name)


def week_ordinal(results, keys, name="week_no"):
    """Number of a result row's week inside its series, which has a few weeks."""
    series = Window.partitionBy(*keys).orderBy("week", "count_request")
    return results.withColumn(name, F.row_number().over(series))


def sum_first_weeks(results, keys, n, name):
    """Sum of the first n present weeks; only n rows per task and series are shuffled."""
    head = first_by(results, keys, [F.col("week"), F.col("count_request")], n)
    return head.groupBy(*keys).agg(F.sum("count_request").alias(name))
