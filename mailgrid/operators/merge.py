"""Table maintenance as functions from the old table to the new one.

Nothing is updated in place: the caller writes the new table to a new folder.
"""

from functools import reduce

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.operators.relational import (
    counted_rows,
    dedup_latest,
    hot_join,
    matched_keys,
    new_keys,
)


def merge_upsert(target, source, keys, newer_by="updated_at"):
    """Updates target rows from a newer source row of the same key and inserts new keys.

    Keys are compared with ``=``: a row with a NULL key never matches and is inserted. Equal or
    NULL timestamps keep the target row, and a key repeated in the target updates every copy. A
    source key that comes more than once counts with its newest row.

    The large side is the target. It only takes part in a left join with the source and in a
    semi join on its key columns, so with a small source it is never shuffled, and otherwise
    AQE can split its hot keys (a full outer join could not be split).
    """
    source = source.select(*[c for c in target.columns if c in source.columns])
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    unmatchable = source.filter(~complete)
    once = dedup_latest(source.filter(complete), keys, [newer_by])

    values = [c for c in source.columns if c not in keys]
    fresh = once.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    newer = F.col(f"_{newer_by}") > F.col(newer_by)
    kept = hot_join(target, fresh, keys, "left").select(
        *[
            F.when(newer, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in target.columns
        ]
    )
    added = new_keys(once, matched_keys(target, once, keys), keys)
    return kept.unionByName(added, allowMissingColumns=True).unionByName(
        unmatchable, allowMissingColumns=True
    )


def merge_estimates(target, delta):
    return merge_upsert(target, delta, schemas.ESTIMATE_KEYS)


def merge_declared(target, delta):
    return merge_upsert(target, delta, schemas.DECLARED_KEYS)


def merge_run_capacity(target, delta):
    return merge_upsert(target, delta, schemas.RUN_CAPACITY_KEYS)


def guarded_merge(target, delta, keys, message):
    """The upsert of a weekly load: an empty delta is an error. The delta's plan runs once."""
    return merge_upsert(target, counted_rows(delta, message), keys)


def dedup_declared(declared):
    return dedup_latest(declared, schemas.DECLARED_KEYS, ["updated_at", "created_at"])


def dedup_estimates(estimates):
    return dedup_latest(estimates, schemas.ESTIMATE_KEYS, ["updated_at"])


def dedup_results(results, keys):
    """One row per result key; copies differ at most in their count, the largest stays."""
    return dedup_latest(results, keys, ["count_request"])


def drop_open_ended(run_capacity, run_id=None):
    """Removes capacities without an end, of one run or of all."""
    open_ended = F.col("to_ts").isNull()
    if run_id is not None:
        open_ended = open_ended & F.col("run_id").eqNullSafe(F.lit(run_id))
    return run_capacity.filter(~open_ended)


def truncate_staging(df):
    """The empty frame that replaces a staging frame once it is merged; a stored staging table
    is emptied by ``sources.stored.clear_staging``."""
    return df.filter(F.lit(False))


def delete_run(tables, run_id):
    """The tables without the run's rows, by table name."""
    return {
        name: df.filter(~F.col("run_id").eqNullSafe(F.lit(run_id))) for name, df in tables.items()
    }


def delete_runs(df, runs):
    """The table without the rows of the given runs."""
    return hot_join(df, runs.select("run_id").distinct(), ["run_id"], "left_anti")


def effective_status(runs, now):
    """Status shown to users: running for over two days means incomplete, and a scheduled run
    whose time has come is running. The first rule is applied first."""
    now = F.lit(now).cast("timestamp_ntz")
    stale = (F.col("status") == schemas.STATUS_RUNNING) & (
        F.col("executed_at") < now - F.expr("interval 2 days")
    )
    due = (
        (F.col("status") == schemas.STATUS_SCHEDULED)
        & (F.col("trigger") == schemas.TRIGGER_SCHEDULE)
        & (F.col("executed_at") <= now)
    )
    shown = (
        F.when(stale, schemas.STATUS_INCOMPLETE)
        .when(due, schemas.STATUS_RUNNING)
        .otherwise(F.col("status"))
    )
    return runs.withColumn("shown_status", shown)
