"""Capacities a user typed in: reading, open-ended tail rows, applying them to a run."""

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.functions import columns as fn
from mailgrid.operators.relational import (
    conform,
    hot_join,
    matched_keys,
    new_keys,
    pick_one,
    stamp,
)
from mailgrid.plans.capacity import rs_capacity
from mailgrid.session import checkpointed

ROW_KEYS = ["run_id", "courier", "province", "from_ts"]
TAIL_KEYS = ["run_id", "courier", "region", "province"]


def load_overrides(documents):
    """Rows of the documents ``{courier: [row, ...]}`` of each run, typed, with their position.

    Adds the real and the base capacity of the row, which the tail rows need.
    """
    fields = ", ".join(": ".join(f.split(" ")) for f in schemas.OVERRIDE_ROW.split(", "))
    body = F.from_json("body", f"map<string, array<struct<{fields}>>>", {"mode": "FAILFAST"})
    flat = (
        documents.select("run_id", F.explode(body).alias("courier", "_rows"))
        .select("run_id", "courier", F.posexplode("_rows").alias("position", "r"))
        .select("run_id", "courier", "position", "r.*")
    )
    flags = fn.label_to_flags("product")
    return flat.select(
        "run_id",
        "courier",
        "position",
        cal.midnight(fn.parse_dmy("inizioPeriodoValidita")).alias("from_ts"),
        (
            cal.midnight(fn.parse_dmy("finePeriodoValidita")) + F.expr("interval 86399 seconds")
        ).alias("to_ts"),
        F.col("capacita").cast("bigint").alias("capacity"),
        F.col("postalizzazioni_mensili").cast("bigint").alias("sum_monthly"),
        F.col("postalizzazioni_settimanali").cast("bigint").alias("sum_weekly"),
        F.col("regione").alias("region"),
        F.col("cod_sigla_provincia").alias("province"),
        flags["p890"].alias("p890"),
        flags["p_ar"].alias("p_ar"),
        fn.flag_text("flag_default").alias("is_default"),
        F.col("capacita_reale").cast("bigint").alias("real_capacity"),
        F.col("capacita_bau_originale").cast("bigint").alias("base_capacity"),
    )


def append_tails(overrides, capacity_type, updated_at):
    """One open-ended row per courier, region and province of a run.

    It starts a week after the last row, whose estimates and flags it carries, and has the real
    capacity of the first row (the base capacity in a mixed run). ``capacity_type`` is a column
    of the overrides or a literal column.
    """
    kind = fn.as_col(capacity_type)
    first = F.struct("from_ts", "position")
    last = F.struct("from_ts", "position")
    tails = (
        overrides.withColumn("_kind", kind)
        .groupBy(*TAIL_KEYS)
        .agg(
            F.min_by(F.struct("real_capacity", "base_capacity"), first).alias("_first"),
            F.max_by(F.struct("from_ts", "sum_monthly", "sum_weekly", "p890", "p_ar"), last).alias(
                "_last"
            ),
            F.max("_kind").alias("_kind"),
        )
    )
    mixed = F.col("_kind").eqNullSafe(schemas.CAPACITY_MIXED)
    rows = tails.select(
        *TAIL_KEYS,
        "_last.sum_monthly",
        "_last.sum_weekly",
        "_last.p890",
        "_last.p_ar",
        cal.window_end("_last.from_ts", "next_week").alias("from_ts"),
        F.lit(None).alias("to_ts"),
        F.when(mixed, F.col("_first.base_capacity"))
        .otherwise(F.col("_first.real_capacity"))
        .alias("capacity"),
        (~F.col("_kind").eqNullSafe(schemas.CAPACITY_PEAK)).alias("is_default"),
    )
    return conform(stamp(rows, updated_at=updated_at), schemas.RUN_CAPACITY)


def insert_overrides(overrides, capacity_type, updated_at):
    """Capacities of a new run: the typed rows and their tails."""
    rows = conform(stamp(overrides, updated_at=updated_at), schemas.RUN_CAPACITY)
    return rows.unionByName(append_tails(overrides, capacity_type, updated_at))


def apply_overrides(run_capacity, overrides, capacity_type, updated_at):
    """Capacities of edited runs.

    Old open-ended rows of these runs go. A row with the courier, province and start of a typed
    row takes its capacity and flag, other rows stay as they are, and typed rows without such a
    partner are added with a weekly estimate of 0, as are the new tails. Of typed rows with the
    same key the last one counts.

    The typed rows are kept once they are parsed. The stored capacities are read twice, the
    second time only their keys: a full outer join would read them once, but could neither
    leave them where they are nor split a frequent key.
    """
    overrides = checkpointed(overrides.withColumn("_kind", fn.as_col(capacity_type)))
    edited = overrides.select("run_id").distinct().withColumn("_edited", F.lit(True))
    old = (
        run_capacity.join(edited, "run_id", "left")
        .filter(F.col("to_ts").isNotNull() | F.col("_edited").isNull())
        .drop("_edited")
    )
    typed = checkpointed(pick_one(overrides.drop("_kind"), ROW_KEYS, [F.col("position").desc()]))
    fresh = typed.select(
        *ROW_KEYS,
        F.col("capacity").alias("_capacity"),
        F.col("is_default").alias("_is_default"),
        F.lit(True).alias("_hit"),
    )
    taken = {"capacity": F.col("_capacity"), "is_default": F.col("_is_default")}
    kept = hot_join(old, fresh, ROW_KEYS, "left").select(
        *[
            F.when(F.col("_hit"), taken[c]).otherwise(F.col(c)).alias(c) if c in taken else F.col(c)
            for c in run_capacity.columns
        ]
    )
    added = new_keys(typed, matched_keys(old, typed, ROW_KEYS), ROW_KEYS)
    added = added.withColumn("sum_weekly", F.lit(0))
    added = conform(stamp(added, updated_at=updated_at), schemas.RUN_CAPACITY)
    tails = append_tails(overrides, "_kind", updated_at)
    return kept.unionByName(added).unionByName(tails)


def save_run_capacity(run_capacity, overrides, declared, runs, updated_at):
    """Run capacities after the user saved the runs of ``overrides``.

    A run that has capacities with an end gets its typed rows applied to them, any other run
    has them inserted. Both then get the open-ended rows of their RS capacities back, from the
    run's month and with the capacity of its type.
    """
    kinds = runs.select("run_id", "capacity_type")
    typed = checkpointed(overrides.join(kinds, "run_id"))
    stored = run_capacity.filter(F.col("to_ts").isNotNull()).select("run_id").distinct()
    changed = typed.join(stored, "run_id", "left_semi")
    new = typed.join(stored, "run_id", "left_anti")
    saved = typed.select("run_id").distinct()
    rs = rs_capacity(declared, runs.join(saved, "run_id", "left_semi"), updated_at)
    return (
        apply_overrides(run_capacity, changed, "capacity_type", updated_at)
        .unionByName(insert_overrides(new, "capacity_type", updated_at))
        .unionByName(rs)
    )
