"""Planned and residual pieces of a run, counted per sender and per courier."""

from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import columns as fn
from mailgrid.operators.relational import distinct_by


def read_pieces(items, run_id=None):
    """Planned pieces from landed items, with the asked week in ``week`` and the run given or in
    ``run_id``."""
    run = F.col("run_id") if run_id is None else F.lit(run_id)
    return items.select(
        F.col("requestId").alias("request_id"),
        F.col("senderPaId").alias("sender"),
        "province",
        F.col("cap").alias("postal_code"),
        F.coalesce("unifiedDeliveryDriver", F.lit("")).alias("courier"),
        F.col("productType").alias("product"),
        F.col("workflowStep").alias("workflow_step"),
        "attempt",
        F.to_date("week").alias("week"),
        run.alias("run_id"),
    )


def planned(pieces):
    return pieces.filter(F.col("workflow_step") == schemas.STEP_PLANNED)


def residual(pieces, last_week_only=True):
    """Pieces left over; by default only those of each run's last week."""
    left = pieces.filter(F.col("workflow_step") == schemas.STEP_RESIDUAL)
    if not last_week_only:
        return left
    last = pieces.groupBy("run_id").agg(F.max("week").alias("week"))
    return left.join(last, ["run_id", "week"], "left_semi")


def province_region(geo):
    return geo.select("province", "region").distinct()


def _with_region(counts, geo):
    """Region and label per province: joined to the counts, not to the pieces."""
    return counts.join(province_region(geo), "province").withColumn("label", fn.series_label())


def results_by_sender(pieces, request="request_id"):
    """Planned pieces per run, sender and week; ``request`` names what tells requests apart."""
    return distinct_by(planned(pieces), schemas.SENDER_RESULT_KEYS, request)


def results_by_courier(pieces, geo, request="request_id"):
    """Planned pieces per run, province, courier and week; ``request`` names what tells requests
    apart."""
    counts = distinct_by(planned(pieces), ["run_id", "province", "courier", "week"], request)
    return _with_region(counts, geo).select(
        "run_id", "province", "region", "courier", "week", "label", "count_request"
    )


def residuals_by_sender(pieces):
    """Pieces left over per run and sender."""
    return distinct_by(residual(pieces), ["run_id", "sender"], "request_id", "count_residual")


def residuals_by_courier(pieces, geo):
    """Pieces left over per run, province and courier."""
    counts = distinct_by(
        residual(pieces), ["run_id", "province", "courier"], "request_id", "count_residual"
    )
    return _with_region(counts, geo).select(
        "run_id", "province", "region", "courier", "label", "count_residual"
    )
