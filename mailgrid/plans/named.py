"""The reporting views by name, for SQL users.

Each view is a temporary view over a frame that nothing has computed yet, so a query on it is
planned with the view: its conditions, such as a run id, reach the scans of the tables below.
"""

from mailgrid.plans import views

# Tables the views are made of.
TABLES = [
    "declared", "estimates", "geo", "run_capacity", "runs", "courier_results", "sender_results",
    "courier_residuals", "sender_residuals",
]


def view_frames(tables):
    """The views by name; ``tables`` has a frame for each name of ``TABLES``."""
    t = tables
    setting = views.capacity_setting(t["declared"], t["estimates"], t["geo"])
    peaks = views.peak_table(t["courier_results"], t["run_capacity"])
    return {
        "capacity_setting": setting,
        "modified_capacity_setting": views.modified_capacity_setting(
            t["run_capacity"], t["runs"], setting
        ),
        "peak_table": peaks,
        "peak_map": views.peak_map(peaks),
        "sender_summary": views.sender_summary(t["sender_results"], t["sender_residuals"]),
        "courier_summary": views.courier_summary(t["courier_results"], t["courier_residuals"]),
        "sender_view": views.sender_view(t["estimates"], t["geo"]),
        "courier_view": views.courier_view(t["declared"], t["estimates"], t["geo"]),
    }


def register_views(tables, prefix=""):
    """Registers all views in the session of the tables; returns their names."""
    frames = view_frames(tables)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in frames]
