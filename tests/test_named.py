"""Views by name: conditions of SQL users reach the scans."""

from mailgrid.checks.fixtures import Fixtures
from mailgrid.plans import named


def test_conditions_on_views_reach_the_scans(spark, testdata):
    fx = Fixtures(spark, testdata)
    names = named.register_views({n: getattr(fx, n)() for n in named.TABLES}, prefix="plan_")
    assert len(names) == 8 and all(spark.catalog.tableExists(n) for n in names)
    for name, scans in [
        ("peak_table", 2), ("peak_map", 2), ("modified_capacity_setting", 1),
        ("sender_summary", 2), ("courier_summary", 2),
    ]:
        df = spark.sql(f"select * from plan_{name} where run_id = 19961")
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("EqualTo(run_id,19961)") >= scans, name
    narrow = spark.sql("select sender from plan_sender_view where product = 'AR'")
    text = narrow._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product,AR)" in text and "original" not in text
