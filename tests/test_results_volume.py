"""Results counted from the lines as they lie, without a stored or shuffled copy of all pieces."""

import os
import re

import pytest
from pyspark.sql import functions as F

from mailgrid.checks import fixtures
from mailgrid.checks.fixtures import TABLES, Fixtures
from mailgrid.plans import results


@pytest.fixture(scope="module")
def repeated(spark, testdata, tmp_path_factory):
    """The test tables; lines come twice or without a number."""
    folder = str(tmp_path_factory.mktemp("tables"))
    for name in ("region", "nation", "customer", "supplier", "orders"):
        os.symlink(f"{testdata}/{name}.parquet", f"{folder}/{name}.parquet")
    lines = spark.read.schema(TABLES["lineitem"]).parquet(f"{testdata}/lineitem.parquet")
    none = lines.filter("l_linenumber = 1").withColumn("l_linenumber", F.lit(None).cast("int"))
    again = lines.filter("l_orderkey % 3 = 0")
    lines.unionByName(again).unionByName(none).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_results_store_no_pieces_and_count_the_same(spark, repeated, rows):
    fx = Fixtures(spark, repeated)
    couriers, senders = fx.courier_results(), fx.sender_results()
    stored = {name for _, folder, name in fixtures._STORED if folder == repeated}
    assert stored == {"courier_results", "sender_results"}
    assert rows(couriers) == rows(results.results_by_courier(fx.pieces(), fx.geo()))
    assert rows(senders) == rows(results.results_by_sender(fx.pieces()))
    total = couriers.agg(F.sum("count_request")).first()[0]
    assert total < fx.pieces().filter("workflow_step = 'EVALUATE_PRINT_CAPACITY'").count()


def test_lines_are_shuffled_once(spark, repeated):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        counts = results.results_by_sender(
            Fixtures(spark, repeated)._shipped(), fixtures.REQUEST
        )
        plan = counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    shuffles = re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)
    by = [[re.sub(r"#\d+.*", "", c) for c in s.split(", ")] for s in shuffles]
    assert sum(s == ["l_orderkey"] for s in by) == 1
    assert not any("line" in s or "request_id" in s for s in by)
