"""The weekly split and the allocation against plain Python."""

import calendar
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from mailgrid.plans import pieces
from mailgrid.schemas import ESTIMATES, GEO

MONTHS = [(2027, 2), (2026, 3), (2026, 6), (2024, 2), (2026, 1)]


def estimate(sender, product, monthly, year, month, province="P1"):
    day = dt.date(year, month, 1)
    return ("pk", day, 0, monthly, monthly, sender, product, province, dt.datetime(2026, 1, 1))


def split_in_python(monthly, year, month):
    weeks = calendar.monthcalendar(year, month)
    days = calendar.monthrange(year, month)[1]
    out = [int(round(monthly / days * sum(1 for d in w if d), 0)) for w in weeks[:-1]]
    return out + [monthly - sum(out)]


def test_weekly_split(spark):
    values = [*range(0, 60), 100, 333, 999, 12345, 10**9 + 7]
    data = [estimate(f"S{m}", "890", m, y, n) for m in values for y, n in MONTHS]
    found = {}
    for r in pieces.split_weekly(spark.createDataFrame(data, ESTIMATES)).collect():
        found.setdefault((r.sender, r.week.year, r.week.month), []).append((r.week_no, r.pieces))
    assert len(found) == len(data)
    for (sender, year, month), weeks in found.items():
        wanted = split_in_python(int(sender[1:]), year, month)
        assert [p for _, p in sorted(weeks)] == wanted


def test_tiny_estimates_break_conservation(spark, rows):
    df = spark.createDataFrame([estimate("S", "RS", 3, 2026, 6)], ESTIMATES)
    assert split_in_python(3, 2026, 6)[-1] < 0
    assert pieces.check_conservation(df).count() == 1


def test_rs_rows(spark, rows):
    data = [
        estimate("S1", "890", 60, 2026, 2), estimate("S1", "AR", 45, 2026, 2),
        estimate("S1", "AR", 49, 2026, 3), estimate("S2", "AR", 49, 2026, 2),
    ]
    rs = pieces.derive_rs(spark.createDataFrame(data, ESTIMATES)).filter("product = 'RS'")
    assert rows(rs, "pk", "monthly", "weekly", "original") == [
        ("S1~P1~RS", 0, 0, 0), ("S1~P1~RS", 2, 0, 0), ("S2~P1~RS", 0, 0, 0)]


def test_second_attempts(spark, rows):
    weekly = spark.createDataFrame([("a", 45), ("b", 19), ("c", 0), ("d", -5)], "key string, pieces bigint")
    assert rows(pieces.add_second_attempt(weekly)) == [
        ("a", 0, 45), ("a", 1, 2), ("b", 0, 19)]


def allocate_in_python(total, weights, whole):
    quota = {c: divmod(total * w, whole) for c, w in weights.items()}
    missing = total - sum(q for q, _ in quota.values())
    ranked = sorted(quota, key=lambda c: (-quota[c][1], c))
    out = {c: q for c, (q, _) in quota.items()}
    for code in ranked[: max(missing, 0)]:
        out[code] += 1
    return {c: n for c, n in out.items() if n}


def geo_rows(spark, shares, province="P1", pops=None):
    return spark.createDataFrame(
        [(c, "R", province, province, (pops or {}).get(c), s) for c, s in shares.items()], GEO)


def totals_frame(spark, totals, province="P1"):
    return spark.createDataFrame([(f"k{t}", province, t) for t in totals], "key string, province string, pieces bigint")


@pytest.mark.parametrize("scale", ["1", "0.9", "1.3", "tied", "tiny"])
def test_allocation_by_share(spark, scale):
    rng = random.Random(7)
    codes = [f"{i:05d}" for i in range(40)]
    if scale == "tied":
        shares = {c: Decimal("0.025") for c in codes}
    elif scale == "tiny":
        shares = {c: Decimal(1 if i else 999999961) / 10**9 for i, c in enumerate(codes)}
    else:
        raw = [rng.randrange(1, 1000) for _ in codes]
        shares = {c: (Decimal(r) / sum(raw) * Decimal(scale)).quantize(Decimal("1e-9")) for c, r in zip(codes, raw)}
    totals = [*range(1, 60), 500, 12345, 10**7, 5 * 10**10 + 3]
    out = pieces.allocate_largest_remainder(totals_frame(spark, totals), geo_rows(spark, shares))
    found = {}
    for r in out.collect():
        found.setdefault(r.pieces, {})[r.postal_code] = r.allocated
    weights = {c: int(s * 10**9) for c, s in shares.items()}
    for total in totals:
        assert found[total] == allocate_in_python(total, weights, 10**9)
        if sum(weights.values()) == 10**9:  # rounded shares may miss 1, then totals may differ
            assert sum(found[total].values()) == total


def test_allocation_by_population_is_exact(spark):
    rng = random.Random(3)
    pops = {f"{i:05d}": rng.randrange(1, 10**6) for i in range(57)}
    geo = geo_rows(spark, {c: Decimal(0) for c in pops}, pops=pops)
    totals = [1, 2, 7, 56, 57, 58, 1000, 999983, 10**12 + 7]
    out = pieces.allocate_largest_remainder(totals_frame(spark, totals), geo, "pop")
    found = {}
    for r in out.collect():
        found.setdefault(r.pieces, {})[r.postal_code] = r.allocated
    whole = sum(pops.values())
    for total in totals:
        assert found[total] == allocate_in_python(total, pops, whole)
        assert sum(found[total].values()) == total


def test_unknown_province_and_null_share_drop_out(spark):
    geo = geo_rows(spark, {"00001": None, "00002": Decimal("1")})
    weekly = totals_frame(spark, [5]).unionByName(totals_frame(spark, [5], "P9"))
    out = pieces.allocate_largest_remainder(weekly, geo).collect()
    assert [(r.province, r.postal_code, r.allocated) for r in out] == [("P1", "00002", 5)]


def test_pieces_have_stable_unique_ids(spark):
    geo = geo_rows(spark, {"00001": Decimal("0.7"), "00002": Decimal("0.3")})
    data = [estimate("S1", "890", 400, 2026, 2), estimate("S1", "AR", 77, 2026, 2)]
    allocated = pieces.generate_allocation(spark.createDataFrame(data, ESTIMATES), geo)
    out = pieces.explode_pieces(allocated)
    total = allocated.agg(F.sum("allocated")).first()[0]
    assert out.count() == total == out.select("request_id").distinct().count()
    again = pieces.explode_pieces(allocated.repartition(7))
    assert again.select("request_id").exceptAll(out.select("request_id")).isEmpty()
    labels = {str(r.week_label): r.pieces for r in pieces.week_buckets(out).collect()}
    assert min(labels) == "2026-02-02" and sum(labels.values()) == total


def test_of_month(spark):
    data = [estimate("S1", "AR", 5, 2026, 2), estimate("S1", "AR", 6, 2026, 3)]
    df = pieces.of_month(spark.createDataFrame(data, ESTIMATES), "2026-02")
    assert [r.monthly for r in df.collect()] == [5]


def test_placed_rows_unfold_where_they_lie(spark):
    """Only rows of very many pieces are moved, the others unfold in the task that has them."""
    df = spark.range(40, numPartitions=5).select(
        F.col("id").cast("string").alias("key"), F.lit("AR").alias("product"), F.lit("S").alias("sender"),
        F.lit("P").alias("province"), F.lit("00001").alias("postal_code"), F.lit(0).alias("attempt"),
        F.lit(dt.date(2026, 2, 2)).alias("week"),
        F.when(F.col("id") == 7, 5000).when(F.col("id") == 8, 0).otherwise(3).cast("bigint").alias("allocated"))
    out = pieces.explode_pieces(df, placed=True).withColumn("at", F.spark_partition_id())
    found = {}
    for r in out.select("request_id", "at").collect():
        found.setdefault(r.request_id.split("~")[0], []).append((int(r.request_id.split("~")[-1]), r["at"]))
    assert set(found) == {str(i) for i in range(40) if i != 8}
    for key, ids in found.items():
        assert sorted(n for n, _ in ids) == list(range(1, 5001 if key == "7" else 4))
        if key != "7":
            assert {at for _, at in ids} == {int(key) // 8}
    assert len({at for _, at in found["7"]}) > 1


def test_codes_that_come_twice_and_null_codes(spark):
    """Of equal codes one may win and the other not, as among any others."""
    codes = ["00003", "00003", None, "00001", "00001", "00002", "00002", None]
    data = [(c, "R", "P1", "P1", 5, Decimal("0.125")) for c in codes]
    geo = spark.createDataFrame(data, GEO)
    for weight in ("share", "pop"):
        out = pieces.allocate_largest_remainder(totals_frame(spark, [1, 3, 5, 8, 13]), geo, weight)
        found = {}
        for r in out.collect():
            found.setdefault(r.pieces, []).append((r.postal_code or "", r.allocated))
        for total, rows in found.items():
            ranked = sorted(c or "" for c in codes)
            wanted = [(c, total // 8 + (i < total % 8)) for i, c in enumerate(ranked)]
            assert sorted(rows) == sorted(w for w in wanted if w[1])
        assert set(found) == {1, 3, 5, 8, 13}


@pytest.mark.parametrize("by", [None, "key"])
def test_allocation_keeps_cuts_not_codes(spark, monkeypatch, by):
    """What is kept on storage grows with the demands, not with the codes they reach."""
    monkeypatch.setattr(pieces, "SORTED_CODES", 50)
    kept, keep = [], pieces.checkpointed

    def counted(df):
        out = keep(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(pieces, "checkpointed", counted)
    rng = random.Random(5)
    weights = {f"{i:05d}": rng.randrange(1, 10**6) for i in range(700)}
    geo = geo_rows(spark, {c: Decimal(w) / 10**9 for c, w in weights.items()}, pops=weights)
    totals = [3, 40, 600, 699, 12345]
    whole = sum(weights.values())
    out = pieces.allocate_largest_remainder(totals_frame(spark, totals), geo, "pop", by)
    found = {}
    for r in out.collect():
        found.setdefault(r.pieces, {})[r.postal_code] = r.allocated
    assert found == {t: allocate_in_python(t, weights, whole) for t in totals}
    assert max(kept) <= len(totals)
