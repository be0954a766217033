"""From monthly estimates to individual mail pieces."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.functions import columns as fn
from mailgrid.operators.relational import (
    hot_join,
    number_in_groups,
    repeat_rows,
)
from mailgrid.session import checkpointed
from mailgrid.sources.files import piece_rows, write_by_week

# Units of a stored share, which has nine decimals.
SHARE_UNITS = 1_000_000_000
# An allocation depends on these alone.
DEMAND = ["province", "pieces"]
# Codes of one demand that a task sorts; remainders of larger demands are counted in buckets.
SORTED_CODES = 4096
REMAINDER_BUCKETS = 256
# Neighbouring ranks of a province's codes that a row is joined with at once.
RANK_BLOCK = 256
# Shares that rows are dealt into before they meet the codes.
ROW_SHARES = 8


def derive_rs(estimates, updated_at=None):
    """Adds an RS estimate per sender, province and month: one piece per 50 of all products."""
    month = cal.month_start("delivery_date")
    totals = estimates.groupBy("province", "sender", month.alias("_month")).agg(
        F.sum("monthly").alias("_total"),
        F.max("delivery_date").alias("delivery_date"),
        F.max("updated_at").alias("_seen"),
    )
    stamp = F.lit(updated_at).cast("timestamp_ntz") if updated_at else F.col("_seen")
    rs = totals.select(
        fn.compose_key("sender", "province", F.lit("RS")).alias("pk"),
        "delivery_date",
        F.lit(0).alias("weekly"),
        fn.pct_floor("_total", 50).alias("monthly"),
        F.lit(0).alias("original"),
        "sender",
        F.lit("RS").alias("product"),
        "province",
        stamp.alias("updated_at"),
    )
    return estimates.unionByName(rs)


def of_month(estimates, month):
    """Estimates of one 'yyyy-MM' month."""
    first = F.to_date(F.lit(f"{month}-01"))
    return estimates.filter(
        (F.col("delivery_date") >= first) & (F.col("delivery_date") < F.add_months(first, 1))
    )


def month_weeks(months, col="month"):
    """Weeks of each month: number, start inside the month, days in it, days of the month."""
    weeks = months.select(
        cal.month_start(col).alias("month"),
        cal.weeks_in_month(col).alias("_weeks"),
        F.explode(F.sequence(F.lit(1), cal.weeks_in_month(col))).alias("week_no"),
    )
    start, days = cal.week_in_month("month", F.col("week_no"))
    return weeks.select(
        "month",
        "week_no",
        start.alias("week_start"),
        days.alias("days"),
        (F.col("week_no") == F.col("_weeks")).alias("is_last"),
        cal.days_in_month("month").alias("days_in_month"),
    )


def split_weekly(estimates):
    """Splits each monthly estimate over the weeks of its month.

    A week gets its days' share, rounded half to even; the last week gets what is left, which
    can be zero or negative for tiny estimates. Between the first and the last week all have
    seven days, so the rest follows from two shares: each row is split where it is.
    """
    daily = F.col("monthly") / cal.days_in_month("delivery_date")
    weeks, number = F.col("_weeks"), F.col("week_no")
    rest = F.col("monthly") - F.col("_first") - (weeks - 2) * F.col("_full")
    start, _ = cal.week_in_month("delivery_date", number)
    return (
        estimates.withColumn("_weeks", cal.weeks_in_month("delivery_date"))
        .withColumn("_first", fn.half_even(daily * cal.first_week_days("delivery_date")))
        .withColumn("_full", fn.half_even(daily * 7))
        .withColumn("week_no", F.explode(F.sequence(F.lit(1), weeks)))
        .select(
            fn.compose_key("sender", "product", "province").alias("key"),
            "sender",
            "province",
            "product",
            "week_no",
            start.alias("week"),
            F.when(number == weeks, rest)
            .when(number == 1, F.col("_first"))
            .otherwise(F.col("_full"))
            .alias("pieces"),
        )
    )


def check_conservation(estimates):
    """Estimates whose weekly pieces do not add up, because the last week came out negative."""
    weekly = split_weekly(estimates).filter(F.col("pieces") < 0)
    return weekly.select("sender", "province", "product", "week", "pieces")


def add_second_attempt(weekly):
    """First attempts, and 5 % of them again as second attempts; empty rows are dropped."""
    attempts = F.array(
        F.struct(F.lit(0).alias("attempt"), F.col("pieces").alias("pieces")),
        F.struct(F.lit(1).alias("attempt"), fn.pct_floor("pieces", 20).alias("pieces")),
    )
    others = [c for c in weekly.columns if c != "pieces"]
    return (
        weekly.select(*others, F.explode(attempts).alias("a"))
        .select(*others, "a.attempt", "a.pieces")
        .filter(F.col("pieces") > 0)
    )


def weigh(geo, weight="share"):
    """Postal codes with whole-number weights and their rank by weight inside the province, and
    the provinces' totals.

    ``share`` weighs by the nine decimals of the stored share, ``pop`` by population. A province
    may hold any part of the codes: sums combine before the shuffle, ranks are spread.
    """
    value = F.col("pop") if weight == "pop" else F.col("share") * SHARE_UNITS
    weighed = geo.select(
        "province", "postal_code", value.cast("bigint").alias("w")
    ).filter(F.col("w").isNotNull())
    filled = F.sum("w").cast("bigint")
    whole = filled if weight == "pop" else F.lit(SHARE_UNITS).cast("bigint")
    totals = weighed.groupBy("province").agg(
        whole.alias("whole"), filled.alias("filled"), F.count(F.lit(1)).alias("codes")
    )
    ranked = number_in_groups(
        weighed, ["province"], [F.col("w").desc(), F.col("postal_code")], "place"
    )
    return ranked, totals


def meet_codes(rows, ranked, block, by=None):
    """Each row with the first ``_size`` codes of its province, and its quota of them: ``base``
    whole pieces and ``rest``, the remainder in parts of ``whole``.

    A row is repeated for each block of ranks it reaches and meets the codes of these blocks
    only, so that the pairs compared grow with the codes reached. What comes out is not moved:
    it lies where the blocks are, which a given number of tasks share. The first blocks of a
    province are reached by all its rows, so the rows are dealt into shares, and each share has
    its own copy of the codes. With ``by``, a column, the rows of a share have the same few values
    of it, and so has each task.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(*(rows.columns if by is None else [by])), F.lit(ROW_SHARES)).cast("int")
    blocks = F.explode(F.expr(f"sequence(0L, (_size - 1) div {block})"))
    codes = ranked.withColumn("_block", F.expr(f"(place - 1) div {block}"))

    def joined(some, right, keys):
        # A broadcast would tie the tasks to one side.
        right = right.repartition(tasks, *keys).hint("merge")
        return some.withColumn("_block", blocks).repartition(tasks, *keys).join(right, keys)

    if by is not None:
        rows = checkpointed(rows.withColumn("_share", dealt))
        shares = [rows.filter(F.col("_share") == share) for share in range(ROW_SHARES)]
        # The shares divide the tasks; a union of single partitions would be a single one.
        few = max(2, tasks // ROW_SHARES)
        met = reduce(
            DataFrame.union,
            [joined(some, codes, ["province", "_block"]).coalesce(few) for some in shares],
        )
    else:
        copies = codes.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(ROW_SHARES - 1))))
        keys = ["province", "_block", "_share"]
        met = joined(rows.withColumn("_share", dealt), copies, keys)
    return (
        met.filter(F.col("place") <= F.col("_size"))
        .withColumn("_part", F.expr("(pieces % whole) * w"))
        .withColumn("base", F.expr("(pieces div whole) * w + _part div whole"))
        .withColumn("rest", F.expr("_part % whole"))
        .drop("_block", "_share", "_part", "w")
    )


def _last_winner(ranked, rank):
    """The cut of each demand: its ranked codes' last winner."""
    return ranked.filter(rank).select(
        *DEMAND, "whole", "_size", "_left", F.col("rest").alias("_rest"),
        F.struct("postal_code", "place").alias("_last"),
    )


def by_remainder():
    """The order of winners; a code may come more than once, its places differ."""
    return [F.col("rest").desc(), F.col("postal_code"), F.col("place")]


def sorted_cuts(demand, ranked):
    """The cuts of demands whose codes a task can sort."""
    codes = meet_codes(demand, ranked, RANK_BLOCK)
    own = Window.partitionBy(*DEMAND)
    placed = codes.withColumn("_rank", F.row_number().over(own.orderBy(*by_remainder()))).withColumn(
        "_left", F.col("pieces") - F.sum("base").over(own)
    )
    return _last_winner(placed, F.col("_rank") == F.greatest(F.lit(1), F.least("_left", "_size")))


def selected_cuts(demand, ranked):
    """The cuts of demands of many codes.

    A selection, not a sort: remainders are counted in ``REMAINDER_BUCKETS`` buckets, the prefix
    sums of the counts tell the bucket the last winner lies in, and only that bucket's codes are
    ranked. So no demand is held by one task, however many codes it has. The codes are met again
    for the second step, which costs less than keeping them.
    """
    bucket = F.expr(f"cast(rest * {REMAINDER_BUCKETS}D / whole as int)")
    facts = [*DEMAND, "whole", "_size"]
    counts = (
        meet_codes(demand, ranked, SORTED_CODES)
        .groupBy(*facts, bucket.alias("_bucket"))
        .agg(F.count(F.lit(1)).alias("_codes"), F.sum("base").alias("_base"))
    )
    # At most REMAINDER_BUCKETS + 1 rows of each demand.
    own = Window.partitionBy(*DEMAND)
    larger = own.orderBy(F.col("_bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.greatest(F.lit(1), F.least("_left", "_size"))
    bounds = checkpointed(
        counts.withColumn("_left", F.col("pieces") - F.sum("_base").over(own))
        .withColumn("_rank", last - F.coalesce(F.sum("_codes").over(larger), F.lit(0)))
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_codes")))
        .select(*facts, "_left", "_bucket", "_codes", "_rank")
    )

    def of_bucket(some):
        return meet_codes(some, ranked, SORTED_CODES).filter(bucket == F.col("_bucket"))

    sortable = F.col("_codes") <= SORTED_CODES
    place = F.row_number().over(own.orderBy(*by_remainder()))
    few = of_bucket(bounds.filter(sortable)).withColumn("_at", place)
    many = number_in_groups(of_bucket(bounds.filter(~sortable)), DEMAND, by_remainder(), "_at")
    at = F.col("_at") == F.col("_rank")
    return _last_winner(few, at).unionByName(_last_winner(many, at))


def cut_offs(demand, ranked, totals):
    """What the largest remainders of each distinct (province, pieces) come down to: the number
    of codes it reaches, the pieces left for remainders and the last code that wins one.

    A code whose quota is below one piece can only win by its remainder, which then is the
    quota itself, so such codes win in order of weight. Hence with T pieces and weights that
    add up to the whole only the T heaviest codes can get anything; with weights that add up
    to more, only the first T * sum / whole.

    The cuts of a demand of at most ``SORTED_CODES`` codes are found by sorting them, those of
    larger ones by selection.
    """
    total = F.col("pieces")
    reach = F.greatest(total, F.ceil(total * (F.col("filled").cast("double") / F.col("whole"))))
    # Kept, as it is small beside the demand and read more than once.
    wanted = checkpointed(
        hot_join(demand.select(*DEMAND).distinct(), totals, ["province"])
        .withColumn("_size", F.least(reach, F.col("codes")))
        .filter(F.col("_size") >= 1)
        .select(*DEMAND, "whole", "_size")
    )
    sortable = F.col("_size") <= SORTED_CODES
    small, large = wanted.filter(sortable), wanted.filter(~sortable)
    return checkpointed(sorted_cuts(small, ranked).unionByName(selected_cuts(large, ranked)))


def allocation_table(demand, geo, weight="share"):
    """Largest-remainder shares of each distinct (province, pieces): one row per postal code
    that gets at least one piece."""
    return allocate_largest_remainder(demand.select(*DEMAND).distinct(), geo, weight)


def allocate_largest_remainder(weekly, geo, weight="share", by=None):
    """Allocates each weekly row's pieces to the postal codes of its province.

    The winners depend on the province and the number of pieces only, so the cut between them
    and the others is worked out once per distinct pair. A weekly row is joined with its cut and
    then meets the codes it reaches; the allocated rows, many times more, are not moved at all.
    Provinces without codes drop out. With ``by`` each task has few values of that column.

    Whole multiples of the weight total are taken out first: products stay below the square of
    the total and cannot overflow, however many pieces there are.
    """
    ranked, totals = weigh(geo, weight)
    # Shuffled: the weekly rows then spread over the tasks, and AQE splits frequent pairs.
    cuts = cut_offs(weekly, ranked, totals).hint("merge")
    met = meet_codes(hot_join(weekly, cuts, DEMAND), ranked, RANK_BLOCK, by)
    wins = F.when(F.col("rest") != F.col("_rest"), F.col("rest") > F.col("_rest")).otherwise(
        F.struct("postal_code", "place") <= F.col("_last")
    )
    others = [c for c in weekly.columns if c not in DEMAND]
    return (
        met.withColumn("allocated", F.col("base") + ((F.col("_left") > 0) & wins).cast("int"))
        .filter(F.col("allocated") > 0)
        .select(*DEMAND, *others, "postal_code", "allocated")
    )


def generate_allocation(estimates, geo, weight="share", by=None):
    """Estimates to weekly pieces per postal code: RS rows, weeks, second attempts, codes."""
    weekly = add_second_attempt(split_weekly(derive_rs(estimates)))
    return allocate_largest_remainder(weekly, geo, weight, by)


def residual_pieces(planned):
    """The pieces a planner left over, as rows of the next export; they keep their ids."""
    return planned.filter(F.col("workflow_step") == schemas.STEP_RESIDUAL).select(
        "request_id",
        cal.midnight("week").alias("sent_at"),
        cal.midnight("week").alias("prepare_at"),
        "product",
        "sender",
        "province",
        "postal_code",
        F.col("attempt").cast("int").alias("attempt"),
        F.concat(F.lit("IUN~"), "request_id").alias("iun"),
        "workflow_step",
        "week",
    )


def explode_pieces(allocated, residuals=None, by=None, placed=False):
    """One row per piece, with ids made of the allocation key and the piece's ordinal.

    ``residuals`` optionally adds pieces left over from the previous month, see
    ``residual_pieces``; ``by`` is a column to keep together and ``placed`` are rows that lie
    where ``allocate_largest_remainder`` leaves them, see ``repeat_rows``.
    """
    slim = allocated.select(
        "key", "product", "sender", "province", "postal_code", "attempt", "week", "allocated"
    )
    identity = ["key", "week", "attempt", "postal_code", "ordinal"]
    pieces = repeat_rows(slim, "allocated", by=by, placed=placed).select(
        fn.piece_id(*identity).alias("request_id"),
        cal.midnight("week").alias("sent_at"),
        cal.midnight("week").alias("prepare_at"),
        "product",
        "sender",
        "province",
        "postal_code",
        "attempt",
        fn.piece_id(*identity, prefix="IUN").alias("iun"),
        F.lit(schemas.STEP_RESIDUAL).alias("workflow_step"),
        "week",
    )
    return pieces if residuals is None else pieces.unionByName(residuals)


def week_buckets(pieces):
    """Pieces per delivery-week label."""
    return pieces.groupBy(cal.next_monday("week").alias("week_label")).agg(
        F.count(F.lit(1)).alias("pieces")
    )


def export_pieces(pieces, base, max_rows=schemas.MAX_CSV_ROWS):
    """Writes the pieces in batches, one folder per delivery-week label."""
    write_by_week(piece_rows(pieces), base, max_rows)


def export_allocation(
    allocated, base, residuals=None, max_rows=schemas.MAX_CSV_ROWS, compression=None, placed=False
):
    """Unfolds allocated rows into pieces and writes them like ``export_pieces``.

    The allocated rows are moved, by week and before they unfold; the pieces, many times larger,
    go from the tasks into the files. Rows that were allocated by the week label are ``placed``:
    they unfold where they lie. ``compression`` is that of the files; they tell it by their names.
    """
    pieces = explode_pieces(allocated, residuals, by="week", placed=placed)
    write_by_week(piece_rows(pieces), base, max_rows, compression=compression, placed=True)
