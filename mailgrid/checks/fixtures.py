"""Domain tables derived from the whole test tables, see FIXTURES.md.

``Fixtures`` derives the domain's input tables; ``checks.fixture_sql`` states the same
derivations in SQL. The engine works on stored tables, so each derived table is written once per
session to the shared work folder and read from there by every query.
"""

from functools import wraps

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailgrid import schemas
from mailgrid.functions import calendar as cal
from mailgrid.plans import results
from mailgrid.session import work_folder

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}
UPDATED = "2002-01-01 00:00:00"
LOAD_DAY = "2001-06-15 12:00:00"
# What a request id is made of.
REQUEST = ["l_orderkey", "line"]


def courier(col):
    return F.concat(F.lit("K"), (F.col(col) % 10).cast("string"))


def sender(col):
    return F.concat(F.lit("S"), (F.col(col) % 40).cast("string"))


def postal_code(col):
    return F.lpad(F.col(col).cast("string"), 12, "0")


def pieces_per_order(product, month):
    """Volumes of very different sizes: single pieces for a quarter of the senders, thousands
    for some, and one month of one sender that reaches into the hundred thousands."""
    number = F.col("o_custkey") % 40
    huge = (number == 7) & (product == "890") & (month == F.lit("1995-03-01").cast("date"))
    return (
        F.when(huge, 150000)
        .when(number % 20 == 0, 700)
        .when(number % 4 == 2, 1)
        .otherwise(17)
        .cast("bigint")
    )


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def run_of(day):
    """Run id of a week: year and quarter of its Monday."""
    return (F.year(day) * 10 + F.quarter(day)).cast("int")


def week_of_year(ts):
    return F.expr(f"dayofyear({ts}) div 7")


def courier_no():
    return F.substring("courier", 2, 9).cast("int")


_STORED = {}


def stored(build):
    """Writes the table on first use in a session, then reads it."""

    @wraps(build)
    def read(self):
        key = (self.spark.sparkContext.applicationId, self.folder, build.__name__)
        if key not in _STORED:
            table, path = build(self), work_folder(self.spark, build.__name__)
            table.write.parquet(path)
            _STORED[key] = path, table.schema
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    return read


class Fixtures:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name, *cols):
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")
        return df.select(*cols) if cols else df

    def _nations(self):
        return self.table("nation", "n_nationkey", "n_name", "n_regionkey").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )

    def _customer_nation(self):
        return self.table("customer", "c_custkey", "c_nationkey").join(
            self.table("nation", "n_nationkey", F.col("n_name").alias("province")),
            F.col("c_nationkey") == F.col("n_nationkey"),
        ).select("c_custkey", "province")

    def _supplier_nation(self):
        return self.table("supplier", "s_suppkey", "s_nationkey").join(
            self.table("nation", "n_nationkey", F.col("n_name").alias("province")),
            F.col("s_nationkey") == F.col("n_nationkey"),
        ).select("s_suppkey", "province")

    # --- dimension -------------------------------------------------------------------------

    @stored
    def geo(self):
        """One postal code per customer."""
        return self._places()

    def _places(self):
        """The postal codes as they are derived, for tables that need few of the columns."""
        codes = self.table("customer", "c_custkey", "c_nationkey", "c_acctbal").select(
            postal_code("c_custkey").alias("postal_code"),
            F.col("c_nationkey").alias("n_nationkey"),
            (F.floor(F.abs("c_acctbal")) + 1).alias("pop"),
        )
        province = Window.partitionBy("n_name")
        placed = codes.join(self._nations(), "n_nationkey").withColumn(
            "_all", F.sum("pop").over(province)
        )
        nano = F.expr("(pop * 1000000000) div _all").cast("decimal(18,0)")
        return placed.select(
            "postal_code",
            F.col("r_name").alias("region"),
            F.concat(F.lit("Province of "), "n_name").alias("province_name"),
            F.col("n_name").alias("province"),
            "pop",
            (nano * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(11,9)").alias("share"),
        )

    # --- estimates -------------------------------------------------------------------------

    @stored
    def estimates(self):
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        orders = (
            self.table("orders", "o_custkey", "o_orderpriority", "o_orderdate")
            .groupBy(
                "o_custkey",
                F.when(urgent, "890").otherwise("AR").alias("product"),
                cal.month_start("o_orderdate").alias("delivery_date"),
            )
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("n", F.col("n") * pieces_per_order(F.col("product"), F.col("delivery_date")))
        )
        grouped = (
            orders.join(self._customer_nation(), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(sender("o_custkey").alias("sender"), "province", "product", "delivery_date")
            .agg(F.sum("n").alias("monthly"))
        )
        return grouped.select(
            F.concat_ws("~", "sender", "product", "province").alias("pk"),
            "delivery_date",
            F.expr("monthly div 4").cast("int").alias("weekly"),
            "monthly",
            F.col("monthly").cast("int").alias("original"),
            "sender",
            "product",
            "province",
            cal.midnight("delivery_date").alias("updated_at"),
        )

    def estimates_delta(self):
        """Next load: 890 keys stay and AR keys of even months move 20 years on; a third each
        is newer, equally old and older than the stored row."""
        month = F.month("delivery_date")
        moved = (F.col("product") == "AR") & (month % 2 == 0)
        shift = F.when(month % 3 == 0, 1).when(month % 3 == 1, 0).otherwise(-1)
        return self.estimates().select(
            "pk",
            F.when(moved, F.add_months("delivery_date", 240))
            .otherwise(F.col("delivery_date"))
            .alias("delivery_date"),
            (F.col("weekly") + 1).alias("weekly"),
            (F.col("monthly") * 2).alias("monthly"),
            "original",
            "sender",
            "product",
            "province",
            cal.midnight(F.date_add(F.col("updated_at").cast("date"), shift)).alias("updated_at"),
        )

    @stored
    def estimate_pages(self):
        """The estimates as landed pages, one per sender, province and month."""
        item = F.struct(
            F.date_format("delivery_date", "yyyy-MM-dd").alias("deliveryDate"),
            (F.col("monthly") + 0.5).alias("monthlyEstimate"),
            F.col("original").alias("originalEstimate"),
            F.col("sender").alias("paId"),
            "pk",
            F.col("product").alias("productType"),
            "province",
            F.col("weekly").alias("weeklyEstimate"),
        )
        pages = self.estimates().groupBy("sender", "province", "delivery_date")
        return pages.agg(F.collect_list(item).alias("items")).select(
            F.to_json(F.struct("items")).alias("body")
        )

    # --- capacities ------------------------------------------------------------------------

    @stored
    def declared(self):
        weekly = (
            self.table("lineitem", "l_suppkey", "l_shipdate", "l_quantity")
            .groupBy("l_suppkey", cal.week_start("l_shipdate").alias("week"))
            .agg(F.sum("l_quantity").alias("quantity"))
        )
        grouped = (
            weekly.join(self._supplier_nation(), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(
                courier("l_suppkey").alias("courier"),
                "province",
                "week",
                (F.col("l_suppkey") % 3 != 0).alias("p890"),
                (F.col("l_suppkey") % 2 == 0).alias("p_ar"),
            )
            .agg(F.sum("quantity").cast("bigint").alias("capacity"))
        )
        start = cal.midnight("week")
        return grouped.select(
            "capacity",
            "province",
            F.concat(F.lit("T24~"), "province").alias("tender_geokey"),
            "p890",
            "p_ar",
            F.lit(True).alias("p_rs"),
            F.lit("T24").alias("tender_id"),
            "courier",
            cal.midnight(F.date_sub("week", 30)).alias("created_at"),
            F.expr("capacity * 13 div 10").alias("peak_capacity"),
            start.alias("from_ts"),
            cal.window_end(start, "six_days").alias("to_ts"),
            F.concat_ws("~", "courier", "province").alias("pk"),
            F.expr("capacity * 11 div 10").alias("production_capacity"),
            cal.midnight(F.date_sub("week", 1)).alias("updated_at"),
        )

    def declared_delta(self):
        """Next load: 890 keys stay, the others start 20 years later; a third each is newer,
        equally old and older."""
        week = week_of_year("from_ts")
        shift = F.when(week % 3 == 0, 1).when(week % 3 == 1, 0).otherwise(-1)
        day = F.col("from_ts").cast("date")
        moved = F.when(F.col("p890"), day).otherwise(F.date_add(day, 7280))
        return (
            self.declared()
            .withColumn(
                "updated_at",
                cal.midnight(F.date_add(F.col("updated_at").cast("date"), shift)),
            )
            .withColumn("capacity", F.col("capacity") + 5)
            .withColumn("from_ts", cal.midnight(moved))
        )

    def declared_twice(self):
        return self.declared().unionByName(self.declared_delta())

    @stored
    def capacity_pages(self):
        """Landed pages per courier, province and week: each capacity as an open row and as a
        closed one of a different size."""
        products = F.array_compact(
            F.array(
                F.when(F.col("p890"), F.lit("890")),
                F.when(F.col("p_ar"), F.lit("AR")),
                F.lit("RS"),
            )
        )
        ends = F.explode(F.array(F.lit(None).cast("string"), F.lit("2030-01-06T00:00:00.000Z")))
        closed = F.col("activationDateTo").isNotNull()
        extra = F.when(closed, (F.col("capacity") % 5) - 2).otherwise(0)
        rows = self.declared().withColumn("activationDateTo", ends)
        item = F.struct(
            F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("activationDateFrom"),
            "activationDateTo",
            (F.col("capacity") + extra).alias("capacity"),
            F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("createdAt"),
            F.col("province").alias("geoKey"),
            F.col("peak_capacity").alias("peakCapacity"),
            F.concat_ws("~", "pk", F.col("p890").cast("string"), F.col("p_ar").cast("string")).alias(
                "pk"
            ),
            products.alias("products"),
            F.col("tender_id").alias("tenderId"),
            F.col("tender_geokey").alias("tenderIdGeoKey"),
            F.col("courier").alias("unifiedDeliveryDriver"),
        )
        pages = rows.groupBy("courier", "province", F.col("from_ts").cast("date").alias("week"))
        return pages.agg(F.collect_list(item).alias("items")).select(
            "week", F.to_json(F.struct("items")).alias("body")
        )

    def postal_capacity(self):
        return self.table("customer", "c_custkey").select(
            courier("c_custkey").alias("courier"),
            postal_code("c_custkey").alias("postal_code"),
            (F.col("c_custkey") % 50 + 1).cast("int").alias("capacity"),
            ((F.col("c_custkey") % 50 + 1) * 2).cast("int").alias("peak_capacity"),
            ntz("2001-01-01 00:00:00").alias("from_ts"),
            F.lit(None).cast("timestamp_ntz").alias("to_ts"),
            F.lit(None).cast("string").alias("products"),
        )

    @stored
    def postal_pages(self):
        """Landed pages with one postal capacity each."""
        item = F.struct(
            F.lit("2001-01-01T10:00:00.000Z").alias("activationDateFrom"),
            F.when(F.col("capacity") % 2 == 0, F.lit("2001-12-31T23:59:59.000Z")).alias(
                "activationDateTo"
            ),
            F.col("capacity").cast("bigint").alias("capacity"),
            F.col("postal_code").alias("geoKey"),
            F.col("peak_capacity").cast("bigint").alias("peakCapacity"),
            F.col("courier").alias("unifiedDeliveryDriver"),
        )
        return self.postal_capacity().select(
            F.to_json(F.struct(F.array(item).alias("items"))).alias("body")
        )

    @stored
    def run_capacity(self):
        """One row per courier, province and week. Courier 4 never has the default capacity,
        other even couriers have it in two weeks of three, courier 8 lacks some flags; courier 6
        lacks the product flags in some weeks; some windows are open."""
        per_product = {
            "890": self._monthly("890").withColumnRenamed("m", "m890"),
            "AR": self._monthly("AR").withColumnRenamed("m", "m_ar"),
        }
        week = week_of_year("from_ts")
        no = courier_no()
        unset = (no == 6) & (week % 4 == 1)
        grouped = (
            self.declared()
            .groupBy("courier", "province", "from_ts")
            .agg(
                F.sum("capacity").alias("capacity"),
                F.bool_or("p890").alias("p890"),
                F.bool_or("p_ar").alias("p_ar"),
            )
            .withColumn("_month", cal.month_start("from_ts"))
            .join(per_product["890"], ["province", "_month"], "left")
            .join(per_product["AR"], ["province", "_month"], "left")
            .join(results.province_region(self.geo()), "province")
        )
        m890 = F.when(F.col("p890"), F.coalesce("m890", F.lit(0))).otherwise(0)
        m_ar = F.when(F.col("p_ar"), F.coalesce("m_ar", F.lit(0))).otherwise(0)
        monthly = m890 + m_ar
        default = (
            F.when(no == 4, F.lit(False))
            .when((no == 8) & (week % 5 == 0), F.lit(None))
            .when(no % 2 == 0, week % 3 != 0)
            .otherwise(F.lit(True))
        )
        return grouped.select(
            "courier",
            "from_ts",
            F.when(week % 13 != 12, cal.window_end("from_ts", "end_of_sunday")).alias("to_ts"),
            "capacity",
            monthly.cast("bigint").alias("sum_monthly"),
            F.floor(monthly / 4).cast("bigint").alias("sum_weekly"),
            "region",
            "province",
            F.when(~unset, F.col("p890")).alias("p890"),
            F.when(~unset, F.col("p_ar")).alias("p_ar"),
            cal.midnight(F.date_add(F.col("from_ts").cast("date"), 2)).alias("updated_at"),
            default.alias("is_default"),
            run_of("from_ts").alias("run_id"),
        )

    def _monthly(self, product):
        return (
            self.estimates()
            .filter(F.col("product") == product)
            .groupBy("province", F.col("delivery_date").alias("_month"))
            .agg(F.sum("monthly").alias("m"))
        )

    def run_capacity_delta(self):
        """Used capacities of the runs: keys of uneven weeks stay, the others are new."""
        week = week_of_year("from_ts")
        day = F.col("from_ts").cast("date")
        shift = F.when(week % 3 == 0, 1).when(week % 3 == 1, 0).otherwise(-1)
        return (
            self.run_capacity()
            .withColumn(
                "updated_at",
                cal.midnight(F.date_add(F.col("updated_at").cast("date"), shift)),
            )
            .withColumn("capacity", F.col("capacity") + 7)
            .withColumn(
                "from_ts",
                cal.midnight(F.when(week % 2 == 1, day).otherwise(F.date_add(day, 7280))),
            )
        )

    # --- runs ------------------------------------------------------------------------------

    def _run_rows(self, days, no, month):
        status = (
            F.when(no % 6 < 2, schemas.STATUS_DONE)
            .when(no % 6 == 2, schemas.STATUS_RUNNING)
            .when(no % 6 == 3, schemas.STATUS_SCHEDULED)
            .when(no % 6 == 4, schemas.STATUS_DRAFT)
        )
        kinds = [
            schemas.CAPACITY_BASE,
            schemas.CAPACITY_PEAK,
            schemas.CAPACITY_MIXED,
            schemas.CAPACITY_PRODUCTION,
        ]
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (no % 4 + 1).cast("int"))
        return days.select(
            "run_id",
            F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("name"),
            F.lit(None).cast("string").alias("description"),
            status.alias("status"),
            F.when(no % 2 == 0, schemas.TRIGGER_NOW)
            .otherwise(schemas.TRIGGER_SCHEDULE)
            .alias("trigger"),
            "executed_at",
            month.alias("month"),
            kind.alias("capacity_type"),
            F.when(no % 3 == 0, schemas.RUN_MANUAL)
            .otherwise(schemas.RUN_AUTOMATED)
            .alias("run_type"),
        )

    @stored
    def runs(self):
        """One run per quarter of the shipping weeks."""
        weeks = self._weeks()
        days = weeks.groupBy(run_of("week").alias("run_id")).agg(F.min("week").alias("first"))
        days = days.withColumn("executed_at", cal.midnight(F.date_sub("first", 10)))
        month = F.concat_ws(
            "-",
            F.expr("run_id div 10").cast("string"),
            F.lpad(((F.col("run_id") % 10) * 3 - 2).cast("string"), 2, "0"),
        )
        return self._run_rows(days, F.col("run_id"), month)

    @stored
    def run_log(self):
        """One run per shipping week, as in a log of weekly executions."""
        no = F.datediff("week", F.lit("1990-01-01").cast("date")) / 7
        days = self._weeks().select("week", no.cast("int").alias("run_id"))
        late = F.when(F.col("run_id") % 5 == 0, F.expr("interval 3 days")).otherwise(
            F.expr("interval 6 hours")
        )
        days = days.withColumn("executed_at", cal.midnight("week") + late)
        n = F.expr("run_id div 2")
        return self._run_rows(days, n, cal.month_key("executed_at"))

    def _weeks(self):
        return self.table("lineitem", "l_shipdate").select(
            cal.week_start("l_shipdate").alias("week")
        ).distinct()

    # --- planner output --------------------------------------------------------------------

    @stored
    def pieces(self):
        return self._shipped().drop(*REQUEST)

    def _shipped(self):
        """The pieces as they are derived, with the columns their request ids are made of.

        Orders meet their customers first, so that the lines, by far the most rows, are shuffled
        once, by the order. What is counted by REQUEST afterwards stays where it is.
        """
        lines = self.table(
            "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate"
        )
        orders = self.table("orders", "o_orderkey", "o_custkey", "o_orderpriority").join(
            self._customer_nation(), F.col("o_custkey") == F.col("c_custkey")
        )
        week = cal.week_start("l_shipdate")
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber").alias("request_id"),
                sender("o_custkey").alias("sender"),
                "province",
                postal_code("o_custkey").alias("postal_code"),
                courier("l_suppkey").alias("courier"),
                F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "890")
                .otherwise("AR")
                .alias("product"),
                F.when(F.col("l_returnflag") == "R", schemas.STEP_RESIDUAL)
                .otherwise(schemas.STEP_PLANNED)
                .alias("workflow_step"),
                F.lit("0").alias("attempt"),
                week.alias("week"),
                run_of(week).alias("run_id"),
                "l_orderkey",
                # A struct is never NULL: a line without a number has a request id, too.
                F.struct("l_linenumber").alias("line"),
            )
        )

    @stored
    def piece_pages(self):
        """The pieces as landed pages of one item, with the asked week and the run."""
        item = F.struct(
            F.col("request_id").alias("requestId"),
            F.col("sender").alias("senderPaId"),
            "province",
            F.col("postal_code").alias("cap"),
            F.when(F.col("workflow_step") == schemas.STEP_PLANNED, F.col("courier")).alias(
                "unifiedDeliveryDriver"
            ),
            F.col("product").alias("productType"),
            F.col("workflow_step").alias("workflowStep"),
            "attempt",
        )
        return self.pieces().select(
            "run_id", "week", F.to_json(F.struct(F.array(item).alias("items"))).alias("body")
        )

    @stored
    def sender_results(self):
        return results.results_by_sender(self._shipped(), REQUEST)

    @stored
    def courier_results(self):
        return results.results_by_courier(self._shipped(), self._places(), REQUEST)

    @stored
    def sender_residuals(self):
        return results.residuals_by_sender(self.pieces())

    @stored
    def courier_residuals(self):
        return results.residuals_by_courier(self.pieces(), self.geo())

    def cells(self):
        """Used capacity found per run, courier, province and week: the handled pieces."""
        return (
            self.pieces()
            .groupBy("run_id", "courier", "province", "week")
            .agg(F.count(F.lit(1)).alias("capacity"))
        )

    def processed(self):
        return self._weeks().select(run_of("week").alias("run_id"), "week")

    # --- overrides -------------------------------------------------------------------------

    @stored
    def override_documents(self):
        """Typed capacities of every run, one document per run, courier and province. Courier 3
        types weeks the run does not have yet; capacities change by the week."""
        rows = self.run_capacity().filter(F.col("p890").isNotNull() & F.col("to_ts").isNotNull())
        day = F.col("from_ts").cast("date")
        start = F.when(courier_no() == 3, F.date_add(day, 7280)).otherwise(day)
        product = F.concat_ws(
            "-", F.when(F.col("p890"), F.lit("890")), F.when(F.col("p_ar"), F.lit("AR"))
        )

        def text(col):
            return col.cast("string")

        row = F.struct(
            F.col("region").alias("regione"),
            F.col("province").alias("cod_sigla_provincia"),
            product.alias("product"),
            text(F.col("sum_monthly")).alias("postalizzazioni_mensili"),
            text(F.col("sum_weekly")).alias("postalizzazioni_settimanali"),
            F.date_format(start, "dd/MM/yyyy").alias("inizioPeriodoValidita"),
            F.date_format(F.date_add(start, 6), "dd/MM/yyyy").alias("finePeriodoValidita"),
            text(F.col("capacity") * 2).alias("capacita"),
            text(F.col("capacity")).alias("capacita_reale"),
            text(F.col("capacity") + 1).alias("capacita_bau_originale"),
            F.when(F.col("capacity") % 3 == 0, "0").otherwise("1").alias("flag_default"),
        )
        groups = rows.groupBy("run_id", "courier", "province")
        return groups.agg(F.collect_list(row).alias("rows")).select(
            "run_id", F.to_json(F.create_map("courier", "rows")).alias("body")
        )
