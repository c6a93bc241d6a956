"""The driver tables, and the captures, run history and registry derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.value import epoch_micros
from gleaner.operators.history import run_rows
from gleaner.operators.ordered import numbered_by_size
from gleaner.session import stored
from gleaner.sources.captures import exchange

# Shape of the body of an order capture.
ORDER_BODY = (
    "id long, status string, total double, "
    "items array<struct<n: int, part: long, supp: long, qty: double, price: double>>"
)
LINES_PER_PAGE = 50
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
RUN_SECONDS = 21600

_derived: dict[tuple, DataFrame] = {}


class Tables:
    """One folder of driver tables. Derived tables are written once per session and reused."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def _once(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.path, name)
        if key not in _derived:
            _derived[key] = stored(make(), name)
        return _derived[key]

    @cached_property
    def captures(self) -> DataFrame:
        """One exchange per order and page of at most `LINES_PER_PAGE` lines, so no body grows without bound."""
        return self.run_captures.drop("run")

    @cached_property
    def run_captures(self) -> DataFrame:
        """The same with the run that took it, the order's year."""
        return self._once("captures", self._captures)

    def _captures(self) -> DataFrame:
        lines = (
            numbered_by_size(
                self.lineitem.select("l_orderkey", *LINE_ORDER, "l_quantity"), ["l_orderkey"], LINE_ORDER, "row"
            )
            .groupBy("l_orderkey", F.floor((F.col("row") - 1) / LINES_PER_PAGE).cast("int").alias("page"))
            .agg(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            F.col("l_linenumber").alias("n"),
                            F.col("l_partkey").alias("part"),
                            F.col("l_suppkey").alias("supp"),
                            F.col("l_quantity").alias("qty"),
                            F.col("l_extendedprice").alias("price"),
                        )
                    )
                ).alias("items")
            )
        )
        whole = self.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        page = F.coalesce("page", F.lit(0))
        return whole.select(
            F.col("o_orderkey").alias("seq"),
            page.alias("page"),
            F.year("o_orderdate").cast("string").alias("run"),
            *exchange(
                url=F.concat(
                    F.lit("https://api.test/orders/"),
                    F.col("o_orderkey"),
                    F.lit("?b="),
                    F.replace(F.col("o_orderpriority"), F.lit(" "), F.lit("+")),
                    F.lit("&a="),
                    F.col("o_orderstatus"),
                    F.when(page > 0, F.concat(F.lit("&page="), page)).otherwise(F.lit("")),
                ),
                method=F.lit("GET"),
                status=F.when(_not_found(), F.lit(404)).otherwise(F.lit(200)),
                headers=F.create_map(F.lit("Content-Type"), F.lit("application/json; charset=utf-8")),
                body=F.to_json(
                    F.struct(
                        F.col("o_orderkey").alias("id"),
                        F.col("o_orderstatus").alias("status"),
                        F.col("o_totalprice").alias("total"),
                        F.coalesce(F.col("items"), F.array().cast(_items_type())).alias("items"),
                    )
                ),
            ),
        )

    @cached_property
    def web_captures(self) -> DataFrame:
        """Browser captures: events as matched responses, pages as documents."""
        return self._once(
            "web",
            lambda: self.events.select(
                F.col("event_id").alias("seq"),
                F.lit("browser").alias("kind"),
                F.lit("match").alias("subkind"),
                F.concat(F.lit("https://app.test/"), "event_type", F.lit("?user="), "user_id").alias("url"),
                F.lit("GET").alias("method"),
                F.lit(200).alias("status"),
                F.col("props").alias("body"),
                F.lit(None).cast("string").alias("html"),
            ).unionByName(
                self.pages.select(
                    F.col("page_id").alias("seq"),
                    F.lit("browser").alias("kind"),
                    F.lit("document").alias("subkind"),
                    "url",
                    F.lit(None).cast("string").alias("method"),
                    F.lit(None).cast("int").alias("status"),
                    F.lit(None).cast("string").alias("body"),
                    "html",
                )
            ),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Run history: events in buckets of six hours, counted by type."""
        return self._once("runs", self._runs)

    def _runs(self) -> DataFrame:
        micros = RUN_SECONDS * 1_000_000
        events = self.events.select("event_type", epoch_micros(F.col("ts")).alias("at_us"))
        rows = run_rows(events.withColumn("bucket", F.floor(F.col("at_us") / micros)), ["bucket"], "event_type", "at_us")
        of = lambda t: F.coalesce(F.try_element_at("counts", F.lit(t)), F.lit(0))
        return rows.select(
            F.concat(F.lit("sr-"), "bucket").alias("id"),
            F.lit("events").alias("run_id"),
            (F.col("bucket") * (RUN_SECONDS * 1000)).alias("at"),
            F.when(of("error") > of("view"), F.lit("fail")).otherwise(F.lit("ok")).alias("outcome"),
            "counts",
            "seconds",
        )

    @cached_property
    def versions(self) -> DataFrame:
        """Package versions: the lines of a part in ship order."""
        return self._once("versions", self._versions)

    def _versions(self) -> DataFrame:
        order = ["published_at", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
        rows = self.lineitem.select(
            "l_partkey",
            "l_orderkey",
            "l_linenumber",
            "l_suppkey",
            "l_extendedprice",
            epoch_micros(F.col("l_shipdate")).alias("published_at"),
            F.concat("l_returnflag", "l_linestatus").alias("recipe"),
        )
        return numbered_by_size(rows, ["l_partkey"], order, "version").select(
            F.col("l_partkey").alias("slug"),
            F.col("version").cast("long"),
            "recipe",
            F.col("l_suppkey").alias("output_ref"),
            (F.col("l_suppkey") % 5).alias("input_ref"),
            "published_at",
        )

    @property
    def packages(self) -> DataFrame:
        return self.part.select(
            F.col("p_brand").alias("author"),
            F.col("p_partkey").alias("slug"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("description"),
            F.col("p_partkey").alias("created_at"),
        )

    @property
    def types(self) -> DataFrame:
        """Registry types: a supplier is a type, its parent the supplier with half its key."""
        return self.supplier.select(
            F.concat(F.lit("a"), F.col("s_nationkey")).alias("author"),
            F.concat(F.lit("T"), F.col("s_suppkey")).alias("name"),
            F.col("s_suppkey").alias("key"),
            F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"),
            F.when(F.col("s_acctbal") > 5000, F.lit(2)).otherwise(F.lit(1)).alias("version"),
            F.col("s_nationkey").alias("nation"),
        )


def _not_found():
    return (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")


def _items_type() -> str:
    return ORDER_BODY.split("items ", 1)[1].replace(": ", ":")
