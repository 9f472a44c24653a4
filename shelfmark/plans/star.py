"""Catalog views over the star-schema tables: which column plays which part."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import slugify
from shelfmark.sources.tables import read_table

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = list(SCHEMAS)
CREATED = "2024-01-01 00:00:00"
NOW = "2024-06-01 12:00:00"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


class Star:
    """The tables of one folder, and the catalogs bound to them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name, SCHEMAS[name])

    # nations as categories, customers as items
    def categories(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("bigint").alias("id"), slugify("n_name").alias("slug"),
            F.col("n_name").alias("name"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("sort_order"),
            (F.col("n_regionkey") != 0).alias("is_active"), F.col("n_regionkey").alias("region"))

    def items(self) -> DataFrame:
        badge = F.when(F.col("c_mktsegment") == "BUILDING", F.lit("new")) \
            .when(F.col("c_mktsegment") == "MACHINERY", F.lit("hot"))
        return self.table("customer").select(
            F.col("c_custkey").alias("id"),
            F.nullif(F.col("c_nationkey").cast("bigint"), F.lit(7)).alias("category_id"),
            F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"),
            F.col("c_acctbal").cast("decimal(10,2)").alias("price"), (F.col("c_acctbal") >= 0).alias("is_available"),
            badge.alias("badge"), (F.col("c_custkey") % 10).cast("int").alias("sort_order"))

    def dated_items(self) -> DataFrame:
        return self.items().withColumn("updated_at", moment(CREATED))

    # brands as categories, parts as items
    def brands(self) -> DataFrame:
        brands = self.table("part").groupBy("p_brand").agg(F.min("p_size").alias("sort_order"))
        return brands.select(F.col("p_brand").alias("id"), slugify("p_brand").alias("slug"),
                             F.col("p_brand").alias("name"), "sort_order", F.lit(True).alias("is_active"))

    def parts(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_brand").alias("category_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("description"), F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
            F.lit(True).alias("is_available"), F.lit(None).cast("string").alias("badge"),
            F.col("p_size").alias("sort_order"))

    # events as a change log
    def changes(self) -> DataFrame:
        return as_changes(self.table("events"))

    # events as change requests by principals
    def requests(self) -> DataFrame:
        op = F.when(F.col("event_type") == "error", F.lit("delete")) \
            .when(F.col("event_type") == "signup", F.lit("insert")).otherwise(F.lit("update"))
        tables = F.array(*[F.lit(t) for t in ("menu_items", "categories", "cafe_info", "admin_users")])
        tbl = F.get(tables, (F.col("event_id") % 4).cast("int"))
        return self.table("events").select("event_id", "user_id", op.alias("op"), tbl.alias("tbl"))

    def owners(self) -> DataFrame:
        owners = self.table("events").where(F.col("user_id") % 25 == 0).select("user_id").distinct()
        address = F.concat(F.lit("Owner"), F.col("user_id").cast("string"), F.lit("@Example.com"))
        return owners.select("user_id", address.alias("email"), F.lit("first owner").alias("full_name"),
                             moment(CREATED).alias("created_at"))

    # customers as users with addresses
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("email"),
            F.when(F.col("c_acctbal") >= 0, moment(CREATED)).alias("email_confirmed_at"))


def as_changes(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", F.lit("delete")) \
        .when(F.col("event_type") == "signup", F.lit("insert")).otherwise(F.lit("update"))
    return events.select("user_id", "ts", "event_id", op.alias("op"),
                         F.col("value").cast("decimal(10,2)").alias("payload"))
