"""Schemas and loaders of the two benchmark tables, adapter views over the test tables, and a small catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.encoding import cents, date_int

RANKINGS = T.StructType([T.StructField("pageURL", T.StringType()), T.StructField("pageRank", T.IntegerType()), T.StructField("avgDuration", T.IntegerType())])
#: Order of the fields in a file; the engine's order has destURL before sourceIP.
USERVISITS_FILE = T.StructType(
    [T.StructField("sourceIP", T.StringType()), T.StructField("destURL", T.StringType()), T.StructField("visitDate", T.DateType()), T.StructField("adRevenue", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("userAgent", "countryCode", "languageCode", "searchWord")]
    + [T.StructField("duration", T.IntegerType())]
)

#: The benchmark tables over orders and lineitem, as text that Spark and DuckDB both run.
RANKINGS_VIEW = """select concat('u', cast(o_orderkey as varchar(32))) as pageURL,
  cast(floor(o_totalprice/100) as int) as pageRank, cast(o_custkey % 100 as int) as avgDuration from orders"""
USERVISITS_VIEW = """select concat('u', cast(l_orderkey as varchar(32))) as destURL,
  concat(cast(l_suppkey % 256 as varchar(32)),'.',cast(l_partkey % 256 as varchar(32)),'.',
    cast(l_linenumber as varchar(32)),'.',cast(l_orderkey % 256 as varchar(32))) as sourceIP,
  cast(year(l_shipdate)*10000+month(l_shipdate)*100+day(l_shipdate) as int) as visitDate,
  cast(floor(l_extendedprice*100) as int) as adRevenue, cast(floor(l_quantity) as int) as duration from lineitem"""


def read_rankings(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A file without header or quotes; with ``rows``, as many lines and no more."""
    df = spark.read.csv(path, schema=RANKINGS, quote="")
    return df if rows is None else df.limit(rows)


def read_uservisits(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """Dates become yyyymmdd and revenue whole cents, both by truncation; sourceIP and destURL change places."""
    df = spark.read.csv(path, schema=USERVISITS_FILE, quote="", dateFormat="yyyy-MM-dd")
    df = df if rows is None else df.limit(rows)
    rest = [n for n in USERVISITS_FILE.names if n not in ("sourceIP", "destURL", "visitDate", "adRevenue")]
    return df.select("destURL", "sourceIP", date_int("visitDate").alias("visitDate"), cents("adRevenue").alias("adRevenue"), *rest)


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("pageURL"), F.floor(F.col("o_totalprice") / 100).cast("int").alias("pageRank"), (F.col("o_custkey") % 100).cast("int").alias("avgDuration"))


def visit_url() -> Column:
    return F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("destURL")


def visit_ip() -> Column:
    return F.concat_ws(".", *[x.cast("string") for x in (F.col("l_suppkey") % 256, F.col("l_partkey") % 256, F.col("l_linenumber"), F.col("l_orderkey") % 256)]).alias("sourceIP")


def uservisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        visit_url(),
        visit_ip(),
        date_int("l_shipdate").alias("visitDate"),
        F.floor(F.col("l_extendedprice") * 100).cast("int").alias("adRevenue"),
        F.floor("l_quantity").cast("int").alias("duration"),
    )


class Catalog:
    """Named tables of a session. Names are unique: creating one twice raises."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.capacity: dict[str, int] = {}

    def create(self, name: str, schema: T.StructType, rows: DataFrame | None = None, capacity: int = 0) -> DataFrame:
        if self.exists(name):
            raise ValueError(f"a table named {name} exists")
        if not schema.fields:
            raise ValueError("a table needs a column")
        if len({f.name for f in schema}) < len(schema):
            raise ValueError("column names must be unique")
        df = self.spark.createDataFrame([], schema) if rows is None else rows.to(schema)
        df.createTempView(name)
        self.capacity[name] = max(1, capacity)
        return df

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def schema(self, name: str) -> T.StructType:
        return self.get(name).schema

    def count(self, name: str) -> int:
        return self.get(name).count()

    def drop(self, name: str) -> bool:
        self.capacity.pop(name, None)
        return self.spark.catalog.dropTempView(name)
