"""The sample tables seen as audit data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scalars import fingerprint, micros
from auditlake.operators.versions import RANGE, versioned
from auditlake.sources.scratch import spread

#: Line items of a partition in which pairs are made distinct.
LINES = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(us: int) -> Column:
    """A time as the tables store it, so that a comparison with it reaches the scan."""
    return F.timestamp_add("MICROSECOND", F.lit(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per event: the position is the event's id, the actor its user, the custom column k from its properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"),
        micros(F.col("ts")).alias("ts_us"),
        F.upper("event_type").alias("method"),
        F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("url"),
        F.col("user_id").alias("actor_id"),
        F.get_json_object("props", "$.k").alias("k"),
        "value",
        "ts",
    )


EVENT_LOGS = """SELECT event_id AS pos, epoch_us(ts) AS ts_us, upper(event_type) AS method, '/users/' || user_id::VARCHAR || '/' || event_type AS url,
 user_id AS actor_id, json_extract_string(props, '$.k') AS k, value, ts FROM events"""


def user_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities whose state is their last event's type: one touch per event, with the version it pins."""
    touched = table(spark, sf_dir, "events").select(
        F.lit("user").alias("entity_type"), F.col("user_id").alias("entity_id"), F.col("event_id").alias("pos"), F.lit(0).alias("ord"), F.col("event_type").alias("state"),
        fingerprint({"state": F.col("event_type")}).alias("fingerprint"), F.shiftright("event_id", RANGE).alias("__part"),
    )
    return versioned(touched, spark.createDataFrame([], "entity_type string, entity_id long, old string, top long"))


def user_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their versions: a touch that repeats the latest fields makes none."""
    return user_touches(spark, sf_dir).where("new")


USER_VERSIONS = """SELECT entity_id, pos, state, sha256('state' || chr(0) || state || chr(0)) AS fingerprint, row_number() OVER (PARTITION BY entity_id ORDER BY pos) - 1 AS version
 FROM (SELECT user_id AS entity_id, event_id AS pos, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE state IS DISTINCT FROM before"""


def order_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per order, by its customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"),
        micros(F.col("o_orderdate")).alias("ts_us"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'PUT' WHEN 'O' THEN 'POST' ELSE 'PATCH' END").alias("method"),
        F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_custkey").alias("actor_id"),
    )


ORDER_LOGS = """SELECT o_orderkey AS pos, epoch_us(o_orderdate) AS ts_us, CASE o_orderstatus WHEN 'F' THEN 'PUT' WHEN 'O' THEN 'POST' ELSE 'PATCH' END AS method,
 '/orders/' || o_orderkey::VARCHAR AS url, o_custkey AS actor_id FROM orders"""


def relations(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Which parts and suppliers an order touched; line items repeat, so pairs are made distinct where their number counts.

    That is done among the lines of one order, in partitions by order whose number goes by the table's.
    """
    lines = table(spark, sf_dir, "lineitem")
    size = lines.count() if distinct else 0

    def pairs(kind: str, key: str) -> DataFrame:
        rows = lines.select(F.col("l_orderkey").alias("log"), F.col(key).alias("entity_id"))
        rows = spread(rows, size, LINES, "log").distinct() if distinct else rows
        return rows.select("log", F.lit(kind).alias("entity_type"), "entity_id")

    return pairs("part", "l_partkey").unionByName(pairs("supplier", "l_suppkey"))


RELATIONS = "SELECT DISTINCT l_orderkey AS log, 'part' AS entity_type, l_partkey AS entity_id FROM lineitem UNION SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem"


def registry(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Single-version registries: entity_id and name, and more fields of parts and customers."""
    if kind == "part":
        return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    if kind == "supplier":
        return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
