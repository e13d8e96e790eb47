"""Versions of entities from their touches in order of arrival, without a task that sees all touches of a hot entity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scalars import sha256_hex

#: Positions of a range inside which changes are found first, as a power of two.
RANGE = 16


def version_uid() -> Column:
    """Id of a version, from its entity and number."""
    return F.substring(sha256_hex(F.concat_ws("/", "entity_type", "entity_id", F.col("version").cast("string"))), 1, 32)


def versioned(touched: DataFrame, last: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Touches of entities with `new`, whether the fields changed, and the `version` and `uid` they pin.

    `touched` has entity_type, entity_id, pos, ord, fingerprint and __part, the range of its position; `last` has the entities' `old`
    fingerprints and `top` versions. Changes are found inside each range first; then one row per entity and range carries fields and
    version numbers from range to range. So an entity that a third of all events touch is no single group. `keep` stores what both steps
    read and returns it.
    """
    entity = ["entity_type", "entity_id"]
    by = Window.partitionBy(*entity, "__part").orderBy("pos", "ord")
    rows = touched.withColumn("__first", F.row_number().over(by) == 1)
    rows = rows.withColumn("__changed", ~F.col("__first") & ~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(by)))
    rows = rows.withColumn("__inside", F.sum(F.col("__changed").cast("long")).over(by))
    # an entity's last touch in a range speaks for it: no aggregate sorts the touches again
    rows = rows.withColumn("__from", F.when(F.lead(F.lit(1)).over(by).isNull(), F.struct(F.first("fingerprint").over(by).alias("f"))))
    rows = keep(rows) if keep else rows
    ranges = rows.where("__from is not null").select(*entity, "__part", F.col("__from.f").alias("__from"), F.col("fingerprint").alias("__to"), F.col("__inside").alias("__n"))
    ranges = ranges.join(last, entity, "left")
    order = Window.partitionBy(*entity).orderBy("__part")
    ranges = ranges.withColumn("__new", ~F.col("__from").eqNullSafe(F.coalesce(F.lag("__to").over(order), "old")))
    before = F.coalesce(F.sum(F.col("__new").cast("long") + F.col("__n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("__base", F.coalesce("top", F.lit(-1)) + before + F.col("__new").cast("long")).select(*entity, "__part", "__new", "__base")
    rows = rows.drop("__from").join(ranges, [*entity, "__part"])
    rows = rows.withColumn("new", F.when(F.col("__first"), F.col("__new")).otherwise(F.col("__changed"))).withColumn("version", F.col("__base") + F.col("__inside"))
    return rows.withColumn("uid", version_uid()).drop("__first", "__changed", "__inside", "__new", "__base")


def pinned(logs: DataFrame, versions: DataFrame, entity: str) -> DataFrame:
    """Logs with the version of their entity that was current at their position: last version at or before it.

    Found inside ranges of positions first; one row per entity and range carries the last version on.
    """
    both = logs.select(F.col(entity).alias("entity_id"), "pos", F.lit(None).cast("long").alias("version"), F.lit(1).alias("side")).unionByName(
        versions.select("entity_id", "pos", F.col("version").cast("long"), F.lit(0).alias("side"))
    )
    both = both.withColumn("__part", F.shiftright("pos", RANGE))
    by = Window.partitionBy("entity_id", "__part").orderBy("pos", "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("version", F.last("version", ignorenulls=True).over(by)).where("side = 1")
    ends = both.groupBy("entity_id", "__part").agg(F.max("version").alias("__end"))
    carried = F.last("__end", ignorenulls=True).over(Window.partitionBy("entity_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return inside.join(ends.select("entity_id", "__part", carried.alias("__before")), ["entity_id", "__part"]).select("pos", "entity_id", F.coalesce("version", "__before").alias("version"))
