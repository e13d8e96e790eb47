"""Events from JSON lines whose values say their kind, as {"Text": ...}, {"Number": ...} or {"Json": ...}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scalars import canonical_number

_VALUE = "struct<Text:string,Number:double,Json:string>"
_ENTITY = f"struct<entity_type:string,entity_id:string,fields:map<string,{_VALUE}>>"
_KEYS = ("event_id", "occurred_at", "actor", "method", "url", "content", "targets", "custom")
_BODY = f"event_id string, occurred_at long, actor {_ENTITY}, method string, url string, content {_VALUE}, targets array<{_ENTITY}>, custom map<string,{_VALUE}>"


def _text(value: Column) -> Column:
    """A tagged value as canonical text; null where it has no tag or several."""
    one = (value["Text"].isNotNull().cast("int") + value["Number"].isNotNull().cast("int") + value["Json"].isNotNull().cast("int")) == 1
    return F.when(one, F.coalesce(value["Text"], canonical_number(value["Number"]), F.to_json(F.try_parse_json(value["Json"]))))


def _fields(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: _text(v))


def _bad(values: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(values), lambda v: _text(v).isNull()), F.lit(False))


def tagged_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Columns of an event, and `error` where a line is no JSON object, has a key that is not known, or a value that is not tagged once."""
    rows = lines.withColumn("__b", F.from_json(column, _BODY)).withColumn("__k", F.json_object_keys(F.to_json(F.try_parse_json(column))))
    entity = lambda e: F.struct(e["entity_type"].alias("entity_type"), e["entity_id"].alias("entity_id"), _fields(e["fields"]).alias("fields"))
    body = F.col("__b")
    untagged = _bad(body["actor"]["fields"]) | _bad(body["custom"]) | (body["content"].isNotNull() & _text(body["content"]).isNull()) | F.coalesce(F.exists(body["targets"], lambda t: _bad(t["fields"])), F.lit(False))
    error = F.when(F.col("__k").isNull(), "no JSON object").when(F.size(F.array_except("__k", F.array(*map(F.lit, _KEYS)))) > 0, "unknown key").when(untagged, "untagged value")
    return rows.select(
        body["event_id"].alias("event_id"), body["occurred_at"].alias("occurred_at"), F.when(body["actor"].isNotNull(), entity(body["actor"])).alias("actor"), body["method"].alias("method"), body["url"].alias("url"),
        _text(body["content"]).alias("content"), F.transform(body["targets"], entity).alias("targets"), _fields(body["custom"]).alias("custom"), error.alias("error"),
    )
