"""Specs as rows: a row for each mapping of each spec, so that many specs are hashed, compared and versioned by Spark.

Columns: source_id, target_schema, target_version, target_field, source_column,
literal, and transforms, an array of (op, args) with the args as JSON with sorted
keys. Hashes and differences are those of the spec objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.plans.spec import HASH_DIGITS, HASHED_FORM, MappingSpec
from tidegate.schema import TargetSchema

SPEC = ("source_id", "target_schema", "target_version")
SCHEMA = "source_id string, target_schema string, target_version int, target_field string, source_column string, literal string, transforms array<struct<op:string,args:string>>"
#: Escapes of JSON that have a letter, by UTF-16 unit.
_LETTERS = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def rows_of(spark: SparkSession, specs: Iterable[MappingSpec]) -> DataFrame:
    rows = [
        (s.source_id, s.target_schema, s.target_version, m.target_field, m.source_column, m.literal, [(t.op, json.dumps(t.args, **HASHED_FORM)) for t in m.transforms])
        for s in specs
        for m in s.mappings
    ]
    return spark.createDataFrame(rows, SCHEMA)


def json_text(value: Column) -> Column:
    """A string as JSON of ASCII signs only; null as null."""

    def escaped(unit: Column) -> Column:
        shown = F.when((unit >= "0020") & (unit <= "007E"), F.char(F.conv(unit, 16, 10).cast("long"))).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        return reduce(lambda rest, pair: F.when(unit == pair[0], F.lit(pair[1])).otherwise(rest), _LETTERS.items(), shown)

    units = F.regexp_extract_all(F.hex(F.encode(value, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    text = F.when(value.rlike(r'^[ !#-\[\]-~]*\z'), value).otherwise(F.array_join(F.transform(units, escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def transforms_json(transforms: Column) -> Column:
    each = F.transform(transforms, lambda t: F.concat(F.lit('{"args":'), F.coalesce(t["args"], F.lit("{}")), F.lit(',"op":'), json_text(t["op"]), F.lit("}")))
    return F.concat(F.lit("["), F.coalesce(F.array_join(each, ","), F.lit("")), F.lit("]"))


def content_hashes(table: DataFrame, *more: str) -> DataFrame:
    """SPEC (and columns ``more`` that tell specs of one source apart) and content_hash."""
    mapping = F.concat(
        F.lit('{"literal":'), json_text(F.col("literal")), F.lit(',"source_column":'), json_text(F.col("source_column")),
        F.lit(',"target_field":'), json_text(F.col("target_field")), F.lit(',"transforms":'), transforms_json(F.col("transforms")), F.lit("}"),
    )
    whole = table.groupBy(*SPEC, *more).agg(F.sort_array(F.collect_list(F.struct("target_field", mapping.alias("text")))).alias("fields"))
    told = F.concat(
        F.lit('{"mappings":['), F.array_join(F.col("fields.text"), ","), F.lit('],"source_id":'), json_text(F.col("source_id")),
        F.lit(',"target_schema":'), json_text(F.col("target_schema")), F.lit(',"target_version":'), F.col("target_version").cast("string"), F.lit("}"),
    )
    return whole.select(*SPEC, *more, F.substring(F.sha2(told, 256), 1, HASH_DIGITS).alias("content_hash"))


def faults(table: DataFrame, schema: TargetSchema) -> DataFrame:
    """source_id, target_field and fault of what keeps specs from being compiled for a schema: the checks of validate_spec, for all specs at once.

    "unknown": the schema has no such field; "missing": the spec has none; "cast": not exactly one cast, as the last step; "dtype": the cast is to another dtype.
    """
    fields = F.array(*[F.struct(F.lit(f.name).alias("target_field"), F.lit(f.dtype).alias("dtype")) for f in schema.fields])
    wanted = table.select("source_id").distinct().select("source_id", F.inline(fields))
    own = table.select(F.col("source_id").alias("s"), F.col("target_field").alias("f"), (F.col("source_column").isNotNull() | F.col("literal").isNotNull()).alias("mapped"), "transforms")
    both = wanted.join(own, F.col("source_id").eqNullSafe(F.col("s")) & (F.col("target_field") == F.col("f")), "full")
    casts = F.filter("transforms", lambda t: t["op"] == "cast")
    last = F.get("transforms", F.size("transforms") - 1)["op"]
    told = (
        F.when(F.col("target_field").isNull(), F.lit("unknown"))
        .when(F.col("f").isNull(), F.lit("missing"))
        .when(~F.col("mapped"), F.lit(None))
        .when((F.size(F.coalesce(casts, F.array().cast(dict(own.dtypes)["transforms"]))) != 1) | ~last.eqNullSafe(F.lit("cast")), F.lit("cast"))
        .when(~F.get_json_object(F.get(casts, F.lit(0))["args"], "$.dtype").eqNullSafe(F.col("dtype")), F.lit("dtype"))
    )
    return both.select(F.coalesce("source_id", "s").alias("source_id"), F.coalesce("target_field", "f").alias("target_field"), told.alias("fault")).filter("fault is not null")


def differences(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """keys, target_field, before and after (source_column, and transforms as JSON; null where the field is absent) of the fields that differ between two tables of specs."""
    on = [*keys, "target_field"]
    sides = {}
    for name, table in (("before", old), ("after", new)):
        seen = F.struct("source_column", transforms_json(F.col("transforms")).alias("transforms"))
        sides[name] = table.select(*[F.col(c).alias(f"{name}_{c}") for c in on], seen.alias(name))
    same = reduce(lambda a, b: a & b, [F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")) for c in on])
    both = sides["before"].join(sides["after"], same, "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).select(*[F.coalesce(f"before_{c}", f"after_{c}").alias(c) for c in on], "before", "after")


def versions(saves: DataFrame) -> DataFrame:
    """source_id, version, parent_id, content_hash, saved_at of rows (source_id, saved_at, content_hash): a save that means what the one before means is no version."""
    order = Window.partitionBy("source_id").orderBy("saved_at")
    fresh = saves.withColumn("before", F.lag("content_hash").over(order)).filter(~F.col("content_hash").eqNullSafe(F.col("before")) | F.col("before").isNull())
    numbered = fresh.withColumn("version", F.row_number().over(order))
    parent = F.when(F.col("version") > 1, F.concat("source_id", F.lit("-v"), (F.col("version") - 1).cast("string")))
    return numbered.select("source_id", "version", parent.alias("parent_id"), "content_hash", "saved_at")


def heads(versions: DataFrame) -> DataFrame:
    """The newest version of each source."""
    newest = F.max_by(F.struct("parent_id", "content_hash", "saved_at"), "version").alias("of")
    return versions.groupBy("source_id").agg(F.max("version").alias("version"), newest).select("source_id", "version", "of.*")
