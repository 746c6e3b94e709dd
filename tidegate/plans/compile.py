"""A spec as one projection: DataFrame columns, SQL scripts, and a PySpark module.

One select in schema field order; Catalyst prunes the scan to the source columns
in use. The texts and the columns come from the same expressions.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.ops import DUCKDB, SPARK, CompileError, Dialect, render
from tidegate.plans.spec import FieldMapping, MappingSpec, validate_spec
from tidegate.schema import SRC_ROW, TargetSchema


def field_sql(m: FieldMapping, dtype: str, dialect: Dialect = SPARK) -> str:
    """The typed expression of one field; a literal is cast only, an unmapped field is null."""
    if m.source_column is not None:
        return render(dialect.name_of(m.source_column), list(m.transforms), dtype, dialect)
    if m.literal is not None:
        return dialect.cast(dialect.text(m.literal), dtype)
    return dialect.null(dtype)


def projection(spec: MappingSpec, schema: TargetSchema, dialect: Dialect = SPARK) -> list[tuple[str, str]]:
    """(field, expression) in schema order."""
    validate_spec(spec, schema)
    return [(f.name, field_sql(spec.mapping(f.name), f.dtype, dialect)) for f in schema.fields]


def missing_columns(spec: MappingSpec, columns: list[str]) -> list[str]:
    return sorted(set(spec.required_columns) - set(columns))


def transform(landed: DataFrame, spec: MappingSpec, schema: TargetSchema) -> DataFrame:
    """The landed rows as typed target rows, _src_row first where there is one. Runs on streams too."""
    if absent := missing_columns(spec, landed.columns):
        raise CompileError(f"the source has no columns {absent}")
    lineage = [F.col(SRC_ROW)] if SRC_ROW in landed.columns else []
    return landed.select(*lineage, *[F.expr(sql).alias(name) for name, sql in projection(spec, schema)])


def compile_select(spec: MappingSpec, schema: TargetSchema, source: str, dialect: Dialect = SPARK) -> str:
    """One SELECT over ``source`` (a table name or table function of the dialect)."""
    columns = [f"{sql} AS {dialect.name_of(name)}" for name, sql in projection(spec, schema, dialect)]
    return f"SELECT {dialect.name_of(SRC_ROW)},\n  " + ",\n  ".join(columns) + f"\nFROM {source}"


def compile_script(spec: MappingSpec, schema: TargetSchema, path: str, dialect: Dialect = SPARK) -> str:
    """A standalone script over a Parquet path."""
    source = f"read_parquet({DUCKDB.text(path)})" if dialect is DUCKDB else f"parquet.{SPARK.name_of(path)}"
    return f"-- {spec.source_id} to {schema.slug}, version {spec.version}, {spec.content_hash()}\n{compile_select(spec, schema, source, dialect)};\n"


def render_module(spec: MappingSpec, schema: TargetSchema) -> str:
    """A standalone PySpark module with transform(df)."""
    needed = spec.required_columns
    digest = hashlib.sha256(json.dumps(needed).encode()).hexdigest()[:16]
    columns = "\n".join(f"    ({name!r}, {sql!r})," for name, sql in projection(spec, schema))
    return f'''"""{spec.source_id} to {schema.slug}, version {spec.version}, {spec.content_hash()}. Generated; columns {digest}."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_COLUMNS = {needed!r}
FIELDS = [
{columns}
]


def transform(df: DataFrame) -> DataFrame:
    lineage = [F.col({SRC_ROW!r})] if {SRC_ROW!r} in df.columns else []
    return df.select(*lineage, *[F.expr(sql).alias(name) for name, sql in FIELDS])
'''
