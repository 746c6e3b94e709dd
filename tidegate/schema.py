"""Target schemas: dtypes, constraints, fields, and the registry of schema files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from functools import lru_cache
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

SRC_ROW = "_src_row"

#: Target dtype -> Spark type. ``decimal`` is a 64-bit float by definition.
SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "decimal": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}


class SchemaError(ValueError):
    """A schema file or object that contradicts itself."""


def _known(kind: type, given: dict[str, Any], where: str) -> dict[str, Any]:
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise SchemaError(f"{where}: unknown keys {sorted(unknown)}")
    return given


def normalise_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


@dataclass(frozen=True)
class Constraints:
    enum: tuple[str, ...] | None = None
    pattern: str | None = None
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    unique: bool = False


@dataclass(frozen=True)
class TargetField:
    name: str
    dtype: str
    nullable: bool = True
    description: str = ""
    aliases: tuple[str, ...] = ()
    constraints: Constraints = Constraints()
    examples: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        c, text, number = self.constraints, self.dtype == "string", self.dtype in ("integer", "decimal")
        faults = [
            (self.dtype not in SPARK_TYPES, f"dtype must be one of {sorted(SPARK_TYPES)}"),
            (not number and (c.min is not None or c.max is not None), "min and max need a numeric dtype"),
            (not text and (c.pattern is not None or c.min_length is not None or c.max_length is not None), "pattern and lengths need a string dtype"),
            (c.min is not None and c.max is not None and c.min > c.max, "min exceeds max"),
            (c.min_length is not None and c.max_length is not None and c.min_length > c.max_length, "min_length exceeds max_length"),
            (c.enum is not None and (not c.enum or len(set(c.enum)) < len(c.enum)), "enum must have members, each once"),
        ]
        if c.pattern is not None:
            try:
                re.compile(c.pattern)
            except re.error as e:
                faults.append((True, f"pattern does not compile: {e}"))
        for wrong, what in faults:
            if wrong:
                raise SchemaError(f"{self.name}: {what}")

    @property
    def normalised_aliases(self) -> list[str]:
        return list(dict.fromkeys(normalise_name(a) for a in (self.name, *self.aliases)))

    @property
    def embedding_text(self) -> str:
        """The text that stands for the field where columns are matched by meaning."""
        last = ""
        if self.constraints.enum:
            last = "one of: " + ", ".join(self.constraints.enum)
        elif self.examples:
            last = "for example: " + ", ".join(self.examples[:3])
        return ". ".join(p for p in (self.name.replace("_", " "), self.description.strip(), last) if p)

    @classmethod
    def of(cls, given: dict[str, Any]) -> TargetField:
        given = dict(_known(cls, given, f"field {given.get('name')}"))
        limits = dict(_known(Constraints, given.get("constraints") or {}, f"constraints of {given.get('name')}"))
        if limits.get("enum") is not None:
            limits["enum"] = tuple(limits["enum"])
        lists = {k: tuple(map(str, given.get(k) or ())) for k in ("aliases", "examples")}
        return cls(**(given | lists | {"constraints": Constraints(**limits)}))


@dataclass(frozen=True)
class TargetSchema:
    name: str
    version: int
    fields: tuple[TargetField, ...]
    title: str = ""
    description: str = ""
    primary_key: tuple[str, ...] = ()
    _by_name: dict[str, TargetField] = field(default_factory=dict, repr=False, compare=False)

    def __post_init__(self) -> None:
        if self.version < 1:
            raise SchemaError(f"{self.name}: version starts at 1")
        if not self.fields:
            raise SchemaError(f"{self.name}: no fields")
        self._by_name.update({f.name: f for f in self.fields})
        if len(self._by_name) < len(self.fields):
            raise SchemaError(f"{self.name}: field names repeat")
        for key in self.primary_key:
            if key not in self._by_name:
                raise SchemaError(f"{self.name}: primary key field {key} does not exist")
            if self._by_name[key].nullable:
                raise SchemaError(f"{self.name}: primary key field {key} is nullable")

    @property
    def slug(self) -> str:
        return f"{self.name}_v{self.version}"

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> TargetField:
        return self._by_name[name]

    @property
    def struct(self) -> T.StructType:
        """The Spark schema of a transformed table, with lineage first."""
        own = [T.StructField(f.name, SPARK_TYPES[f.dtype], True, {"description": f.description}) for f in self.fields]
        return T.StructType([T.StructField(SRC_ROW, T.LongType()), *own])

    @classmethod
    def of(cls, given: dict[str, Any]) -> TargetSchema:
        allowed = {f.name for f in fields(cls) if not f.name.startswith("_")}
        if unknown := set(given) - allowed:
            raise SchemaError(f"unknown keys {sorted(unknown)}")
        own = tuple(TargetField.of(f) for f in given.get("fields") or ())
        return cls(**(given | {"fields": own, "primary_key": tuple(given.get("primary_key") or ())}))


DEFAULT_DIR = Path(__file__).parent / "schemas"


@lru_cache(maxsize=64)
def _parsed(path: str, stamp: float) -> TargetSchema:
    schema = TargetSchema.of(yaml.safe_load(Path(path).read_text("utf-8")))
    if Path(path).stem != schema.slug:
        raise SchemaError(f"{path} holds {schema.slug}; the file must be named after it")
    return schema


def load_schema(name: str, version: int | None = None, folder: str | Path = DEFAULT_DIR) -> TargetSchema:
    """A schema by name (latest version), name and version, or slug such as ``orders_v1``; KeyError if unknown."""
    found = {s.slug: s for s in list_schemas(folder)}
    if name in found and version is None:
        return found[name]
    versions = [s for s in found.values() if s.name == name and version in (None, s.version)]
    if not versions:
        raise KeyError(f"no schema {name}" + (f" version {version}" if version else ""))
    return max(versions, key=lambda s: s.version)


def list_schemas(folder: str | Path = DEFAULT_DIR) -> list[TargetSchema]:
    """All schemas of a folder by name and version; files are parsed again only after a change."""
    paths = sorted(Path(folder).glob("*_v*.yaml"))
    return sorted((_parsed(str(p), os.path.getmtime(p)) for p in paths), key=lambda s: (s.name, s.version))
