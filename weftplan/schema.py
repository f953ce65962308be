"""Fields and schemas: ordered, immutable, case-sensitive."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import types as S

from .errors import SchemaError
from .types import DataType, Struct, _note, decode, encode, from_spark, to_spark


@dataclass(frozen=True)
class Field:
    name: str
    type: DataType
    nullable: bool = True
    description: str | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name.strip():
            raise SchemaError("a field needs a name")
        if not isinstance(self.type, DataType):
            raise SchemaError(f"{self.name}: {self.type!r} is no logical type")


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise SchemaError(f"duplicate field {next(n for n in names if names.count(n) > 1)!r}")

    @classmethod
    def of(cls, *fields: Field | tuple) -> Schema:
        return cls(tuple(f if isinstance(f, Field) else Field(*f) for f in fields))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __iter__(self):  # noqa: ANN204
        return iter(self.fields)

    def __len__(self) -> int:
        return len(self.fields)

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError(f"no field {name!r}; there are {', '.join(self.names) or 'none'}")

    def resolve(self, path: str) -> tuple[DataType, bool]:
        """(type, nullable) of a dotted path through structs; nullable if any level is."""
        root, *rest = path.split(".")
        f = self.field(root)
        kind, nullable = f.type, f.nullable
        for name in rest:
            if not isinstance(kind, Struct):
                raise SchemaError(f"{path!r}: {kind} has no members")
            m = next((m for m in kind.members if m.name == name), None)
            if m is None:
                raise SchemaError(f"{path!r}: no member {name!r}")
            kind, nullable = m.type, nullable or m.nullable
        return kind, nullable

    def select(self, names: Iterable[str]) -> Schema:
        return Schema(tuple(self.field(n) for n in names))

    def drop(self, names: Iterable[str]) -> Schema:
        gone = {self.field(n).name for n in names}
        return Schema(tuple(f for f in self.fields if f.name not in gone))

    def rename(self, mapping: dict[str, str]) -> Schema:
        """All at once, so names can be swapped."""
        for n in mapping:
            self.field(n)
        return Schema(tuple(replace(f, name=mapping.get(f.name, f.name)) for f in self.fields))

    def append(self, *fields: Field) -> Schema:
        return Schema(self.fields + fields)

    def replace(self, field: Field) -> Schema:
        """The field of that name, in its place."""
        self.field(field.name)
        return Schema(tuple(field if f.name == field.name else f for f in self.fields))

    def to_spark(self) -> S.StructType:
        return S.StructType([S.StructField(f.name, to_spark(f.type), f.nullable, _note(f.type) | ({"comment": f.description} if f.description else {})) for f in self.fields])

    @classmethod
    def from_spark(cls, struct: S.StructType) -> Schema:
        return cls(tuple(Field(f.name, from_spark(f.dataType, f.metadata), f.nullable, f.metadata.get("comment")) for f in struct.fields))

    def encode(self) -> list[dict]:
        return [{"name": f.name, "type": encode(f.type), "nullable": f.nullable} | ({"description": f.description} if f.description else {}) for f in self.fields]

    @classmethod
    def decode(cls, rows: list[dict]) -> Schema:
        return cls(tuple(Field(r["name"], decode(r["type"]), r.get("nullable", True), r.get("description")) for r in rows))
