"""Schema documents in YAML: one schema or several by name. Needs PyYAML."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from .errors import DeclarationError, SchemaError
from .schema import Field, Schema
from .types import decode

MAX_BYTES, MAX_DEPTH, MAX_SCHEMAS, MAX_FIELDS, MAX_NODES = 1 << 20, 64, 256, 10_000, 50_000


def _yaml():  # noqa: ANN202
    try:
        import yaml
    except ImportError as e:
        raise DeclarationError("schema documents need PyYAML") from e
    return yaml


def _parse(text: str) -> Any:
    """Plain data only: no tags, aliases, duplicate keys; limits hold while parsing."""
    yaml = _yaml()
    if len(text.encode()) > MAX_BYTES:
        raise DeclarationError(f"longer than {MAX_BYTES} bytes")

    class Loader(yaml.SafeLoader):
        def compose_node(self, parent, index):  # noqa: ANN001, ANN202
            if self.check_event(yaml.AliasEvent):
                raise DeclarationError("aliases are not allowed")
            self.depth, self.nodes = getattr(self, "depth", 0) + 1, getattr(self, "nodes", 0) + 1
            if self.depth > MAX_DEPTH or self.nodes > MAX_NODES:
                raise DeclarationError("too deep or too many nodes")
            event = self.peek_event()
            if getattr(event, "anchor", None) or getattr(event, "tag", None):
                raise DeclarationError("anchors and tags are not allowed")
            out = super().compose_node(parent, index)
            self.depth -= 1
            return out

        def construct_mapping(self, node, deep=False):  # noqa: ANN001, ANN202
            keys = [k.value for k, _ in node.value]
            if len(set(keys)) < len(keys):
                raise DeclarationError(f"key {next(k for k in keys if keys.count(k) > 1)!r} occurs twice")
            return super().construct_mapping(node, deep)

    try:
        docs = list(yaml.load_all(text, Loader))  # noqa: S506  a SafeLoader
    except DeclarationError:
        raise
    except yaml.YAMLError as e:
        raise DeclarationError(f"not YAML: {str(e).splitlines()[0]}") from e
    if len(docs) != 1:
        raise DeclarationError("exactly one document is needed")
    return docs[0]


def _schema(body: Any, path: str) -> Schema:
    if not isinstance(body, dict) or not isinstance(body.get("fields"), list) or not body["fields"]:
        raise DeclarationError("a schema needs fields", path)
    if extra := set(body) - {"name", "fields", "description"}:
        raise DeclarationError(f"unknown key {sorted(map(str, extra))[0]!r}", path)
    if len(body["fields"]) > MAX_FIELDS:
        raise DeclarationError(f"over {MAX_FIELDS} fields", path)
    out = []
    for i, f in enumerate(body["fields"]):
        at = f"{path}.fields[{i}]"
        if not isinstance(f, dict) or not isinstance(f.get("name"), str) or "type" not in f:
            raise DeclarationError("a field needs a name and a type", at)
        if extra := set(f) - {"name", "type", "nullable", "description"}:
            raise DeclarationError(f"unknown key {sorted(map(str, extra))[0]!r}", at)
        if not isinstance(f.get("nullable", True), bool) or not isinstance(f.get("description", ""), str):
            raise DeclarationError("nullable is true or false, description a text", at)
        try:
            out.append(Field(f["name"], decode(f["type"]), f.get("nullable", True), f.get("description")))
        except SchemaError as e:
            raise DeclarationError(str(e), f"{at}.type") from e
    try:
        return Schema(tuple(out))
    except SchemaError as e:
        raise DeclarationError(str(e), path) from e


def _document(text: str) -> tuple[dict[str, Schema], bool]:
    """(schemas by name, whether the document is of the one-schema kind)."""
    doc = _parse(text)
    if not isinstance(doc, dict) or doc.get("version") != 1 or isinstance(doc.get("version"), bool):
        raise DeclarationError("version: 1 is needed")
    if set(doc) == {"version", "schema"}:
        name = doc["schema"].get("name") if isinstance(doc["schema"], dict) else None
        if not isinstance(name, str) or not name.strip():
            raise DeclarationError("a schema needs a name", "$.schema")
        return {name: _schema(doc["schema"], "$.schema")}, True
    if set(doc) == {"version", "schemas"} and isinstance(doc["schemas"], dict) and doc["schemas"]:
        if len(doc["schemas"]) > MAX_SCHEMAS:
            raise DeclarationError(f"over {MAX_SCHEMAS} schemas", "$.schemas")
        return {str(k): _schema(v, f"$.schemas.{k}") for k, v in doc["schemas"].items()}, False
    raise DeclarationError("either schema or schemas is needed")


def loads_schema(text: str, name: str | None = None) -> Schema:
    """The only schema of a document, or the named one."""
    found, _ = _document(text)
    if name is not None:
        if name not in found:
            raise DeclarationError(f"no schema {name!r}")
        return found[name]
    if len(found) != 1:
        raise DeclarationError(f"there are {len(found)} schemas; name one")
    return next(iter(found.values()))


def loads_schemas(text: str) -> dict[str, Schema]:
    return _document(text)[0]


def _text(path: str | Path) -> str:
    p = Path(path)
    if p.suffix.lower() not in (".yml", ".yaml"):
        raise DeclarationError(f"{p.name} is no .yml or .yaml file")
    try:
        if p.stat().st_size > MAX_BYTES:
            raise DeclarationError(f"longer than {MAX_BYTES} bytes")
        return p.read_text("utf-8")
    except UnicodeDecodeError as e:
        raise DeclarationError("not UTF-8") from e


def load_schema(path: str | Path, name: str | None = None) -> Schema:
    return loads_schema(_text(path), name)


def load_schemas(path: str | Path) -> dict[str, Schema]:
    return loads_schemas(_text(path))


def dumps_schema(schema: Schema, name: str) -> str:
    """Canonical: fixed key order, two spaces, a newline at the end."""
    return _yaml().safe_dump({"version": 1, "schema": {"name": name, "fields": schema.encode()}}, sort_keys=False, allow_unicode=True)


def dumps_schemas(schemas: dict[str, Schema]) -> str:
    if not schemas:
        raise DeclarationError("no schema to write")
    return _yaml().safe_dump({"version": 1, "schemas": {k: {"fields": s.encode()} for k, s in schemas.items()}}, sort_keys=False, allow_unicode=True)


def dump_schema(schema: Schema, path: str | Path, name: str) -> None:
    Path(path).write_text(dumps_schema(schema, name), "utf-8")


def dump_schemas(schemas: dict[str, Schema], path: str | Path) -> None:
    Path(path).write_text(dumps_schemas(schemas), "utf-8")
