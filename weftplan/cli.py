"""Command line: version, doctor, schema, engines, contract."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from enum import IntEnum
from pathlib import Path

from . import __version__
from .errors import DeclarationError, WeftError


class Exit(IntEnum):
    # Exit codes of the command.
    SUCCESS = 0
    GENERAL_ERROR = 1
    INVALID_USAGE = 2
    INVALID_SCHEMA = 10
    MISSING_OPTIONAL_DEPENDENCY = 11
    FILESYSTEM_ERROR = 12
    UNSUPPORTED_OPERATION = 13
    INTERNAL_ERROR = 70
    INTERRUPTED = 130
    BROKEN_PIPE = 141


def _doctor() -> tuple[dict, Exit]:
    from importlib.util import find_spec

    found = {m: find_spec(m) is not None for m in ("pyspark", "pyarrow", "pandas", "yaml")}
    return {"python": sys.version.split()[0], "modules": found}, Exit.SUCCESS if found["pyspark"] else Exit.MISSING_OPTIONAL_DEPENDENCY


def _schema(args: argparse.Namespace) -> tuple[object, Exit]:
    from .schema_yaml import dumps_schema, dumps_schemas, load_schemas

    schemas = load_schemas(args.file)
    match args.action:
        case "validate":
            return {"valid": True, "schemas": sorted(schemas)}, Exit.SUCCESS
        case "inspect":
            return {n: [f"{f.name}: {f.type}{'' if f.nullable else ' not null'}" for f in s] for n, s in schemas.items()}, Exit.SUCCESS
        case "format":
            text = dumps_schemas(schemas) if len(schemas) > 1 else dumps_schema(*next(iter(schemas.items()))[::-1])
            if args.check:
                same = Path(args.file).read_text("utf-8") == text
                return {"formatted": same}, Exit.SUCCESS if same else Exit.GENERAL_ERROR
            return text, Exit.SUCCESS
    name, schema = next(iter(schemas.items())) if len(schemas) == 1 else (args.name, schemas.get(args.name))
    if schema is None:
        raise DeclarationError("name one of " + ", ".join(schemas))
    if args.to == "spark":
        return json.loads(schema.to_spark().json()), Exit.SUCCESS
    if args.to == "ddl":
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.to_spark().fields), Exit.SUCCESS
    from pyspark.sql.pandas.types import to_arrow_schema

    return str(to_arrow_schema(schema.to_spark())), Exit.SUCCESS


def _engines(args: argparse.Namespace) -> tuple[object, Exit]:
    from .runtime.capabilities import CONFORMANCE, SPARK

    if args.action == "list":
        return ["spark"], Exit.SUCCESS
    if args.engine != "spark":
        return {"error": f"no engine {args.engine!r}"}, Exit.UNSUPPORTED_OPERATION
    return {"engine": "spark", "capabilities": sorted(SPARK), "conformance": {str(k): v for k, v in CONFORMANCE.items()}}, Exit.SUCCESS


def _contract() -> tuple[object, Exit]:
    from .operators import OPERATORS
    from .wire import CONTRACTS

    return {"contracts": {c.name: c.version for c in CONTRACTS.values()}, "operators": sorted(OPERATORS)}, Exit.SUCCESS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftplan", description=__doc__)
    p.add_argument("--json", action="store_true", help="print JSON")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("doctor")
    s = sub.add_parser("schema").add_subparsers(dest="action", required=True)
    for action in ("validate", "inspect", "format", "convert"):
        a = s.add_parser(action)
        a.add_argument("file")
        if action == "format":
            a.add_argument("--check", action="store_true")
        if action == "convert":
            a.add_argument("--to", choices=("spark", "ddl", "arrow"), default="spark")
            a.add_argument("--name")
    e = sub.add_parser("engines").add_subparsers(dest="action", required=True)
    e.add_parser("list")
    e.add_parser("inspect").add_argument("engine")
    sub.add_parser("contract").add_subparsers(dest="action", required=True).add_parser("inspect")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return Exit.INVALID_USAGE if e.code else Exit.SUCCESS
    try:
        out, code = {"version": lambda: ({"version": __version__}, Exit.SUCCESS), "doctor": _doctor, "schema": lambda: _schema(args), "engines": lambda: _engines(args), "contract": _contract}[args.command]()
    except DeclarationError as e:
        print(e, file=sys.stderr)
        return Exit.MISSING_OPTIONAL_DEPENDENCY if "need PyYAML" in str(e) else Exit.INVALID_SCHEMA
    except OSError as e:
        print(e, file=sys.stderr)
        return Exit.FILESYSTEM_ERROR
    except WeftError as e:
        print(e, file=sys.stderr)
        return Exit.UNSUPPORTED_OPERATION
    except KeyboardInterrupt:
        return Exit.INTERRUPTED
    try:
        print(json.dumps(out, indent=None if args.json else 2, ensure_ascii=False) if args.json or not isinstance(out, str) else out.rstrip("\n"))
    except BrokenPipeError:
        return Exit.BROKEN_PIPE
    return code


if __name__ == "__main__":
    sys.exit(main())
