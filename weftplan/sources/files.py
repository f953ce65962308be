"""CSV, JSON lines, Parquet and Arrow files through Spark's readers and writers."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from enum import StrEnum
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ResourceError, SchemaError, UnknownOutcomeError
from ..functions.expr import Expr, Op
from ..functions.lowering import column, quoted
from ..functions.typing import boolean
from ..schema import Schema

# Suffixes and media types of the formats.
FORMATS = {"csv": (".csv",), "jsonl": (".jsonl", ".ndjson"), "parquet": (".parquet",), "arrow": (".arrow", ".feather", ".ipc")}
MEDIA = {"text/csv": "csv", "application/csv": "csv", "application/x-ndjson": "jsonl", "application/jsonl": "jsonl", "application/x-jsonlines": "jsonl", "application/vnd.apache.parquet": "parquet", "application/x-parquet": "parquet", "application/vnd.apache.arrow.file": "arrow"}


#: Times in text files, with all their microseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}
#: Bytes of an Arrow file that may pass through the driver; writing one is held to spark.driver.maxResultSize.
ARROW_LIMIT = 1 << 30


@dataclass(frozen=True)
class Resource:
    """Where data is: a URI and a media type, never a handle or a secret."""

    uri: str
    media_type: str | None = None
    metadata: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if not self.uri.strip():
            raise ResourceError("a resource needs a URI")

    @property
    def scheme(self) -> str:
        return urlsplit(self.uri).scheme if re.match(r"\w[\w+.-]*://|file:", self.uri) else "file"

    @property
    def path(self) -> str:
        return unquote(urlsplit(self.uri).path) if re.match(r"\w[\w+.-]*://|file:", self.uri) else self.uri


class WriteMode(StrEnum):
    CREATE_NEW = "create_new"
    FAIL_IF_EXISTS = "fail_if_exists"
    REPLACE = "replace"
    APPEND = "append"


class RetrySafety(StrEnum):
    SAFE = "safe"
    UNSAFE = "unsafe"
    UNKNOWN = "unknown"


@dataclass(frozen=True)
class WriteResult:
    uri: str
    format: str
    mode: WriteMode
    status: str = "succeeded"


@dataclass(frozen=True)
class Root:
    """A folder that resources must stay within."""

    path: str

    def resolve(self, resource: Resource) -> str:
        if resource.scheme != "file":
            raise ResourceError(f"{resource.scheme!r} is no local file")
        base = Path(self.path).resolve()
        full = (base / resource.path).resolve()
        if full != base and base not in full.parents:
            raise ResourceError(f"{resource.uri!r} leaves its root")
        return str(full)


def infer_format(resource: Resource) -> str:
    """By media type first, then by suffix."""
    if resource.media_type:
        name = MEDIA.get(resource.media_type.split(";")[0].strip().lower())
        if name:
            return name
    suffix = Path(resource.path).suffix.lower()
    for name, suffixes in FORMATS.items():
        if suffix in suffixes:
            return name
    raise ResourceError(f"no format is known for {resource.uri!r}")


@dataclass(frozen=True)
class ReadRequest:
    """What to read: some columns, rows where a predicate holds, some hive partitions (Parquet)."""

    resource: Resource
    schema: Schema | None = None
    columns: tuple[str, ...] = ()
    predicate: Expr | None = None
    partition_filters: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if len(set(self.columns)) < len(self.columns) or any(not c for c in self.columns):
            raise ResourceError("columns must be different names")


@dataclass(frozen=True)
class ReadResult:
    df: DataFrame
    schema: Schema
    #: not_requested, source or post_scan for projection, predicate and partition pruning.
    evidence: dict[str, str]


def _load(spark: SparkSession, path: str, form: str, schema: Schema | None) -> DataFrame:
    reader = spark.read.options(**TIMES) if form in ("csv", "jsonl") else spark.read
    if schema is not None and form != "arrow":
        reader = reader.schema(schema.to_spark())
    match form:
        case "csv":
            return reader.option("header", True).option("inferSchema", schema is None).option("mode", "FAILFAST").csv(path)
        case "jsonl":
            return reader.option("mode", "FAILFAST").json(path)
        case "parquet":
            return reader.parquet(path)
    # Spark has no reader for Arrow files: one file goes through the driver
    import pyarrow as pa

    system, place = _arrow_files(path)
    if (size := system.get_file_info(place).size or 0) > ARROW_LIMIT:
        raise ResourceError(f"{path!r} has {size} bytes; more than {ARROW_LIMIT} must not pass through the driver, use Parquet")
    with system.open_input_file(place) as f:
        return spark.createDataFrame(pa.ipc.open_file(f).read_all())


def _arrow_files(path: str):  # noqa: ANN202
    """(file system, path) of an Arrow file, for the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read(spark: SparkSession, request: ReadRequest, root: Root | None = None) -> ReadResult:
    """A lazy DataFrame; Catalyst pushes columns and predicates into the scan where the format can take them."""
    form = infer_format(request.resource)
    if request.partition_filters and form != "parquet":
        raise ResourceError("partition filters need Parquet")
    path = root.resolve(request.resource) if root else request.resource.uri
    try:
        df = _load(spark, path, form, request.schema)
    except FileNotFoundError as e:
        raise ResourceError(f"{request.resource.uri!r} does not exist") from e
    schema, whole = Schema.from_spark(df.schema), df
    evidence = {"projection": "not_requested", "predicate": "not_requested", "partition_pruning": "not_requested"}
    for name, value in request.partition_filters:
        schema.field(name)
        df = df.where(F.col(quoted(name)).cast("string") == F.lit(value) if schema.field(name).type.__class__.__name__ != "String" else F.col(quoted(name)) == F.lit(value))
    if request.partition_filters:
        used = " ".join(pushdown(df)["PartitionFilters"])
        evidence["partition_pruning"] = "source" if all(re.search(rf"\b{re.escape(n)}#", used) for n, _ in request.partition_filters) else "post_scan"
    if request.predicate is not None:
        boolean(request.predicate, schema, "a predicate")
        evidence["predicate"] = "source" if form == "parquet" and all(_pushed(whole, c, schema) for c in _conjuncts(request.predicate)) else "post_scan"
        df = df.where(column(request.predicate, schema))
    if request.columns:
        left = set(schema.names) - set(request.columns) - ({p.split(".")[0] for p in request.predicate.columns()} if request.predicate is not None else set())
        schema = schema.select(request.columns)
        df = df.select(*(F.col(quoted(c)) for c in request.columns))
        seen = " ".join(pushdown(df)["ReadSchema"])
        evidence["projection"] = "source" if form == "parquet" and not any(re.search(rf"[<,]{re.escape(c)}:", seen) for c in left) else "post_scan"
    return ReadResult(df, schema, evidence)


def _conjuncts(e: Expr) -> list[Expr]:
    return [c for x in e.args for c in _conjuncts(x)] if isinstance(e, Op) and e.op == "and" else [e]


def _pushed(df: DataFrame, e: Expr, schema: Schema) -> bool:
    """Whether the scan itself gets a filter for this condition, or for the partitions it is about."""
    seen = pushdown(df.where(column(e, schema)))
    implied = "" if isinstance(e, Op) and e.op == "not_null" else "IsNotNull"  # Spark adds it to any comparison
    pushed = [f for x in seen["PushedFilters"] for f in re.findall(r"(\w+)\(", x) if f != implied]
    return bool(pushed or any(x.strip() not in ("", "[]") for x in seen["PartitionFilters"]))


def pushdown(df: DataFrame) -> dict[str, list[str]]:
    """What the scans of a DataFrame got, from Spark's own plan: PushedFilters, PartitionFilters and ReadSchema."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {key: re.findall(rf"^{key}: (.*)$", text, re.M) for key in ("PushedFilters", "PartitionFilters", "ReadSchema")}


def read_file(spark: SparkSession, resource: Resource, schema: Schema, credential: str | None = None) -> DataFrame:
    if credential is not None:
        raise ResourceError("local files take no credential")
    return read(spark, ReadRequest(resource, schema)).df


def write_file(spark: SparkSession, resource: Resource, df: DataFrame, mode: WriteMode = WriteMode.CREATE_NEW, retry_safety: RetrySafety = RetrySafety.UNKNOWN, credential: str | None = None, root: Root | None = None) -> WriteResult:
    """A folder of part files (Arrow: one file, by the driver).

    All is written aside first and then put in place by renaming, so a job that fails leaves the target as it was, and a
    plan may replace a file that it reads. REPLACE keeps the old data until the new is in place. Where renaming itself
    fails midway, or a job that appends, the outcome is unknown. (In object stores a rename of a folder is no single act.)
    """
    form, mode = infer_format(resource), WriteMode(mode)
    if credential is not None:
        raise ResourceError("local files take no credential")
    if mode == WriteMode.APPEND and form not in ("csv", "jsonl"):
        raise ResourceError(f"{form} cannot be appended to")
    if mode == WriteMode.APPEND and retry_safety == RetrySafety.SAFE:
        raise ResourceError("an append is not safe to retry")
    path = (root.resolve(resource) if root else resource.uri).rstrip("/")
    files = _Files(spark, path)
    if mode in (WriteMode.CREATE_NEW, WriteMode.FAIL_IF_EXISTS) and files.exists(path):
        raise ResourceError(f"{resource.uri!r} exists")
    if mode == WriteMode.APPEND:
        try:
            _save(df, form, path, "append")
        except Exception as e:
            raise UnknownOutcomeError(f"appending to {resource.uri!r} failed midway: {str(e).splitlines()[0]}") from e
        return WriteResult(resource.uri, form, mode)
    folder, _, name = path.rpartition("/")
    aside, old = (f"{folder}/" * bool(_) + f"_{name}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    try:
        _save(df, form, aside, "errorifexists")
    except SchemaError:
        raise
    except Exception as e:
        files.drop(aside)
        raise ResourceError(f"writing {resource.uri!r} failed, nothing changed: {str(e).splitlines()[0]}") from e
    if mode != WriteMode.REPLACE and files.exists(path):
        files.drop(aside)
        raise ResourceError(f"{resource.uri!r} exists meanwhile")
    try:
        had = files.exists(path)
        if had:
            files.move(path, old)
        try:
            files.move(aside, path)
        except Exception:
            if had:
                files.move(old, path)
            raise
    except Exception as e:
        raise UnknownOutcomeError(f"{resource.uri!r} was written to {aside!r}, but not put in place: {str(e).splitlines()[0]}") from e
    if had:
        files.drop(old)
    return WriteResult(resource.uri, form, mode)


class _Files:
    """Existence, renaming and removal in a path's Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def move(self, a: str, b: str) -> None:
        if not self._fs.rename(self._path(a), self._path(b)):
            raise OSError(f"{a!r} cannot be renamed to {b!r}")

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def _save(df: DataFrame, form: str, path: str, how: str) -> None:
    if form == "arrow":
        import pyarrow as pa

        table = df.toArrow()
        system, place = _arrow_files(path)
        system.create_dir(place.rpartition("/")[0] or ".", recursive=True)
        with system.open_output_stream(place) as f, pa.ipc.new_file(f, table.schema) as w:
            w.write_table(table)
    elif form == "csv":
        df.write.mode(how).options(**TIMES).option("header", True).csv(path)
    elif form == "jsonl":
        df.write.mode(how).options(**TIMES).option("ignoreNullFields", False).json(path)
    else:
        df.write.mode(how).parquet(path)
