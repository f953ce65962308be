"""Files as inputs and outputs."""

from .files import FORMATS, ReadRequest, ReadResult, Resource, RetrySafety, Root, WriteMode, WriteResult, infer_format, pushdown, read, read_file, write_file
from .registry import READERS, WRITERS, Registry

__all__ = ["FORMATS", "READERS", "ReadRequest", "ReadResult", "Registry", "Resource", "RetrySafety", "Root", "WRITERS", "WriteMode", "WriteResult", "infer_format", "pushdown", "read", "read_file", "write_file"]
