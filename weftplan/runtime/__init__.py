"""Execution: sessions, bindings, capabilities, evidence."""

from .capabilities import SPARK, check, required
from .evidence import Diagnostic, Event, ExecutionStatus, FailureCategory, Manifest, MemorySink
from .execute import CancellationToken, InputBinding, Mode, OutputBinding, Result, Runtime
from .session import configure, local_session

__all__ = ["CancellationToken", "Diagnostic", "Event", "ExecutionStatus", "FailureCategory", "InputBinding", "Manifest", "MemorySink", "Mode", "OutputBinding", "Result", "Runtime", "SPARK", "check", "configure", "local_session", "required"]
