"""Every error a user can meet, by what went wrong."""

from __future__ import annotations


class WeftError(Exception):
    """Base of all errors raised here."""


class SchemaError(WeftError):
    """A schema, field or type does not fit: unknown or duplicate names, clashing types."""


class TypingError(WeftError):
    """An expression has no static type under a schema."""


class FunctionNotFoundError(TypingError):
    """No such scalar, aggregate or window function."""


class PlanError(WeftError):
    """A plan is malformed: names, arity, reachability, cycles."""


class CapabilityError(WeftError):
    """A plan asks for what Spark (or a stream) cannot run; raised before any job."""


class BindingError(WeftError):
    """Inputs or outputs given to an execution do not match the plan."""


class AdapterError(WeftError):
    """Spark refused or failed; the cause is chained."""


class QualityGateError(WeftError):
    """A gate with a failing policy did not hold; ``result`` has the evidence."""

    def __init__(self, message: str, result=None):  # noqa: ANN001
        super().__init__(message)
        self.result = result


class ResourceError(WeftError):
    """A resource cannot be read or written as asked."""


class UnknownOutcomeError(ResourceError):
    """A write began and its end is not known; check the target before a retry."""


class PartlyWrittenError(ResourceError):
    """Some outputs were written before another one failed; ``written`` names them."""

    def __init__(self, message: str, written: tuple[str, ...] = ()):
        super().__init__(message)
        self.written = written


class TimedOutError(WeftError):
    """The execution ran longer than it was allowed."""


class CancelledError(WeftError):
    """The execution's token was cancelled."""


class WireError(WeftError):
    """A document breaks the wire format or its limits."""


class DeclarationError(WeftError):
    """A schema document is invalid; ``path`` says where."""

    def __init__(self, message: str, path: str = "$"):
        super().__init__(f"{path}: {message}")
        self.path = path


class ExtensionError(WeftError):
    """A registry is frozen, an id is taken or unknown, or versions do not match."""
