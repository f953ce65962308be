"""One execution of a plan: bind, check, lower, gate, write, report."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import AdapterError, BindingError, CancelledError, PartlyWrittenError, QualityGateError, TimedOutError, UnknownOutcomeError, WeftError
from ..plans.compile import LogicalPlan, compile_plan, lower, order_needed
from ..plans.lineage import Lineage, analyse
from ..plans.plan import Node, Plan
from ..quality.evidence import GateResult
from ..quality.gate import evaluate
from ..quality.rules import Policy
from ..sources import READERS, WRITERS, Registry, Resource, RetrySafety, WriteMode, WriteResult
from . import capabilities
from .evidence import Diagnostic, Event, ExecutionStatus, Manifest, Sink, Telemetry, classify, new_execution
from .session import configure


class Mode(StrEnum):
    EAGER = "eager"
    LAZY = "lazy"
    AUTO = "auto"


@dataclass(frozen=True)
class InputBinding:
    """A DataFrame (or Arrow table or pandas frame) or a resource for an input."""

    name: str
    value: Any = None
    resource: Resource | None = None
    credential: str | None = None

    @classmethod
    def from_native(cls, name: str, value: Any) -> InputBinding:
        return cls(name, value=value)

    @classmethod
    def from_resource(cls, name: str, resource: Resource, credential: str | None = None) -> InputBinding:
        return cls(name, resource=resource, credential=credential)


@dataclass(frozen=True)
class OutputBinding:
    name: str
    resource: Resource
    mode: WriteMode = WriteMode.CREATE_NEW
    retry_safety: RetrySafety = RetrySafety.UNKNOWN

    @classmethod
    def to_resource(cls, name: str, resource: Resource, mode: WriteMode = WriteMode.CREATE_NEW, retry_safety: RetrySafety = RetrySafety.UNKNOWN) -> OutputBinding:
        return cls(name, resource, WriteMode(mode), RetrySafety(retry_safety))


class CancellationToken:
    """Ask an execution to stop: Spark's jobs of that execution are interrupted, and no further step begins."""

    def __init__(self) -> None:
        self._event, self._hooks = threading.Event(), []

    def cancel(self) -> None:
        self._event.set()
        for hook in list(self._hooks):
            hook()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def on_cancel(self, hook: Callable[[], None]) -> None:
        self._hooks.append(hook)
        if self.cancelled:
            hook()


@dataclass(frozen=True)
class Result:
    outputs: dict[str, DataFrame]
    manifest: Manifest | None
    lineage: Lineage
    gates: tuple[GateResult, ...] = ()
    writes: tuple[WriteResult, ...] = ()
    plan: LogicalPlan | None = None
    persisted: tuple[DataFrame, ...] = field(default=(), repr=False)

    def output(self, name: str | None = None) -> DataFrame:
        if name is None and len(self.outputs) != 1:
            raise BindingError(f"outputs are {', '.join(self.outputs)}; name one")
        return next(iter(self.outputs.values())) if name is None else self.outputs[name]

    def explain(self, name: str | None = None) -> str:
        """Spark's formatted plan of an output."""
        df = self.output(name)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def close(self) -> None:
        for df in self.persisted:
            df.unpersist()


#: How an execution ends with an error; all others are failures.
STATUS = [
    (TimedOutError, ExecutionStatus.TIMED_OUT),
    (CancelledError, ExecutionStatus.CANCELLED),
    (UnknownOutcomeError, ExecutionStatus.UNKNOWN_OUTCOME),
    (PartlyWrittenError, ExecutionStatus.REQUIRES_RECONCILIATION),
]


def _jobs(spark: SparkSession, tag: str) -> list:
    """(status, stage ids) of the Spark jobs with a tag."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    infos = (tracker.getJobInfo(j) for j in tracker.getJobIdsForTag(tag))
    return [(i.get().status().toString(), list(i.get().stageIds())) for i in infos if i.isDefined()]


def running(spark: SparkSession, tag: str, wait: float = 5.0) -> bool:
    """Whether jobs with a tag still run after ``wait`` seconds."""
    until = time.monotonic() + wait
    while any(status == "RUNNING" for status, _ in _jobs(spark, tag)):
        if time.monotonic() > until:
            return True
        time.sleep(0.05)
    return False


def repeated(spark: SparkSession, tag: str) -> tuple[str, ...]:
    """What Spark tried again for a tag: stages with more than one attempt or with failed tasks."""
    tracker, out = spark.sparkContext._jsc.sc().statusTracker(), []
    for stage in sorted({s for _, stages in _jobs(spark, tag) for s in stages}):
        info = tracker.getStageInfo(stage)
        if info.isDefined() and (info.get().currentAttemptId() or info.get().numFailedTasks()):
            out.append(f"stage {stage}: attempt {info.get().currentAttemptId()}, {info.get().numFailedTasks()} failed tasks")
    return tuple(out)


class Runtime:
    """Executes plans on one Spark session."""

    def __init__(self, spark: SparkSession, sinks: Iterable[Sink] = (), readers: Registry | None = None, writers: Registry | None = None):
        self.spark, self.sinks = configure(spark), tuple(sinks)
        self.readers, self.writers = readers or READERS, writers or WRITERS

    def execute(self, plan: Plan | LogicalPlan, inputs: Iterable[InputBinding] | dict[str, Any], outputs: Iterable[OutputBinding] = (), mode: Mode = Mode.AUTO, correlation: str | None = None, token: CancellationToken | None = None, timeout: float | None = None, keep_gates: bool = False) -> Result:
        """Lazy outputs unless EAGER; gates run as jobs. Failures carry a manifest as ``manifest`` on the exception.

        ``timeout`` (seconds) interrupts the execution's jobs, writes included. A gate's input is computed anew for its
        evidence and for what follows; ``keep_gates`` persists it until the result is closed, which pays where it is
        costly and fits the executors' disks.
        """
        mode, outputs, execution = Mode(mode), tuple(outputs), new_execution()
        bindings = tuple(InputBinding(k, v) if not isinstance(v, Resource) else InputBinding(k, resource=v) for k, v in inputs.items()) if isinstance(inputs, dict) else tuple(inputs)
        tell, started = Telemetry(execution, self.sinks), datetime.now(timezone.utc)
        gates: list[GateResult] = []
        notes: list[Diagnostic] = []
        state: dict[str, Any] = {"plan": None, "persisted": [], "retries": (), "keep_gates": keep_gates}
        tag, late = f"weftplan-{execution}", threading.Event()

        def manifest(status: ExecutionStatus, failure=None) -> Manifest:  # noqa: ANN001
            p = state["plan"]
            return Manifest(execution, correlation, plan.name, p.fingerprint if p else "", "spark", str(mode), status, started, datetime.now(timezone.utc), tuple((b.name, b.resource.uri if b.resource else "native") for b in bindings), tuple((b.name, b.resource.uri) for b in outputs), tuple(notes), failure, state["retries"])

        def end(status: ExecutionStatus, **attributes: Any) -> None:
            state["retries"] = repeated(self.spark, tag)
            if state["retries"]:
                tell.event(Event.TASKS_REPEATED, stages=list(state["retries"]))
            tell.event(Event.ENDED, status=str(status), **attributes)

        tell.event(Event.BEGUN, plan=plan.name, status=str(ExecutionStatus.CREATED))

        def stop() -> None:
            tell.event(Event.STOP_ASKED, reason="timeout" if late.is_set() else "token")
            self.spark.interruptTag(tag)

        def overdue() -> None:
            late.set()
            stop()

        timer = threading.Timer(timeout, overdue) if timeout is not None else None
        self.spark.addTag(tag)
        self.spark.sparkContext.addJobTag(tag)
        try:
            if token is not None:
                token.on_cancel(stop)
            if timer is not None:
                timer.daemon = True
                timer.start()

            def alive() -> None:
                if late.is_set():
                    raise TimedOutError(f"the execution took more than {timeout} s")
                if token is not None and token.cancelled:
                    raise CancelledError("the execution was cancelled")

            result = self._run(plan, bindings, outputs, mode, alive, tell, gates, notes, state)
            end(ExecutionStatus.SUCCEEDED)
            return replace(result, manifest=manifest(ExecutionStatus.SUCCEEDED))
        except BaseException as e:
            for df in state["persisted"]:
                df.unpersist()
            error = e if isinstance(e, WeftError) or not isinstance(e, Exception) else AdapterError(f"Spark failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
            if error is not e:
                error.__cause__ = e
            stopped = TimedOutError(f"the execution took more than {timeout} s") if late.is_set() else CancelledError("the execution was cancelled") if token is not None and token.cancelled else None
            # a write that was stopped midway stays uncertain
            if stopped is not None and not isinstance(error, (type(stopped), UnknownOutcomeError, PartlyWrittenError)):
                error = stopped
                error.__cause__ = e
            failure = classify(error)
            status = next((s for kind, s in STATUS if isinstance(error, kind)), ExecutionStatus.FAILED)
            quiet = {} if stopped is None else {"confirmed": not running(self.spark, tag)}
            end(status, category=str(failure.category), uncertainty=failure.uncertainty, message=failure.message, **quiet)
            error.manifest = manifest(status, failure)  # type: ignore[attr-defined]
            if error is e:
                raise
            raise error from e
        finally:
            if timer is not None:
                timer.cancel()
            self.spark.removeTag(tag)
            self.spark.sparkContext.removeJobTag(tag)

    def _run(self, plan, bindings, outputs, mode, alive, tell, gates, notes, state) -> Result:  # noqa: ANN001
        compiled = state["plan"] = compile_plan(plan)
        tell.event(Event.RESOLVED, fingerprint=compiled.fingerprint, status=str(ExecutionStatus.RUNNING))
        lineage = analyse(compiled, [("input", b.name, b.resource.uri) for b in bindings if b.resource] + [("output", b.name, b.resource.uri) for b in outputs])
        want = {n.name for n in compiled.inputs}
        if len({b.name for b in bindings}) < len(bindings) or {b.name for b in bindings} != want:
            raise BindingError(f"inputs must be exactly {', '.join(sorted(want))}")
        if unknown := {b.name for b in outputs} - {n.name for n in compiled.outputs}:
            raise BindingError(f"no output {sorted(unknown)[0]!r}")
        alive()
        schemas = {n.name: n.schema for n in compiled.inputs}
        frames = {}
        for b in bindings:
            frames[b.name] = self._bind(b, schemas[b.name])
            tell.event(Event.BOUND, input=b.name)
        capabilities.check(compiled, streaming=frozenset(n for n, df in frames.items() if df.isStreaming))
        needed = order_needed(compiled)
        notes.extend(Diagnostic("info", "WEFT-ORDER-001", "a later step depends on this input's row order, which without an order key is fixed for a fixed layout of files only", n.name) for n in compiled.inputs if n.id in needed and not n.order_key)
        alive()
        readers, has_gate = compiled.consumers(), any(n.operator is not None and n.operator.id == "core.quality_gate" for n in compiled.nodes)

        def keep(node: Node, df: DataFrame) -> DataFrame:
            """Steps that several actions read are computed once: shared steps of plans with many outputs, and gates' inputs if asked for."""
            gate = state["keep_gates"] and node.operator is not None and node.operator.id == "core.quality_gate" and node.operator.spec.policy != Policy.IGNORE
            if not df.isStreaming and (gate or readers[node.id] > 1 and (len(compiled.outputs) > 1 or has_gate)):
                df = df.persist()
                state["persisted"].append(df)
            return df

        def gate(node: Node, frame) -> None:  # noqa: ANN001
            alive()
            got = tell.span("weftplan.gate", lambda: evaluate(node.name, node.operator.spec, frame.output(), frame.schema), gate=node.name)
            gates.append(got)
            tell.event(Event.GATE_JUDGED, gate=node.name, failed=[r.rule for r in got.failed])
            notes.extend(Diagnostic("warning", "WEFT-QUALITY-001", f"{r.rule}: {r.violations} of {r.evaluated}", node.name) for r in got.failed)
            if got.failed and node.operator.spec.policy in (Policy.FAIL_FAST, Policy.FAIL_AT_END):
                raise QualityGateError(f"gate {node.name!r}: {', '.join(r.rule for r in got.failed)} failed", got)

        lowered = lower(compiled, frames, on_gate=gate, keep=keep)
        tell.event(Event.LOWERED, outputs=list(lowered))
        if mode == Mode.EAGER:
            for name, df in lowered.items():
                if not df.isStreaming:
                    lowered[name] = df.persist()
                    state["persisted"].append(lowered[name])
                    tell.metric("gauge", "weftplan.output.rows", float(lowered[name].count()), output=name)
        writes: list[WriteResult] = []
        for b in outputs:
            try:
                alive()
                got = tell.span("weftplan.write", lambda b=b: self.writers.get(b.resource.scheme)(self.spark, b.resource, lowered[b.name], b.mode, b.retry_safety), output=b.name)
                if got.status == "unknown_outcome":
                    raise UnknownOutcomeError(f"the writer of {b.resource.uri!r} cannot tell whether it was written")
            except UnknownOutcomeError:
                raise
            except Exception as e:
                if not writes:
                    raise
                raise PartlyWrittenError(f"{', '.join(w.uri for w in writes)} written, but not {b.resource.uri}: {str(e).splitlines()[0]}", tuple(w.uri for w in writes)) from e
            writes.append(got)
            tell.event(Event.TARGET_WRITTEN, output=b.name)
        if not writes:  # what is written stays written
            alive()
        return Result(lowered, None, lineage, tuple(gates), tuple(writes), compiled, tuple(state["persisted"]))

    def _bind(self, b: InputBinding, schema) -> DataFrame:  # noqa: ANN001
        if (b.value is None) == (b.resource is None):
            raise BindingError(f"input {b.name!r} takes a value or a resource")
        if b.resource is not None:
            return self.readers.get(b.resource.scheme)(self.spark, b.resource, schema, b.credential)
        if isinstance(b.value, DataFrame):
            return b.value
        try:
            return self.spark.createDataFrame(b.value, schema.to_spark())
        except Exception as e:
            raise BindingError(f"input {b.name!r}: {type(b.value).__name__} does not fit: {str(e).splitlines()[0]}") from e


__all__ = ["CancellationToken", "InputBinding", "Mode", "OutputBinding", "Result", "Runtime"]
