"""The plan: an immutable, validated graph of named steps."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..errors import PlanError
from ..operators import Operator
from ..schema import Schema


@dataclass(frozen=True)
class Node:
    """``kind``: input, step or output. Inputs refer to nodes by id."""

    id: str
    name: str
    kind: str
    schema: Schema
    inputs: tuple[str, ...] = ()
    operator: Operator | None = None
    order_key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    name: str
    nodes: tuple[Node, ...]

    def __post_init__(self) -> None:
        validate(self.nodes)

    @staticmethod
    def builder(name: str):  # noqa: ANN205
        from .builder import PlanBuilder

        return PlanBuilder(name)

    def of_kind(self, kind: str) -> tuple[Node, ...]:
        return tuple(n for n in self.nodes if n.kind == kind)

    @property
    def inputs(self) -> tuple[Node, ...]:
        return self.of_kind("input")

    @property
    def outputs(self) -> tuple[Node, ...]:
        return self.of_kind("output")

    def node(self, name: str) -> Node:
        for n in self.nodes:
            if n.name == name:
                return n
        raise PlanError(f"no step {name!r}")

    @property
    def fingerprint(self) -> str:
        from .fingerprint import fingerprint

        return fingerprint(self)


def topological(nodes: Iterable[Node]) -> list[Node]:
    """Inputs before uses; the given order wherever that leaves a choice."""
    left, done, out = list(nodes), set(), []
    while left:
        ready = next((n for n in left if set(n.inputs) <= done), None)
        if ready is None:
            raise PlanError("the plan has a cycle or a missing step")
        left.remove(ready)
        done.add(ready.id)
        out.append(ready)
    return out


def validate(nodes: tuple[Node, ...]) -> None:
    """Ids and names are unique, arities fit, every step leads from an input to an output, nothing is circular."""
    ids, names = {n.id: n for n in nodes}, [(n.kind == "output", n.name) for n in nodes]
    if len(ids) < len(nodes) or len(set(names)) < len(names):
        raise PlanError("a step's id or name is used twice")
    for n in nodes:
        if not n.name.strip():
            raise PlanError("a step needs a name")
        want = {"input": 0, "output": 1}.get(n.kind, n.operator.arity if n.operator else -1)
        if len(n.inputs) != want:
            raise PlanError(f"{n.name!r} has {len(n.inputs)} inputs, not {want}")
        if missing := [i for i in n.inputs if i not in ids]:
            raise PlanError(f"{n.name!r} reads {missing[0]!r}, which is not in the plan")
        if any(ids[i].kind == "output" for i in n.inputs):
            raise PlanError(f"{n.name!r} reads an output")
    if not any(n.kind == "input" for n in nodes) or not any(n.kind == "output" for n in nodes):
        raise PlanError("a plan needs an input and an output, one of each at least")
    order = topological(nodes)
    used = {n.id for n in nodes if n.kind == "output"}
    for n in reversed(order):
        if n.id in used:
            used.update(n.inputs)
    if unused := [n.name for n in nodes if n.id not in used]:
        raise PlanError(f"{unused[0]!r} leads to no output")
