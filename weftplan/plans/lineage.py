"""Field lineage: where each output field's value comes from, and what else decides rows, groups and order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from enum import StrEnum

from ..functions.expr import Agg, Col, Expr
from ..functions.window import Over
from ..operators import Aggregate, Cast, Deduplicate, Derive, Distinct, Explode, Filter, Flatten, Join, Pivot, QualityGate, Rename, Sort, Union, Unpivot
from ..operators.relational import SetOperator
from ..operators.summary import key_name
from .compile import LogicalPlan, compile_plan
from .plan import Node, Plan


class Derivation(StrEnum):
    # The kinds of derivation.
    DIRECT = "direct"
    RENAMED = "renamed"
    CAST = "cast"
    DERIVED = "derived"
    AGGREGATED = "aggregated"
    WINDOWED = "windowed"
    RESHAPED = "reshaped"
    EXPLODED = "exploded"
    FLATTENED = "flattened"
    SET_COMBINED = "set_combined"


class Dependency(StrEnum):
    # The kinds of dependency.
    FILTER = "filter"
    GROUPING = "grouping"
    JOIN = "join"
    ORDERING = "ordering"
    WINDOW = "window"
    WINDOW_PARTITION = "window_partition"
    WINDOW_ORDERING = "window_ordering"
    DEDUPLICATION = "deduplication"
    DISTINCT = "distinct"
    QUALITY = "quality"
    PIVOT = "pivot"
    SET_MEMBERSHIP = "set_membership"


@dataclass(frozen=True)
class FieldRef:
    step: str
    field: str


@dataclass(frozen=True)
class Edge:
    """``target``'s value comes from ``source``."""

    source: FieldRef
    target: FieldRef
    kind: Derivation


@dataclass(frozen=True)
class Use:
    """``source`` decides something about the rows of ``step``."""

    source: FieldRef
    step: str
    kind: Dependency


#: Stands for the rows of a step, which fields such as counts are made of.
ROWS = ""


@dataclass(frozen=True)
class Lineage:
    plan: str
    edges: tuple[Edge, ...]
    uses: tuple[Use, ...]
    datasets: tuple[tuple[str, str], ...]
    resources: tuple[tuple[str, str, str], ...] = ()

    def upstream(self, step: str, field: str, rows: bool = True) -> set[FieldRef]:
        """All fields that a field depends on; ``rows``: also those that decide its rows."""
        back, decide, before = {}, {}, {}
        for e in self.edges:
            back.setdefault(e.target, set()).add(e.source)
        for u in self.uses:
            decide.setdefault(u.step, set()).add(u.source)
        for a, b in self.datasets:
            before.setdefault(b, set()).add(FieldRef(a, ROWS))

        def go(f: FieldRef) -> set[FieldRef]:
            out = back.get(f, set())
            if rows:
                out = out | decide.get(f.step, set())
                if f not in back:  # made of rows alone, such as a count
                    out = out | before.get(f.step, set())
            return out

        return {f for f in self._close({FieldRef(step, field)}, go) if f.field != ROWS}

    def downstream(self, step: str, field: str, rows: bool = True) -> set[FieldRef]:
        """All fields that depend on a field; ``rows``: also those whose rows it decides."""
        ahead, fields, after, decided = {}, {}, {}, {}
        made = {e.target for e in self.edges}
        for e in self.edges:
            ahead.setdefault(e.source, set()).add(e.target)
            for f in (e.source, e.target):
                fields.setdefault(f.step, set()).add(f)
        for u in self.uses:
            decided.setdefault(u.source, set()).update(fields.get(u.step, set()) | {FieldRef(u.step, ROWS)})
        for a, b in self.datasets:
            after.setdefault(a, set()).update({f for f in fields.get(b, set()) if f not in made} | {FieldRef(b, ROWS)})

        def go(f: FieldRef) -> set[FieldRef]:
            if f.field == ROWS:
                return after.get(f.step, set())
            return ahead.get(f, set()) | (decided.get(f, set()) if rows else set())

        return {f for f in self._close({FieldRef(step, field)}, go) if f.field != ROWS}

    def datasets_upstream(self, step: str) -> set[str]:
        back: dict[str, set[str]] = {}
        for a, b in self.datasets:
            back.setdefault(b, set()).add(a)
        return self._close({step}, lambda s: back.get(s, set()))

    def datasets_downstream(self, step: str) -> set[str]:
        ahead: dict[str, set[str]] = {}
        for a, b in self.datasets:
            ahead.setdefault(a, set()).add(b)
        return self._close({step}, lambda s: ahead.get(s, set()))

    @staticmethod
    def _close(start: set, step) -> set:  # noqa: ANN001
        seen, todo = set(), list(start)
        while todo:
            for x in step(todo.pop()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen


def roots(e: Expr | Iterable[Expr]) -> list[str]:
    es = [e] if isinstance(e, Expr) else list(e)
    return list(dict.fromkeys(c.split(".")[0] for x in es for c in x.columns()))


def _step(n: Node, sources: list[Node]) -> tuple[list[tuple[str, int, str, Derivation]], list[tuple[int, str, Dependency]]]:
    """((output field, input, its field, kind)..., (input, its field, kind)...) of one step."""
    op, first = n.operator, sources[0]
    same = [(f, 0, f, Derivation.DIRECT) for f in n.schema.names if f in first.schema]
    D, U = Derivation, Dependency  # noqa: N806
    match op:
        case Rename(mapping=m):
            back = {b: a for a, b in m}
            return [(f, 0, back.get(f, f), D.RENAMED if f in back else D.DIRECT) for f in n.schema.names], []
        case Filter(where=w):
            return same, [(0, f, U.FILTER) for f in roots(w)]
        case Distinct():
            return same, [(0, f, U.DISTINCT) for f in first.schema.names]
        case Cast(field=c):
            return [(f, 0, f, D.CAST if f == c else D.DIRECT) for f in n.schema.names], []
        case Derive(field=c, expression=e):
            edges = [x for x in same if x[0] != c]
            if isinstance(e, Over):
                edges += [(c, 0, f, D.WINDOWED) for f in roots(e.children)]
                uses = [(0, f, U.WINDOW) for f in roots(e.children)] + [(0, f, U.WINDOW_PARTITION) for f in e.spec.partition] + [(0, k.field, U.WINDOW_ORDERING) for k in e.spec.order]
                return edges, uses
            kind = D.DIRECT if isinstance(e, Col) and "." not in e.path and e.path == c else D.RENAMED if isinstance(e, Col) and "." not in e.path else D.DERIVED
            return edges + [(c, 0, f, kind) for f in roots(e)], []
        case Sort(keys=ks):
            return same, [(0, k.field, U.ORDERING) for k in ks]
        case Deduplicate(keys=ks):
            return same, [(0, k, U.DEDUPLICATION) for k in ks]
        case Aggregate(group_by=gs, metrics=ms):
            edges = [(key_name(e, i), 0, f, D.DIRECT if isinstance(e, Col) else D.DERIVED) for i, e in enumerate(gs) for f in roots(e)]
            edges += [(name, 0, f, D.AGGREGATED) for name, m in ms for f in (roots(m) if isinstance(m, Agg) else [])]
            return edges, [(0, f, U.GROUPING) for f in roots(gs)]
        case Pivot():
            edges = [(f, 0, f, D.DIRECT) for f in op.index] + [(c, 0, f, D.RESHAPED) for c in op.categories for f in (op.values, op.columns)]
            return edges, [(0, f, U.GROUPING) for f in op.index] + [(0, op.columns, U.PIVOT)]
        case Unpivot():
            return [(f, 0, f, D.DIRECT) for f in op.id_vars] + [(op.value_name, 0, f, D.RESHAPED) for f in op.value_vars] + [(op.variable_name, 0, f, D.RESHAPED) for f in op.value_vars], []
        case Explode(field=c):
            return [(f, 0, f, D.EXPLODED if f == c else D.DIRECT) for f in n.schema.names], []
        case Flatten(field=c):
            made = {o for _, o in op.members(first.schema)}
            return [(f, 0, c if f in made else f, D.FLATTENED if f in made else D.DIRECT) for f in n.schema.names], []
        case QualityGate(spec=s):
            return same, [(0, f.split(".")[0], U.QUALITY) for r in s.rules for f in r.fields()]
        case Join():
            edges = list(same)
            uses = [(0, a, U.JOIN) for a, _ in op.on] + [(1, b, U.JOIN) for _, b in op.on]
            if not op.left_only:
                edges += [(o, 1, f, D.RENAMED if o != f else D.DIRECT) for f, o in op.right_names(first.schema, sources[1].schema)]
                if op.kind in ("right", "full"):
                    edges += [(a, 1, b, D.DIRECT if a == b else D.RENAMED) for a, b in op.on]
            return edges, uses
        case SetOperator():
            both = [(f, i, f, D.SET_COMBINED) for f in n.schema.names for i in (0, 1)]
            keeps_all = isinstance(op, Union) and op.all
            return both, [] if keeps_all else [(i, f, U.SET_MEMBERSHIP) for f in n.schema.names for i in (0, 1)]
    return same, []


def analyse(plan: Plan | LogicalPlan, resources: Iterable[tuple[str, str, str]] = ()) -> Lineage:
    """Lineage of every step; ``resources``: (input or output, its name, URI)."""
    plan = compile_plan(plan)
    ids = {n.id: n for n in plan.nodes}
    label = lambda n: f"output:{n.name}" if n.kind == "output" else n.name
    edges, uses, datasets = [], [], []
    for n in plan.nodes:
        sources = [ids[i] for i in n.inputs]
        datasets += [(label(s), label(n)) for s in sources]
        if n.kind == "output":
            edges += [Edge(FieldRef(label(sources[0]), f), FieldRef(label(n), f), Derivation.DIRECT) for f in n.schema.names]
        elif n.operator is not None:
            made, decided = _step(n, sources)
            edges += [Edge(FieldRef(label(sources[i]), f), FieldRef(label(n), o), k) for o, i, f, k in made]
            uses += [Use(FieldRef(label(sources[i]), f), label(n), k) for i, f, k in decided]
    return Lineage(plan.name, tuple(dict.fromkeys(edges)), tuple(dict.fromkeys(uses)), tuple(dict.fromkeys(datasets)), tuple(resources))
