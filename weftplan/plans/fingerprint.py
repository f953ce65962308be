"""Plan fingerprints: the same for plans that say the same, whatever their random ids."""

from __future__ import annotations

import hashlib
import json
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .compile import LogicalPlan
    from .plan import Plan


def describe_nodes(nodes) -> list[dict]:  # noqa: ANN001
    """Nodes as plain data; inputs by place, not id."""
    place = {n.id: i for i, n in enumerate(nodes)}
    out = []
    for n in nodes:
        row = {"name": n.name, "kind": n.kind, "inputs": [place[i] for i in n.inputs], "schema": n.schema.encode()}
        if n.operator is not None:
            row["operator"] = {"id": n.operator.id} | n.operator.describe()
        if n.order_key:
            row["order_key"] = list(n.order_key)
        out.append(row)
    return out


def fingerprint(plan: Plan | LogicalPlan) -> str:
    from .plan import topological

    body = {"plan": plan.name, "nodes": describe_nodes(topological(plan.nodes))}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
