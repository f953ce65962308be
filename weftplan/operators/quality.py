"""The quality gate as a plan step: rows and schema pass unchanged, evidence goes to the execution."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from ..quality.rules import ValidationSpec
from ..schema import Schema
from .base import Frame, Operator


@dataclass(frozen=True)
class QualityGate(Operator):
    spec: ValidationSpec
    id: ClassVar[str] = "core.quality_gate"
    capability: ClassVar[str] = "quality"

    def resolve(self, schema: Schema) -> Schema:
        for r in self.spec.rules:
            r.check(schema)
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame

    def describe(self) -> dict:
        return {"policy": str(self.spec.policy), "rules": [r.describe() for r in self.spec.rules]}
