"""What a gate found."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RuleResult:
    rule: str
    violations: int
    evaluated: int
    passed: bool

    @property
    def rate(self) -> float:
        return self.violations / self.evaluated if self.evaluated else 0.0


@dataclass(frozen=True)
class GateResult:
    gate: str
    policy: str
    rules: tuple[RuleResult, ...]
    ignored: bool = False

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.rules)

    @property
    def failed(self) -> tuple[RuleResult, ...]:
        return tuple(r for r in self.rules if not r.passed)
