"""Plans: authoring, compilation, fingerprints, optimisation, lineage."""

from .builder import Dataset, PlanBuilder
from .compile import LogicalPlan, compile_plan, lower
from .lineage import Lineage, analyse
from .optimize import Optimizer, Report
from .pipeline import Pipeline
from .plan import Node, Plan

__all__ = ["Dataset", "Lineage", "LogicalPlan", "Node", "Optimizer", "Pipeline", "Plan", "PlanBuilder", "Report", "analyse", "compile_plan", "lower"]
