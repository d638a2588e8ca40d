"""Decision tables: project type and architecture from label sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import BACKEND, FRONTEND

# fixed values: results, in the order in which their conditions are tried
PROJECT_TYPES = (
    ("solidity", "Blockchain / Smart-contract project"),
    ("fe and be and db", "Full-stack web application"),
    ("fe and be", "Full-stack web application (no detected database)"),
    ("fe", "Frontend web application"),
    ("be and db and rust", "Rust backend service"),
    ("be and db and go", "Go backend service"),
    ("be and db and python", "Python backend service"),
    ("be and db", "Backend API service"),
    ("be and rust", "Rust backend service"),
    ("be", "Backend API service"),
    ("rust", "Rust library / CLI tool"),
    ("go", "Go application"),
    ("python", "Python application"),
    ("docker", "Containerised service"),
)
OTHER_PROJECT = "Unknown / General-purpose project"
ARCHITECTURES = (
    ("fe and be and db", "Frontend → API → Database"),
    ("fe and be", "Frontend → API"),
    ("be and db", "API → Database"),
    ("fe and db", "Frontend → Database"),
    ("fe", "Frontend only"),
    ("be", "API only"),
)
OTHER_ARCHITECTURE = "Monolithic / undetermined"


def flags(frameworks: Column, databases: Column, languages: Column, infrastructure: Column) -> dict[str, Column]:
    """Flags from arrays of labels; languages count by presence, whatever their lines."""
    out = {"fe": F.arrays_overlap(frameworks, F.array(*map(F.lit, FRONTEND))), "be": F.arrays_overlap(frameworks, F.array(*map(F.lit, BACKEND)))}
    out["db"] = F.size(databases) > 0
    out |= {n.lower(): F.array_contains(languages, n) for n in ("Rust", "Go", "Python", "Solidity")}
    return out | {"docker": F.array_contains(infrastructure, "Docker")}


def decide(table: tuple[tuple[str, str], ...], other: str, given: dict[str, Column]) -> Column:
    """The result of the first condition that holds."""
    out = other
    for condition, result in reversed(table):  # a null flag doesn't hold: nor does what it is part of
        out = F.when(reduce(Column.__and__, [given[name] for name in condition.split(" and ")]), result).otherwise(out)
    return out


def project_type(given: dict[str, Column]) -> Column:
    return decide(PROJECT_TYPES, OTHER_PROJECT, given)


def architecture(given: dict[str, Column]) -> Column:
    return decide(ARCHITECTURES, OTHER_ARCHITECTURE, given)
