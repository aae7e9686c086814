"""Prompt templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def variables(template: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))


def field_count(variables_: Column) -> Column:
    """Number of a template's fields; 0 where it names none."""
    return F.coalesce(F.size(variables_), F.lit(0))


def rendered(template: str, values: dict[str, Column | list]) -> Column:
    """The template with each {name} replaced; lists are joined by ", ". Missing names raise."""
    if missing := [v for v in variables(template) if v not in values]:
        raise ValueError(f"missing variables: {', '.join(missing)}")
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        value = values.get(part) if i % 2 else F.lit(part)
        parts.append(F.lit(", ".join(value)) if isinstance(value, list) else value)
    return F.concat(*parts)


def missing_variables(given: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(v) for v in required]), given)
