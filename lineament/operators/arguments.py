"""Arguments of tools: types, defaults and ranges, over a table of tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Argument:
    """A column's type, what stands for a missing value or one that can't be made into it, and its bounds."""

    name: str
    kind: str
    default: object
    least: float | None = None
    most: float | None = None


def with_arguments(tasks: DataFrame, arguments: list[Argument]) -> DataFrame:
    """tasks with each argument's column coerced and defaulted; other columns stay, a missing argument is added."""
    out = tasks
    for a in arguments:
        given = F.col(a.name).try_cast(a.kind) if a.name in tasks.columns else F.lit(None).cast(a.kind)
        value = F.coalesce(given, F.lit(a.default).cast(a.kind))
        if a.least is not None:
            value = F.greatest(value, F.lit(a.least).cast(a.kind))
        if a.most is not None:
            value = F.least(value, F.lit(a.most).cast(a.kind))
        out = out.withColumn(a.name, value)
    return out
