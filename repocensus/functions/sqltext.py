"""Constants handed to the planner as text: one call instead of thousands of literals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_string(text: str) -> str:
    """A SQL string literal ('$' is escaped so that no variable substitution applies)."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024")
    return "'" + escaped.replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def sql_list(texts: Iterable[str]) -> str:
    return "(" + ", ".join(sql_string(t) for t in texts) + ")"


def constant(json_text: str, ddl: str) -> Column:
    """A nested constant; the optimizer folds it once per plan."""
    return F.from_json(F.lit(json_text), ddl)
