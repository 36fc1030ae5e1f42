"""Compile ``str.format``-style templates to Column expressions.

A template is parsed once on the driver into literal pieces and field names and
becomes ``concat(lit, col, lit, ...)``.  Substituted values are never rescanned,
which is what ``str.format`` does too (chained ``replace`` would not).
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradebook.functions.text import col_


def template_fields(template: str) -> list[str]:
    return [f for _, f, _, _ in string.Formatter().parse(template) if f is not None]


def render(template: str, fields: Mapping[str, Column | str], missing: str = "") -> Column:
    """Render ``template`` with Columns bound to its field names.

    A null field value renders as ``missing`` so one short turn array does not
    erase the whole prompt; completeness is reported by the J1 checks instead.
    """
    parts: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if spec or conv:
            raise ValueError(f"format specs are not supported in templates: {field!r}")
        if field not in fields:
            raise KeyError(f"template field {field!r} is not bound")
        parts.append(F.coalesce(col_(fields[field]).cast("string"), F.lit(missing)))
    return F.concat(*parts) if parts else F.lit("")


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, fields: Mapping[str, str], missing: str = "") -> str:
    """The same rendering as a SQL ``||`` expression (for oracle queries)."""
    parts: list[str] = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(sql_literal(literal))
        if field is not None:
            parts.append(f"coalesce(CAST({fields[field]} AS VARCHAR), {sql_literal(missing)})")
    return "(" + " || ".join(parts or ["''"]) + ")"


def option_block(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """``A.x\\nB.y\\nC.z\\nD.w\\n`` with null options rendered empty."""
    pieces = []
    for label, v in zip("ABCD", (a, b, c, d)):
        pieces += [F.lit(f"{label}."), F.coalesce(col_(v).cast("string"), F.lit("")), F.lit("\n")]
    return F.concat(*pieces)
