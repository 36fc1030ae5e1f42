"""String helpers as Column expressions (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exactly the characters Python's str.isspace() accepts, written as one regex
# class that Java and RE2 read the same way (Java's \s is ASCII-only and also
# differs from RE2's on \x0b, so neither engine's \s is used).
PY_WS = r"[\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]"
_USTRIP = f"^{PY_WS}+|{PY_WS}+$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c: Column | str) -> Column:
    """Unicode-aware strip (matches Python ``str.strip()``, incl. U+3000)."""
    return F.regexp_replace(col_(c), _USTRIP, "")


def normalize_text(c: Column | str) -> Column:
    """Lower case, collapse whitespace runs to one space, strip."""
    return ustrip(F.regexp_replace(F.lower(col_(c)), f"{PY_WS}+", " "))


def cut_at(c: Column | str, stop: str) -> Column:
    """Cut text at the first occurrence of ``stop`` (only when present), then strip."""
    c = col_(c)
    cut = F.when(F.instr(c, stop) > 0, F.substring_index(c, stop, 1)).otherwise(c)
    return ustrip(cut)


def nan_to_null(c: Column | str) -> Column:
    """Treat the literal text ``nan`` like a missing CSV cell."""
    c = col_(c)
    return F.when(c == F.lit("nan"), F.lit(None).cast("string")).otherwise(c)


def concat_nonnull(*cols: Column | str) -> Column:
    """Concatenate, skipping nulls and literal ``nan`` cells (never null itself)."""
    return F.concat(*[F.coalesce(nan_to_null(c), F.lit("")) for c in cols])


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` for a 0-based integer Column (fixed small lookup list)."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))
