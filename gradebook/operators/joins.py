"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame

def collect_small(df: DataFrame, max_rows: int = 10_000) -> list:
    """Collect a driver-side list (model names, label values), refusing big ones."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows, got more; pass the values explicitly")
    return rows


def attach_labels(df: DataFrame, labels: DataFrame, label_cols: list[str], key: str = "question_id") -> DataFrame:
    """Inner join with question labels (unmatched rows drop, duplicates fan out).

    The label table grows with the question set, so no hint is forced here: AQE
    turns it into a broadcast hash join only when its runtime size is small.
    """
    return df.join(labels.select(key, *label_cols), key, "inner")
