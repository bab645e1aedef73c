"""Panel output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_panel(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    """A table as CSV with a header row, or parquet, optionally in folders (by year)."""
    if partition_by:
        writer = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    else:
        writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")
