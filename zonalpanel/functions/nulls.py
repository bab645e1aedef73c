"""One missing value: NaN becomes NULL at the source, so aggregates skip it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number. Spark's cast alone also takes Java suffixes ('1d').
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def nan_as_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN to NULL in the given (default: all) floating point columns."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        and (cols is None or f.name in cols)
    ]
    return df.withColumns({n: nan_as_null(F.col(n)) for n in names}) if names else df


def number_or_null(col: Column) -> Column:
    """Text to double; text that is not a number gives NULL."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
