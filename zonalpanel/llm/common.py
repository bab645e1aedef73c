"""Small helpers of the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalpanel.session import prepare, written

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder; the shuffles behind it become garbage.

    The collector is asked to run, so that Spark's cleaner removes those shuffle files now
    and not only when the driver happens to need memory.
    """
    spark = df.sparkSession
    result = written(df, label)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return result


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without columns of these names, which an operator is about to add."""
    drop = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in drop])


def with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` of ``docs`` with another text, and n_chars (if there is one) counted anew."""
    changed = {"text": text}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(text.isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast("long")
    return docs.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])


def text_key(text: str | Column = "text") -> Column:
    """Tells rows that share an id but not a text apart."""
    return F.crc32(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))


def sha256_text(text: str | Column) -> Column:
    """Lower-case hex digest of a text's UTF-8 bytes."""
    return F.sha2(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"), 256)
