"""Lines that many documents share, as compressed keep bitmaps.

Line hashes are range partitioned by (hash, document) and sorted by these and position, so that
a line found in a third of all documents fills many partitions. Its first occurrence in each
document streams out of the sorted rows, and the occurrences that the partitions name add up
to how many documents hold the line and where it stays. What is returned is a bitmap for each
document, not its text. All of it is DataFrame operations.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled, text_key, with_text, without

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\v\f\r"
WORD_BITS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _shared(lines: DataFrame, min_docs: int, keep: str) -> DataFrame:
    """(hash, check, keeper, place) of the lines of ``min_docs`` documents: who keeps a line, and its first place there."""
    ordered = lines.repartitionByRange("hash", "check", "doc_id").sortWithinPartitions(
        "hash", "check", "doc_id", "position"
    )
    # the ranges tell documents apart, so this runs on the sorted rows as they are
    first = ordered.groupBy("hash", "check", "doc_id").agg(F.first("position").alias("position"))
    pick, place = (F.max, F.max_by) if keep == "last" else (F.min, F.min_by)
    found = first.groupBy("hash", "check").agg(
        F.count("*").alias("n_docs"), pick("doc_id").alias("keeper"), place("position", "doc_id").alias("place")
    )
    return found.where(F.col("n_docs") >= min_docs).drop("n_docs")


def keep_bitmaps(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep: str = "last", once: bool = False
) -> DataFrame:
    """Which lines of each document stay when each shared line stays in one document only.

    Needs ``doc_id`` and ``text``. A line is shared if its key has ``min_chars`` code points
    or more and is found in ``min_docs`` documents (distinct doc_ids) or more; it stays in the
    largest doc_id (``keep="last"``) or the smallest one (``"first"``), as often as it stands
    there, or with ``once`` only at its first place there. Null doc_ids count as one document,
    which never is the one that keeps a line. Null and empty texts have one empty line, which
    is too short to be shared; lines of any length count whole; an empty table gives no rows.

    Returns (doc_id, text_key, holes) for the documents that lose lines. ``holes`` is the
    bitmap, compressed: bit i of ``bits`` in the entry for ``word`` w is set if line 64 w + i
    goes; words without such a bit are left out. ``text_key`` tells rows apart that repeat a
    doc_id with another text; equal rows share one bitmap.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    key = line_key(F.col("line"))
    lines = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            text_key().alias("text_key"),
            F.posexplode(_lines(F.col("text"))).alias("position", "line"),
        )
        .where(F.char_length(key) >= min_chars)
        .select(
            F.xxhash64(key).alias("hash"),
            F.xxhash64(F.lit("line"), key).alias("check"),
            "doc_id",
            "text_key",
            "position",
        )
    )
    lines = settled(lines, "line-hashes")

    # written, so that neither side of the join is an aggregate and Spark can split hot keys
    shared = settled(_shared(lines, min_docs, keep), "shared-lines")
    stays = F.col("doc_id").eqNullSafe(F.col("keeper"))
    if once:
        stays &= F.col("position") == F.col("place")
    gone = lines.join(shared, ["hash", "check"]).where(~stays)
    word = F.floor(F.col("position") / WORD_BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, position % {WORD_BITS})")
    return (
        gone.groupBy("doc_id", "text_key", word.alias("word"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("doc_id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("holes"))
    )


def apply_bitmaps(
    docs: DataFrame, bitmaps: DataFrame, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")
) -> DataFrame:
    """All rows of ``docs`` with the lines they had, those dropped, and the text that stays.

    A null text counts as one empty line. Columns that have one of ``names`` are replaced.
    """
    docs = without(docs, *names)
    other = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("holes").alias("_holes"))
    same = docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (text_key(docs["text"]) == other["_key"])
    lines, holes = _lines(docs["text"]), other["_holes"]
    by_word = F.map_from_entries(holes)

    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.try_element_at(by_word, F.floor(i / WORD_BITS).cast("int")), F.lit(0))
        return F.getbit(bits, (i % WORD_BITS).cast("int")) == 0

    counts = F.aggregate(holes, F.lit(0).cast("bigint"), lambda total, x: total + F.bit_count(x["bits"]))
    return docs.join(other, same, "left").select(
        *[docs[f"`{c}`"] for c in docs.columns],
        F.size(lines).cast("long").alias(names[0]),
        F.coalesce(counts, F.lit(0)).cast("long").alias(names[1]),
        F.when(holes.isNull(), F.coalesce(docs["text"], F.lit("")))
        .otherwise(F.array_join(F.filter(lines, stays), "\n"))
        .alias(names[2]),
    )


def drop_shared_lines(docs: DataFrame, **rules) -> DataFrame:
    """``apply_bitmaps`` with the bitmaps of ``keep_bitmaps(docs, **rules)``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, **rules))


def without_shared_lines(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` with the texts of ``drop_shared_lines`` where lines go; all else is unchanged.

    A column ``n_chars`` is counted anew.
    """
    names = tuple(free_name(n, docs.columns) for n in ("n_lines", "n_dropped", "kept_text"))
    found = apply_bitmaps(docs, keep_bitmaps(docs, **rules), names)
    return with_text(found, docs.columns, F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col("text")))
