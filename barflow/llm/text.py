"""Column expressions over text that several operators share."""

from __future__ import annotations

import string

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow import session

# Fixed values of the contracts: what separates words, and what is a word of a license text.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def filled(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() does just that for ASCII texts, and is many times faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACED_WORD)).cast("long")


def words(text: Column, pattern: str = SPACED_WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no column of the caller can clash with those of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("doc")[c].alias(c) for c in columns))


def located(docs: DataFrame, label: str) -> DataFrame:
    """`doc` (the row) and `at`, where it can be read again: file and row in it.

    Rows that don't come straight from files are written once to the shared folder.
    """
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(packed(docs), F.struct(*place).alias("at"))
    except AnalysisException:
        docs = session.settle(docs, label)
        return docs.select(packed(docs), F.struct(*place).alias("at"))
