"""Output conventions of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(df: DataFrame, digits: int = 6, **exact: int) -> DataFrame:
    """Doubles rounded (adding 0.0 turns -0.0 into 0.0), times as text."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            cols.append((F.round(F.col(f.name), exact.get(f.name, digits)) + F.lit(0.0)).alias(f.name))
        elif kind == "timestamp":
            cols.append(F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif kind == "date":
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
