"""Edge rules shared by all operators: NaN becomes NULL, times become UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def edge(df: DataFrame) -> DataFrame:
    """NaN -> NULL in float columns and TIMESTAMP_NTZ -> TIMESTAMP (session zone UTC): one narrow projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp")
        out.append(c.alias(f.name))
    return df.select(*out)


def read(spark, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A table of sf_dir with the edge rules applied; only the named columns are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return edge(df.select(*cols) if cols else df)


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def ntz(c: Column | str) -> Column:
    """A timestamp as UTC wall time without zone."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def clean_double(c: Column) -> Column:
    """A double without NaN."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)
