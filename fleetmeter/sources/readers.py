"""Scans of the two facts, SQL text, and delimited files."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetmeter.schema import MAINTENANCE_SCHEMA, TREND_SCHEMA

_NUMERIC = (T.NumericType, T.NullType)


def conform(df, schema, keep_extra=False):
    """Check `df` against `schema`, cast numbers, and turn NaN into NULL.

    A missing column or a column of another kind is an error: the check reads the
    schema only, never the rows.
    """
    have = {field.name: field.dataType for field in df.schema}
    missing = [f.name for f in schema if f.name not in have]
    if missing:
        raise ValueError(f"columns missing from the input: {missing}")
    wrong = [
        f"{f.name}: {have[f.name].simpleString()} is not {f.dataType.simpleString()}"
        for f in schema
        if have[f.name] != f.dataType
        and not (isinstance(have[f.name], _NUMERIC) and isinstance(f.dataType, T.NumericType))
        and not isinstance(have[f.name], T.NullType)
    ]
    if wrong:
        raise ValueError(f"columns of the wrong type: {wrong}")

    def clean(field):
        column = F.col(field.name)
        if isinstance(have[field.name], (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        if have[field.name] != field.dataType:
            column = column.cast(field.dataType)
        return column.alias(field.name)

    wanted = {field.name for field in schema}
    extra = [F.col(name) for name in have if name not in wanted] if keep_extra else []
    return df.select(*[clean(field) for field in schema], *extra)


def _open(spark, name, fmt):
    return spark.table(name) if fmt == "table" else spark.read.format(fmt).load(name)


def read_trend_fact(spark, name, fmt="parquet"):
    """Every column of the trend fact; `fmt="table"` reads a catalog table."""
    return conform(_open(spark, name, fmt), TREND_SCHEMA, keep_extra=True)


def read_maintenance_fact(spark, name, fmt="parquet"):
    """The maintenance fact's named columns; the scan reads no others."""
    return conform(_open(spark, name, fmt), MAINTENANCE_SCHEMA)


def read_csv_subset(spark, path, columns, schema=MAINTENANCE_SCHEMA):
    """Some columns of a headed CSV file that has the columns of `schema`."""
    whole = spark.read.schema(schema).option("header", True).csv(path)
    return whole.select(*columns)


def run_query(spark, text, **frames):
    """SQL text to rows; `frames` are DataFrames the text names as `{name}`."""
    return spark.sql(text, **frames)
