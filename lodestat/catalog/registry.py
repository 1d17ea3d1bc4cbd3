"""Slug -> query and slug -> SQL. Each catalog module registers its queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES, ORACLES, SOURCE = {}, {}, {}


def present(df: DataFrame, digits: int) -> DataFrame:
    """Rows as the check compares them: ISO text days, doubles rounded."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(slug: str, sql: str | None = None, digits: int = 6):
    def register(fn):
        def run(spark, sf_dir, _fn=fn):
            return present(_fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        QUERIES[slug] = run
        SOURCE[slug] = fn.__module__
        if sql is not None:
            ORACLES[slug] = sql
        return fn

    return register


def rnd(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) AS {name or expr}"


def txt(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"
