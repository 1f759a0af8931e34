"""One output contract for a query and its SQL twin: names, types, 6-decimal doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMALS = 6
# Sums taken in another order differ in their last bits. A value exactly between two
# decimals would then round either way, so both sides lift such ties by the same hair.
LIFT = 2.7e-8


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(f.split(":")) if ":" in f else (f, "long") for f in spec.split()]


def fixed(c: Column) -> Column:
    """A double as results show it."""
    return F.round(c + F.lit(LIFT), DECIMALS) + F.lit(0.0)  # also turns -0.0 into 0.0


def shape(df: DataFrame, spec: str, rounds: bool = True) -> DataFrame:
    """Select the columns of ``spec`` ("name" is a long, "name:double", "name:string"); doubles ``fixed`` unless they are."""
    out = []
    for name, kind in _fields(spec):
        c = F.col(name).cast(kind)
        if kind == "double" and rounds:
            c = fixed(c)
        out.append(c.alias(name))
    return df.select(*out)


def rounded(expr: str) -> str:
    return f"round({expr} + {LIFT!r}::DOUBLE, {DECIMALS}) + 0.0"


def shape_sql(sql: str, spec: str) -> str:
    kinds = {"long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    out = []
    for name, kind in _fields(spec):
        c = f'CAST("{name}" AS {kinds[kind]})'
        if kind == "double":
            c = rounded(c)
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) shaped"
