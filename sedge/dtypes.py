"""The data model: six types and the null type, and how Spark's types map to them."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ExprTypeError


@dataclass(frozen=True)
class DType:
    name: str
    spark: str

    def __repr__(self) -> str:
        return self.name

    @property
    def is_numeric(self) -> bool:
        return self.name in ("Int64", "Float64")


Int64, Float64, Bool = DType("Int64", "bigint"), DType("Float64", "double"), DType("Bool", "boolean")
Str, Date, Datetime = DType("Str", "string"), DType("Date", "date"), DType("Datetime", "timestamp_ntz")
Null = DType("Null", "void")

_FROM_SPARK = {
    T.ByteType: Int64, T.ShortType: Int64, T.IntegerType: Int64, T.LongType: Int64,
    T.FloatType: Float64, T.DoubleType: Float64, T.DecimalType: Float64,
    T.BooleanType: Bool, T.StringType: Str, T.VarcharType: Str, T.CharType: Str, T.DateType: Date,
    T.TimestampType: Datetime, T.TimestampNTZType: Datetime, T.NullType: Null,
}


def of_spark(kind: T.DataType, name: str = "") -> DType:
    found = _FROM_SPARK.get(type(kind))
    if found is None:
        raise ExprTypeError(f"column {name!r} has the unsupported type {kind.simpleString()}; nested and binary columns aren't part of the data model")
    return found


def of_value(value) -> DType:
    for kinds, found in ((type(None), Null), (bool, Bool), (int, Int64), (float, Float64), (str, Str), (dt.datetime, Datetime), (dt.date, Date)):
        if isinstance(value, kinds):
            return found
    raise ExprTypeError(f"a literal can't be a {type(value).__name__}")


def unify(a: DType, b: DType, where: str = "") -> DType:
    """The type of values of both: the same, null with anything, int with float."""
    if a == b or b == Null:
        return a
    if a == Null:
        return b
    if a.is_numeric and b.is_numeric:
        return Float64
    raise ExprTypeError(f"{a} and {b} don't go together{' in ' + where if where else ''}")


def name_of(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def normalised(df: DataFrame) -> DataFrame:
    """df with every column cast to one of the six types; only what differs is cast, so scans keep their pushed filters."""
    same = True
    columns = []
    for f in df.schema.fields:
        want = of_spark(f.dataType, f.name)
        column = name_of(f.name)
        if f.dataType.simpleString() != want.spark and want != Null:
            column, same = column.cast(want.spark).alias(f.name), False
        columns.append(column)
    return df if same else df.select(*columns)
