"""Arrow functions whose types need no session when a module is imported."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, TEXTS, FLAG, REAL = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def arrow(kind: T.DataType):
    return F.pandas_udf(returnType=kind)
