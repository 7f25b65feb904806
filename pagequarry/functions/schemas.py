"""Struct types without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_ATOMS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "strings": T.ArrayType(T.StringType())}


def struct(fields: str) -> T.StructType:
    """A struct from "name kind, name kind"; "strings" is an array of strings."""
    return T.StructType([T.StructField(name, _ATOMS[kind]) for name, kind in (f.split() for f in fields.split(","))])
