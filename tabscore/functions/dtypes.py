"""Declared dtype strings (pandas spelling) against Spark types.

Fixed values: the dtype names a schema may declare and the Spark types each
one accepts.

    float64        -> double
    float32        -> float
    int64          -> bigint, int  (CSV inference yields int where pandas says int64)
    int32          -> int
    bool           -> boolean
    object         -> string
    datetime64[ns] -> timestamp, timestamp_ntz
    None           -> any type (no check)

Spark type names are also accepted verbatim (``double``, ``bigint`` ...).
"""

from __future__ import annotations

from pyspark.sql.types import DataType

DTYPE_ACCEPTS: dict[str, tuple[str, ...]] = {
    "float64": ("double",),
    "float32": ("float",),
    "int64": ("bigint", "int"),
    "int32": ("int",),
    "bool": ("boolean",),
    "object": ("string",),
    "datetime64[ns]": ("timestamp", "timestamp_ntz"),
}


def spark_type_name(dt: DataType) -> str:
    return dt.simpleString()


def dtype_matches(declared: str | None, actual: DataType) -> bool:
    if declared is None:
        return True
    name = spark_type_name(actual)
    accepted = DTYPE_ACCEPTS.get(declared)
    if accepted is not None:
        return name in accepted
    return name == declared.lower()
