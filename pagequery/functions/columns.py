"""Plain functions as column functions that get Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "binary": pa.binary()}


def column_function(f: Callable[..., Any], kind: str = "string") -> Callable[..., Column]:
    """``f`` over columns. A row with a null argument, or for which it raises ValueError, is null."""
    def one(values: tuple) -> Any:
        if any(v is None for v in values):
            return None
        try:
            return f(*values)
        except ValueError:
            return None

    def make(*columns: Column | str) -> Column:
        if len(columns) == 1:

            @F.arrow_udf(kind)
            def run(a: pa.Array) -> pa.Array:
                return pa.array([one((x,)) for x in a.to_pylist()], _ARROW[kind])

        elif len(columns) == 2:

            @F.arrow_udf(kind)
            def run(a: pa.Array, b: pa.Array) -> pa.Array:
                return pa.array([one(x) for x in zip(a.to_pylist(), b.to_pylist(), strict=True)], _ARROW[kind])

        else:

            @F.arrow_udf(kind)
            def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
                return pa.array([one(x) for x in zip(a.to_pylist(), b.to_pylist(), c.to_pylist(), strict=True)], _ARROW[kind])

        return run(*columns)

    return make
