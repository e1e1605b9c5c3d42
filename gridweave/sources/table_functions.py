"""Table functions for SQL: documents in a column become rows, by a LATERAL call."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _fields(text: str) -> list[tuple[str, str]]:
    """(name, type) pairs of "name type, name type"."""
    found = [tuple(x.split()) for x in text.split(",")]
    if any(len(x) != 2 or x[1] not in _KINDS for x in found):
        raise ValueError(f"fields are 'name type, ...' with types {', '.join(_KINDS)}: {text}")
    return found


def _value(value, kind: str):
    """A JSON value as a column's; null where it is of another kind."""
    if value is None:
        return None
    if kind == "string":
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
    if kind == "boolean":
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, int | float):
        return None
    return float(value) if kind == "double" else value if isinstance(value, int) else None


class DocumentRows:
    """document_rows(document, key, fields): (place, fields...) of each object of the array `key` of a JSON document. key and fields are constants; fields, "name type, ...", gives
    the columns. A null or damaged document, or one without the array, gives no rows; elements that are no objects are passed over, and keep their place."""

    @staticmethod
    def analyze(document: AnalyzeArgument, key: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not (key.isConstantExpression and fields.isConstantExpression):
            raise ValueError("key and fields must be constants")
        return AnalyzeResult(T.StructType([T.StructField("place", T.LongType()), *(T.StructField(n, _KINDS[k]) for n, k in _fields(fields.value))]))

    def eval(self, document: str, key: str, fields: str):
        try:
            rows = json.loads(document or "null")
        except ValueError:
            return
        rows = rows.get(key) if isinstance(rows, dict) else None
        named = _fields(fields)
        for place, row in enumerate(rows if isinstance(rows, list) else []):
            if isinstance(row, dict):
                yield (place, *(_value(row.get(n), k) for n, k in named))


def register(spark: SparkSession) -> None:
    """Makes the table functions callable from SQL."""
    spark.udtf.register("document_rows", udtf(DocumentRows))
