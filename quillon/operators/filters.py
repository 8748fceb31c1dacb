"""The filter language: a nested mapping compiled to one Spark column.

A key is a path, ``$and`` or ``$or``; a value is a scalar (equality), a list (``$in``), ``None`` (is null), a mapping of
``$`` operators, or a mapping of deeper paths. ``MISSING`` values are skipped. Comparisons of unlike types don't match, nor does a
field that isn't there; with a variant column for undeclared fields, paths that the schema hasn't got are read from there.
Unknown operators raise; ``compat=True`` reproduces the lenient reading, where they, ``$elemMatch`` and empty ``$or``
branches match everything or vanish.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping
from functools import cache, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = object()
TRUE = F.lit


def quoted(path: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in path.split("."))


def _kind(schema: T.DataType, path: str) -> T.DataType | None:
    for part in path.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.fieldNames():
            return None
        schema = schema[part].dataType
    return schema


class Undeclared(T.DataType):
    """A path within a variant column, or one that leads nowhere."""

    def __init__(self, column: str | None = None, path: str = ""):
        self.column, self.path = column, path

    def typed(self, value) -> Column:
        """The field as the type of ``value``, null where it has another."""
        if self.column is None:
            return F.lit(None)
        kind, names = next((k, n) for types, k, n in VARIANT_KINDS if isinstance(value, types))
        here = F.variant_get(F.col(quoted(self.column)), self.path, "variant")
        return F.when(F.schema_of_variant(here).rlike(f"^(?:{names})"), F.try_variant_get(F.col(quoted(self.column)), self.path, kind))


#: Python values, the column type that they are compared as, and what a variant of their kind is called.
VARIANT_KINDS = (
    (bool, "boolean", "BOOLEAN"), ((int, float), "double", "BIGINT|DOUBLE|FLOAT|DECIMAL"), (str, "string", "STRING"),
    ((datetime.date, list, tuple, Mapping), "timestamp_ntz", "DATE|TIMESTAMP"),
)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def comparable(kind: T.DataType | None, value) -> bool:
    """Whether a column of this type may equal the value; an unknown type may."""
    if isinstance(value, bool):
        return kind is None or isinstance(kind, T.BooleanType)
    if isinstance(value, (int, float)):
        return kind is None or isinstance(kind, T.NumericType)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return kind is None or isinstance(kind, (*TIMES, T.StringType))
    if isinstance(value, str):
        return kind is None or isinstance(kind, (T.StringType, *TIMES))
    return kind is None


class Compiler:
    def __init__(self, schema: T.StructType, compat: bool = False, undeclared: str | None = None):
        self.schema, self.compat, self.undeclared = schema, compat, undeclared

    def compile(self, filters: Mapping | None) -> Column | None:
        """None if nothing is asked for."""
        return self._all([c for key, value in (filters or {}).items() if value is not MISSING for c in [self._entry(key, value)] if c is not None])

    @staticmethod
    def _all(parts: list[Column]) -> Column | None:
        return reduce(and_, parts) if parts else None

    def _entry(self, key: str, value) -> Column | None:
        if key == "$and":
            return self._all([c for c in map(self.compile, value) if c is not None])
        if key == "$or":
            parts = [self.compile(v) for v in value]
            if self.compat:
                parts = [c for c in parts if c is not None]
            return reduce(or_, [F.lit(True) if c is None else c for c in parts]) if parts else None
        if key.startswith("$"):
            return self._unknown(key)
        return self._path(key, value)

    def _unknown(self, name: str) -> Column | None:
        if self.compat:
            return None
        raise ValueError(f"unknown operator {name}")

    def _path(self, path: str, value, base: Column | None = None, kind: T.DataType | None = None) -> Column | None:
        if base is None:
            kind = _kind(self.schema, path)
            column = F.col(quoted(path)) if kind is not None else F.lit(None)
            if kind is None:
                kind = Undeclared(self.undeclared, "$" + "".join(f"['{p}']" if "'" not in p else f'["{p}"]' for p in path.split(".")))
                column = F.variant_get(F.col(quoted(self.undeclared)), kind.path, "variant") if self.undeclared else F.lit(None).cast("string")
                if value is None:
                    # a variant's null is none to SQL
                    return column.isNull() if not self.undeclared else column.isNull() | F.is_variant_null(column)
        else:
            column = base
        if value is None:
            return column.isNull()
        if isinstance(value, (list, tuple)):
            return self._operator("$in", column, kind, value)
        if not isinstance(value, Mapping):
            return self._operator("$eq", column, kind, value)
        parts = []
        for key, inner in value.items():
            if inner is MISSING:
                continue
            if key in ("$and", "$or", "$not") or key.startswith("$") and key not in OPERATORS:
                part = self._unknown(key)
            elif key.startswith("$"):
                part = self._operator(key, column, kind, inner)
            elif base is None:
                part = self._path(f"{path}.{key}", inner)
            else:
                part = self._inner(column, kind, key, inner)
            parts += [] if part is None else [part]
        return self._all(parts)

    def _inner(self, column: Column, kind: T.DataType | None, key: str, value) -> Column | None:
        """A condition on a field of an array's element."""
        own = _kind(kind, key)
        return self._path(key, value, column[key], own) if own is not None else self._path(key, value, F.lit(None).cast("string"), Undeclared())

    def _same_kind(self, column: Column, kind: T.DataType | None, value) -> tuple[Column, Column] | None:
        """Both sides of a comparison; None where they are of unlike types."""
        if isinstance(kind, Undeclared):
            return (kind.typed(value), F.lit(value)) if kind.column and isinstance(value, (bool, int, float, str, datetime.date)) else None
        if not comparable(kind, value):
            return None
        if isinstance(value, (datetime.datetime, datetime.date)):
            return (column if isinstance(kind, TIMES) else column.try_cast("timestamp_ntz")), F.lit(value).cast("timestamp_ntz")
        if isinstance(value, str) and isinstance(kind, TIMES):
            return column, F.lit(value).try_cast(kind)
        return column, F.lit(value)

    def _operator(self, name: str, column: Column, kind: T.DataType | None, value) -> Column | None:
        if name == "$elemMatch":
            if self.compat:
                return None
            if not isinstance(kind, T.ArrayType) or not isinstance(value, Mapping):
                return F.lit(False)
            element = kind.elementType

            def matches(e: Column) -> Column:
                if isinstance(element, T.StructType):
                    parts = [p for k, v in value.items() for p in [self._inner(e, element, k, v)] if p is not None]
                    return self._all(parts) if parts else F.lit(True)
                found = self._path("", value, e, element)
                return F.lit(True) if found is None else found

            return F.exists(column, matches)
        return OPERATORS[name](self, column, kind, value)

    def compare(self, column: Column, kind, value, how) -> Column:
        sides = self._same_kind(column, kind, value)
        return F.lit(None).cast("boolean") if sides is None else how(*sides)

    def among(self, column: Column, kind, value) -> Column:
        values = [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]
        if isinstance(kind, Undeclared):
            parts = [left == right for v in values for sides in [self._same_kind(column, kind, v)] if sides for left, right in [sides]]
            return F.coalesce(reduce(or_, parts), F.lit(False)) if parts else F.lit(False)
        fit = [v for v in values if comparable(kind, v)]
        return column.isin(fit) if fit else F.lit(False)

    def text(self, column: Column, kind) -> Column:
        return kind.typed("") if isinstance(kind, Undeclared) else column.cast("string") if isinstance(kind, T.AtomicType) or kind is None else F.lit(None).cast("string")

    def all_of(self, column: Column, kind, value) -> Column:
        if not isinstance(kind, T.ArrayType) or not isinstance(value, (list, tuple)) or not all(comparable(kind.elementType, v) for v in value):
            return F.lit(False)
        return F.size(F.array_except(F.array(*map(F.lit, value)), column)) == 0 if len(value) else F.lit(True)

    def sized(self, column: Column, kind, value) -> Column:
        whole = isinstance(value, (int, float)) and not isinstance(value, bool)
        return F.array_size(column) == F.lit(value) if isinstance(kind, T.ArrayType) and whole else F.lit(False)


def _like(column: Column, pattern: str) -> Column:
    """Case-insensitive LIKE without an escape character."""
    if not isinstance(pattern, str):
        return F.lit(False)
    return column.cast("string").ilike(pattern.replace("\\", "\\\\"))


@cache
def valid_pattern(pattern: str) -> bool:
    """Whether Spark takes the pattern: asked once, on one empty text."""
    spark = SparkSession.active()
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
        return True
    except Exception as error:
        if "PATTERN" in str(error) or "regex" in str(error):
            return False
        raise


def _regex(column: Column, pattern) -> Column:
    """Unanchored; a pattern that isn't one matches nothing. A compiled Python pattern gives its text and its flags i, m and s."""
    flags = ""
    if isinstance(pattern, re.Pattern):
        named = "".join(name for bit, name in ((re.I, "i"), (re.M, "m"), (re.S, "s")) if pattern.flags & bit)
        flags, pattern = f"(?{named})" if named else "", pattern.pattern.replace("(?P<", "(?<")
    if not valid_pattern(flags + pattern):
        return F.lit(False)
    return F.coalesce(column.cast("string").rlike(flags + pattern), F.lit(False))


OPERATORS = {
    "$eq": lambda c, x, k, v: x.isNull() if v is None else c.compare(x, k, v, lambda a, b: a == b),
    "$ne": lambda c, x, k, v: x.isNotNull() if v is None else c.compare(x, k, v, lambda a, b: a != b),
    "$gt": lambda c, x, k, v: c.compare(x, k, v, lambda a, b: a > b),
    "$lt": lambda c, x, k, v: c.compare(x, k, v, lambda a, b: a < b),
    "$gte": lambda c, x, k, v: c.compare(x, k, v, lambda a, b: a >= b),
    "$lte": lambda c, x, k, v: c.compare(x, k, v, lambda a, b: a <= b),
    "$like": lambda c, x, k, v: _like(c.text(x, k), v),
    "$beginsWith": lambda c, x, k, v: _like(c.text(x, k), f"{v}%"),
    "$endsWith": lambda c, x, k, v: _like(c.text(x, k), f"%{v}"),
    "$in": lambda c, x, k, v: c.among(x, k, v),
    "$ni": lambda c, x, k, v: ~c.among(x, k, v),
    "$nin": lambda c, x, k, v: ~c.among(x, k, v),
    "$exists": lambda c, x, k, v: x.isNotNull() if v else x.isNull(),
    "$regex": lambda c, x, k, v: _regex(c.text(x, k), v),
    "$all": lambda c, x, k, v: c.all_of(x, k, v),
    "$size": lambda c, x, k, v: c.sized(x, k, v),
    "$elemMatch": None,
}


def apply_filter(df: DataFrame, filters: Mapping | None, compat: bool = False, undeclared: str | None = None) -> DataFrame:
    """``undeclared`` names a variant column with the fields that the schema hasn't got."""
    condition = Compiler(df.schema, compat, undeclared).compile(filters)
    return df if condition is None else df.where(condition)
