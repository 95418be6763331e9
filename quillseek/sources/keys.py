"""Keys: what to search in a row, as columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillseek import errors
from quillseek.functions import text as tx

#: What a key gives for each row: its texts, their places in an array (null outside arrays) and length norms.
TEXTS = "array<struct<v: string, i: int, n: double>>"
_PAIRS = "array<struct<v: string, i: int>>"


@dataclass(frozen=True)
class Key:
    """A column or path to search.

    path: 'a.b', or a list of names, which may contain dots.  weight: positive; the weights of a search are
    normalised.  expr: a column of string or array<string> to search instead of the path, or a function from a row, as a dict, to
    a string or a list of strings.  An index that was loaded knows that a key was computed, but not how.
    """

    path: str | Sequence[str]
    weight: float = 1.0
    expr: Column | Callable[[dict], Any] | None = None
    computed: bool = False

    @property
    def id(self) -> str:
        return self.path if isinstance(self.path, str) else ".".join(self.path)

    @property
    def parts(self) -> list[str]:
        return self.path.split(".") if isinstance(self.path, str) else list(self.path)


def parse_key(given) -> Key:
    """A key from a name, a list of names, a dict with name, weight and expr, or a Key."""
    if isinstance(given, Key):
        key = given
    elif isinstance(given, str) or isinstance(given, (list, tuple)):
        key = Key(given if isinstance(given, str) else tuple(given))
    else:
        if "name" not in given:
            raise errors.missing_key_property("name")
        name = given["name"]
        weight = given.get("weight")
        key = Key(name if isinstance(name, str) else tuple(name), 1.0 if weight is None else weight, given.get("expr"))
    if key.weight <= 0:
        raise errors.invalid_weight(key.id)
    return key


def parse_keys(given: Sequence) -> list[Key]:
    return [parse_key(k) for k in given]


def normalised(keys: Sequence[Key]) -> list[Key]:
    """Keys with weights that sum to 1."""
    total = sum(k.weight for k in keys)
    return [replace(k, weight=k.weight / total) for k in keys]


def keys_to_json(keys: Sequence[Key]) -> str:
    return json.dumps([{"path": k.parts, "id": k.id, "weight": k.weight, "src": k.path if isinstance(k.path, str) else list(k.path), "computed": k.computed or k.expr is not None} for k in keys])


@F.arrow_udf(T.StringType())
def _double_text(values: pa.Array) -> pa.Array:
    return pa.array([tx.number_text(v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _double_texts(values: pa.Array) -> pa.Array:
    return pa.array([None if row is None else [tx.number_text(v) for v in row] for row in values.to_pylist()], pa.list_(pa.string()))


def _empty() -> Column:
    return F.expr(f"cast(array() AS {_PAIRS})")


def _one(value: Column, place: Column | None) -> Column:
    return F.array(F.struct(value.alias("v"), (F.lit(None) if place is None else place).cast("int").alias("i")))


def _scalar(value: Column, kind: T.DataType, inside_array: bool) -> Column | None:
    """A value as text; None if values of its type aren't searched."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # Inside arrays a function can't be called for each element; whole numbers need none.
        whole = (F.abs(value) < 1e15) & (F.floor(value) == value) & ~((value == 0) & F.startswith(value.cast("string"), F.lit("-")))
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string") if inside_array else _double_text(value.cast("double")))
    if isinstance(kind, (T.IntegralType, T.BooleanType)) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return value.cast("string")
    if isinstance(kind, T.ArrayType) and inside_array and (inner := _scalar(F.lit(None), kind.elementType, True)) is not None:
        return F.array_join(F.transform(value, lambda x: _scalar(x, kind.elementType, True)), ",", "")
    return None


def _walk(value: Column, kind: T.DataType, parts: list[str], place: Column | None, arrays: bool) -> Column:
    """The texts below `value`, which is inside an array if `arrays`."""
    if not parts:
        text = _scalar(value, kind, arrays)
        return _empty() if text is None else _one(text, place)
    if isinstance(kind, T.ArrayType):
        inner = lambda x, i: F.coalesce(_walk(x, kind.elementType, parts, i, True), _empty())
        return F.coalesce(F.flatten(F.transform(value, inner)), _empty())
    name, rest = parts[0], parts[1:]
    if isinstance(kind, T.StructType) and name in kind.names:
        below, below_kind = value.getField(name), kind[name].dataType
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        below, below_kind = F.try_element_at(value, F.lit(name)), kind.valueType
    else:
        return _empty()
    if isinstance(below_kind, T.ArrayType):
        if not rest and isinstance(below_kind.elementType, (T.FloatType, T.DoubleType)) and not arrays:
            texts = _double_texts(below.cast("array<double>"))
            return F.coalesce(F.transform(texts, lambda x, i: F.struct(x.alias("v"), i.cast("int").alias("i"))), _empty())
        inner = lambda x, i: F.coalesce(_walk(x, below_kind.elementType, rest, i, True), _empty())
        return F.coalesce(F.flatten(F.transform(below, inner)), _empty())
    return F.coalesce(_walk(below, below_kind, rest, place, arrays), _empty())


def row_function(function: Callable[[dict], Any]) -> Callable[[Column], Column]:
    """A function of a row, as a dict, to a string, a list of strings or None, for a struct column; rows come in batches."""

    def listed(value) -> list[str | None] | None:
        return value if value is None or isinstance(value, list) else [value]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else listed(function(r)) for r in rows.to_pylist()], pa.list_(pa.string()))

    return run


def path_exists(schema: T.StructType, parts: list[str]) -> bool:
    kind: T.DataType = schema
    for name in parts:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.MapType):
            kind = kind.valueType
        elif isinstance(kind, T.StructType) and name in kind.names:
            kind = kind[name].dataType
        else:
            return False
    return True


def plain_column(df: DataFrame, key: Key) -> Column | None:
    """The key's own column if it is a top-level string column, on which filters can be pushed down to a scan."""
    if key.expr is None and len(key.parts) == 1 and key.parts[0] in df.columns and isinstance(df.schema[key.parts[0]].dataType, T.StringType):
        return F.col(f"`{key.parts[0]}`")
    return None


def _single(df: DataFrame, key: Key) -> Column | None:
    """The text of a path through structs to a scalar; None for other paths."""
    parts, kind = key.parts, df.schema
    value = None
    for name in parts:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        value = F.col(f"`{name}`") if value is None else value.getField(name)
        kind = kind[name].dataType
    return None if isinstance(kind, T.ArrayType) else _scalar(value, kind, False)


def texts_of(df: DataFrame, key: Key, field_norm_weight: float = 1.0, get=None) -> Column:
    """The key's texts in each row of df, blank ones left out."""
    expr = key.expr
    if expr is None and key.computed:
        raise errors.missing_getter(key.id)
    if expr is None and get is not None:
        expr = get(df, key.parts)
    if expr is not None and not isinstance(expr, Column):
        expr = row_function(expr)(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    if expr is not None:
        kind = df.select(expr.alias("x")).schema["x"].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            pairs = F.coalesce(F.transform(expr, lambda x, i: F.struct(x.alias("v"), i.cast("int").alias("i"))), _empty())
        elif isinstance(kind, T.StringType):
            pairs = _one(expr, None)
        else:
            pairs = _empty()
    elif (text := _single(df, key)) is not None:
        # One text a row needs no functions over arrays, which aren't compiled.
        one = F.array(F.struct(text.alias("v"), F.lit(None).cast("int").alias("i"), tx.length_norm(text, field_norm_weight).alias("n")))
        return F.when(text.isNotNull() & tx.not_blank(text), one).otherwise(F.expr(f"cast(array() AS {TEXTS})"))
    else:
        whole = F.struct(*[F.col(f"`{key.parts[0]}`")]) if key.parts[0] in df.columns else None
        kind = T.StructType([f for f in df.schema.fields if f.name == key.parts[0]])
        pairs = _empty() if whole is None else _walk(whole, kind, key.parts, None, False)
    kept = F.filter(pairs, lambda x: x["v"].isNotNull() & tx.not_blank(x["v"]))
    return F.transform(kept, lambda x: F.struct(x["v"].alias("v"), x["i"].alias("i"), tx.length_norm(x["v"], field_norm_weight).alias("n")))
