"""Identifiers, column types and literals of the SQL dialect."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from millrace.errors import InvalidIdent, InvalidLiteral, InvalidSchema

IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}\Z")

# Spellings of the types. Lengths are accepted and not enforced; all integers but SMALLINT have 64 bits.
SPELLINGS: dict[T.DataType, tuple[str, ...]] = {
    T.LongType(): ("INT", "INTEGER", "INT4", "BIGINT", "INT8"),
    T.ShortType(): ("SMALLINT", "INT2"),
    T.StringType(): ("TEXT", "VARCHAR", "CHARACTER VARYING", "CHAR", "CHARACTER", "STRING"),
    T.BooleanType(): ("BOOLEAN", "BOOL"),
    T.DoubleType(): ("DOUBLE", "DOUBLE PRECISION", "FLOAT8", "FLOAT"),
    T.BinaryType(): ("BYTEA",),
    T.TimestampNTZType(): ("TIMESTAMP",),
    T.DateType(): ("DATE",),
}
BY_NAME = {name: kind for kind, names in SPELLINGS.items() for name in names}


def identifier(name: str) -> str:
    if not IDENT.match(name):
        raise InvalidIdent(f"not an identifier: {name!r}")
    return name


def column_type(text: str) -> tuple[T.DataType, dict]:
    """Spark's type and field metadata for a type in a column definition."""
    name = " ".join(text.split()).upper()
    vector = re.fullmatch(r"VECTOR ?\( ?(\d+) ?\)", name)
    if vector:
        if int(vector[1]) < 1:
            raise InvalidSchema("a vector has at least one dimension")
        return T.ArrayType(T.FloatType(), True), {"vector_dim": int(vector[1])}
    base = re.sub(r" ?\( ?\d+ ?\)$", "", name)
    if base not in BY_NAME or base != name and base not in ("VARCHAR", "CHARACTER VARYING", "CHAR", "CHARACTER", "FLOAT"):
        raise InvalidSchema(f"unsupported column type {text}")
    return BY_NAME[base], {}


def vector_literal(text: str, dim: int | None = None) -> list[float]:
    body = text.strip()
    if not (body.startswith("[") and body.endswith("]")):
        raise InvalidLiteral(f"not a vector: {text!r}")
    try:
        out = [float(x) for x in body[1:-1].split(",")] if body[1:-1].strip() else []
    except ValueError as e:
        raise InvalidLiteral(f"not a vector: {text!r}") from e
    if dim is not None and len(out) != dim:
        raise InvalidLiteral(f"the vector has {len(out)} dimensions instead of {dim}")
    return out


def coerce(value, field: T.StructField):
    """A Python value as the field's type, strictly: no text for numbers, no numbers for text."""
    kind = field.dataType
    if value is None:
        if not field.nullable:
            raise InvalidLiteral(f"null in column {field.name}, which is NOT NULL")
        return None
    bad = InvalidLiteral(f"{value!r} doesn't fit column {field.name} of type {kind.simpleString()}")
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise bad
        return value
    if isinstance(value, bool):
        raise bad
    if isinstance(kind, (T.LongType, T.ShortType)):
        bits = 15 if isinstance(kind, T.ShortType) else 63
        if not isinstance(value, int) or not -(1 << bits) <= value < 1 << bits:
            raise bad
        return value
    if isinstance(kind, T.DoubleType):
        if isinstance(value, str) and value.strip().lower() in ("nan", "infinity", "-infinity"):
            return float(value)
        if not isinstance(value, (int, float)):
            raise bad
        return float(value)
    if isinstance(kind, T.BinaryType):
        if isinstance(value, (bytes, bytearray)):
            return bytearray(value)
        if isinstance(value, str) and re.fullmatch(r"\\x(?:[0-9a-fA-F]{2})*", value):
            return bytearray.fromhex(value[2:])
        raise bad
    if isinstance(kind, T.ArrayType):
        dim = field.metadata.get("vector_dim")
        if isinstance(value, str):
            return vector_literal(value, dim)
        if not isinstance(value, list) or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value) or dim not in (None, len(value)):
            raise bad
        return [float(x) for x in value]
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise bad
        return value
    if isinstance(value, str):
        import datetime

        try:
            return datetime.date.fromisoformat(value) if isinstance(kind, T.DateType) else datetime.datetime.fromisoformat(value)
        except ValueError as e:
            raise bad from e
    return value
