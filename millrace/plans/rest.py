"""The URL query language: filters, order and paging over a table, and changes by rows of JSON."""

from __future__ import annotations

import csv
import json
import re
from urllib.parse import parse_qsl

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.engine import TenantSession, _written
from millrace.errors import AlreadyExists, CommitConflict, EngineError, InvalidLiteral, IsolationViolation, NotFound, Unsupported
from millrace.types import identifier

DEFAULT_LIMIT, MOST = 100, 1000
OPS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def literal(text: str):
    """null, true, false, whole numbers, numbers with a point or exponent; all else is text."""
    if text in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[text]
    if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
        return int(text)
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) and re.search(r"[.eE]", text):
        return float(text)
    return text


def _split(text: str) -> list[str]:
    """The items of in.(...): comma-separated, in double quotes if they hold commas."""
    return next(csv.reader([text]), [])


def condition(column: str, text: str) -> tuple[Column, str]:
    """A filter as a column and as the text of a condition."""
    name = identifier(column)
    c = F.col(name)
    if text in ("is.null", "is.notnull", "is.not.null"):
        return (c.isNull(), f"{name} IS NULL") if text == "is.null" else (c.isNotNull(), f"{name} IS NOT NULL")
    op, dot, value = text.partition(".")
    if op == "in" and value[:1] == "(" and value[-1:] == ")":
        items = [literal(x) for x in _split(value[1:-1])]
        return c.isin(*items), f"{name} IN ({', '.join(map(_written, items))})"
    if not dot or op not in OPS:
        raise Unsupported(f"unknown filter {text!r}")
    v = F.lit(literal(value))
    each = {"eq": c == v, "neq": c != v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}
    return each[op], f"{name} {OPS[op]} {_written(literal(value))}"


def rest_select(df: DataFrame, query: str) -> DataFrame:
    """Rows of a table for a query string: select, filters (all hold), order, limit (100 unless given, 1000 at most), offset."""
    limit, offset, columns, order = DEFAULT_LIMIT, 0, ["*"], []
    for key, value in parse_qsl(query, keep_blank_values=True):
        if key == "select":
            columns = [x if x == "*" else identifier(x) for x in value.split(",")]
        elif key in ("limit", "offset"):
            if not value.isdigit():
                raise InvalidLiteral(f"{key} is a whole number")
            limit, offset = (int(value), offset) if key == "limit" else (limit, int(value))
        elif key == "order":
            for part in value.split(","):
                name, _, way = part.partition(".")
                if way not in ("", "asc", "desc"):
                    raise Unsupported(f"unknown order {part}")
                c = F.col(identifier(name))
                order.append(c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
        else:
            df = df.where(condition(key, value)[0])
    if unknown := {c for c in columns if c != "*"} - set(df.columns):
        raise NotFound(f"no column {', '.join(sorted(unknown))}")
    df = df.orderBy(*order) if order else df
    return df.offset(offset).limit(min(limit, MOST)).select(*columns)


def _where(query: str) -> str:
    parts = [condition(k, v)[1] for k, v in parse_qsl(query, keep_blank_values=True)]
    if not parts:
        raise Unsupported("a filter is required")
    return " AND ".join(parts)


def _value(v):
    if isinstance(v, dict) or isinstance(v, list) and not all(isinstance(x, (int, float)) for x in v):
        raise InvalidLiteral("objects and arrays aren't values")
    return v


def rest_insert(session: TenantSession, table: str, body: str) -> int:
    """Inserts an object or an array of objects; keys that a row lacks are null."""
    rows = json.loads(body)
    rows = rows if isinstance(rows, list) else [rows]
    keys = list(dict.fromkeys(k for r in rows for k in r))
    if not keys:
        raise InvalidLiteral("there is nothing to insert")
    values = ", ".join("(" + ", ".join(_written(_value(r.get(k))) for k in keys) + ")" for r in rows)
    return session.execute(f"INSERT INTO {identifier(table)} ({', '.join(map(identifier, keys))}) VALUES {values}").rows


def rest_update(session: TenantSession, table: str, query: str, body: str) -> int:
    new = json.loads(body)
    if not isinstance(new, dict) or not new:
        raise InvalidLiteral("an object of new values is required")
    sets = ", ".join(f"{identifier(k)} = {_written(_value(v))}" for k, v in new.items())
    return session.execute(f"UPDATE {identifier(table)} SET {sets} WHERE {_where(query)}").rows


def rest_delete(session: TenantSession, table: str, query: str) -> int:
    return session.execute(f"DELETE FROM {identifier(table)} WHERE {_where(query)}").rows


#: HTTP status by error.
STATUS = {NotFound: 404, AlreadyExists: 409, CommitConflict: 409, IsolationViolation: 403}


def rest_error(e: Exception) -> tuple[int, dict[str, str]]:
    """Status and body of an error; what the engine didn't foresee is told without its text."""
    if not isinstance(e, EngineError):
        return 500, {"code": EngineError.sqlstate, "message": "internal error"}
    return STATUS.get(type(e), 400), {"code": e.sqlstate, "message": str(e)}


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects: bytes as \\x hex, non-finite numbers as text, nulls kept."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "binary":
            c = F.concat(F.lit("\\x"), F.lower(F.hex(c)))
        columns.append(c.alias(name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
