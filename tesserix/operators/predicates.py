"""Whitelisted predicate queries: keys with operator suffixes become one pushed-down filter."""

from __future__ import annotations

import difflib
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("_gte", "_lte", "_gt", "_lt", "_not", "_in", "_like", "_regex")
MAX_PATTERN, SCAN_CAP, ROW_CAP = 512, 10_000, 1_000


class QueryError(ValueError):
    """A predicate, order or limit that the whitelist does not allow."""


@dataclass(frozen=True)
class Select:
    """What may be asked of a table: field -> "text" or "number", and orders by name, as (field, ascending)."""

    fields: Mapping[str, str]
    orders: Mapping[str, Sequence[tuple[str, bool]]]


def split_key(key: str, spec: Select) -> tuple[str, str]:
    """(field, operator): an exact field name wins, then the longest suffix whose rest is a field."""
    if key in spec.fields:
        return key, ""
    for suffix in sorted(SUFFIXES, key=len, reverse=True):
        if key.endswith(suffix) and key[: -len(suffix)] in spec.fields:
            return key[: -len(suffix)], suffix
    raise QueryError(f"unknown field {key!r}; have {sorted(spec.fields)}")


def like(col: Column, pattern: str) -> Column:
    """% and _ over the whole value; case is folded for A-Z only, and nothing escapes."""
    body = "".join("[\\s\\S]*" if c == "%" else "[\\s\\S]" if c == "_" else c if c.isalnum() or ord(c) > 127 else "\\" + c for c in pattern)
    return col.rlike(rf"(?i)\A{body}\z")


def checked_pattern(pattern: str) -> str:
    """The pattern, if it is short enough and the engine that will run it, Java's, takes it."""
    if len(pattern) > MAX_PATTERN:
        raise QueryError("pattern too long")
    jvm = SparkSession.getActiveSession()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        raise QueryError(f"bad pattern: {str(e).splitlines()[0]}") from None
    return pattern


def predicate(key: str, value: object, spec: Select) -> Column:
    field, op = split_key(key, spec)
    col, kind = F.col(field), spec.fields[field]
    if op == "_in":
        if not isinstance(value, (list, tuple)) or not value or any(isinstance(v, (list, tuple, dict)) for v in value):
            raise QueryError(f"{key} needs a list of scalars with at least one")
        return col.isin(*value)
    if isinstance(value, (list, tuple, dict, set)) or value is None:
        raise QueryError(f"{key} needs one scalar")
    if op in ("_gte", "_lte", "_gt", "_lt"):
        if kind != "number" or isinstance(value, (str, bool)):
            raise QueryError(f"{key} compares numbers")
        return {"_gte": col >= value, "_lte": col <= value, "_gt": col > value, "_lt": col < value}[op]
    if op in ("_like", "_regex"):
        if kind != "text" or not isinstance(value, str):
            raise QueryError(f"{key} needs text")
        if op == "_like":
            return like(col, value)
        return F.coalesce(col.rlike(checked_pattern(value)), F.lit(False))
    return col != value if op == "_not" else col == value


def select_where(df: DataFrame, spec: Select, where: Mapping[str, object]) -> DataFrame:
    for key, value in where.items():
        df = df.filter(predicate(key, value, spec))
    return df


def capped_query(df: DataFrame, spec: Select, where: Mapping[str, object], name: str, order_by: str, limit: int, scan_cap: int | None = SCAN_CAP) -> DataFrame:
    """At most scan_cap matches in name order are read (None: all), then ordered, then limited; flags tell of either cut."""
    if order_by not in spec.orders or not 1 <= limit <= ROW_CAP:
        raise QueryError("unknown order or limit out of range")
    found = select_where(df, spec, where)
    read = found if scan_cap is None else found.orderBy(name).limit(scan_cap + 1)
    scanned = read.agg(F.count("*").alias("_n"))
    rows = (read if scan_cap is None else read.orderBy(name).limit(scan_cap)).join(F.broadcast(scanned))
    capped = F.lit(False) if scan_cap is None else F.col("_n") > scan_cap
    return rows.withColumn("scan_capped", capped).withColumn("truncated", F.col("_n") > limit).drop("_n").orderBy([c for c, _ in spec.orders[order_by]], ascending=[up for _, up in spec.orders[order_by]]).limit(limit)


#: Parsed statements that are no queries, besides commands.
_WRITES = re.compile(r"Insert|Overwrite|Merge|Delete|Update|Create|Replace|Drop|Alter|Cache|Set[A-Z]|Truncate")


def _parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (Py4JJavaError, PySparkException) as e:
        raise QueryError(f"not one SQL statement: {' '.join(str(e).split())[:200]}") from None


def read_only(spark: SparkSession, sql: str) -> str:
    """The statement, if Spark's own parser reads it as one query and nothing in it writes, defines or sets."""
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    todo = [_parsed(spark, sql)]
    while todo:
        node = todo.pop()
        if command.isInstance(node) or _WRITES.match(node.getClass().getSimpleName()):
            raise QueryError("one read-only statement only")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sql


def auto_limit(spark: SparkSession, sql: str, max_rows: int) -> str:
    """The query with a limit, unless its outermost step is one."""
    body = read_only(spark, sql).strip().rstrip(";")
    if _parsed(spark, body).getClass().getSimpleName() in ("GlobalLimit", "LocalLimit"):
        return body
    # On lines of its own, as the statement may end in a comment.
    return f"SELECT * FROM (\n{body}\n) AS q LIMIT {int(max_rows)}"


def passthrough(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int) -> DataFrame:
    """A read-only query over named tables. No view of the session is replaced: the names hold in this statement only."""
    body, views = auto_limit(spark, sql, max_rows), {}
    try:
        for name, df in tables.items():
            views[name] = f"_{name}_{uuid.uuid4().hex}"
            df.createTempView(views[name])
        names = ", ".join(f"`{n}` AS (SELECT * FROM `{v}`)" for n, v in views.items())
        return spark.sql(f"WITH {names} SELECT * FROM (\n{body}\n) AS q" if views else body)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def batch(spark: SparkSession, queries: Mapping[str, str], tables: Mapping[str, DataFrame], max_rows: int) -> dict[str, DataFrame]:
    """Named queries, each on its own; the first that is not allowed stops the batch before any runs."""
    for sql in queries.values():
        read_only(spark, sql)
    return {name: passthrough(spark, sql, tables, max_rows) for name, sql in queries.items()}


def introspect(tables: Mapping[str, DataFrame], foreign: Mapping[tuple[str, str], tuple[str, str]] | None = None, search: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """(table, column, type, "table.column" it refers to) of all columns, or of those whose table or name holds the search text."""
    foreign = foreign or {}
    out = []
    for name in sorted(tables):
        for column, kind in tables[name].dtypes:
            if search is None or search.lower() in name.lower() or search.lower() in column.lower():
                to = foreign.get((name, column))
                out.append((name, column, kind, ".".join(to) if to else None))
    return out


def schema_of(selects: Mapping[str, Select]) -> list[tuple[str, str, str, str]]:
    """The whitelist as data: (select, field, type, operators that it takes)."""
    ops = {"number": "=,_not,_in,_gt,_gte,_lt,_lte", "text": "=,_not,_in,_like,_regex"}
    return [(name, f, kind, ops[kind]) for name, spec in sorted(selects.items()) for f, kind in sorted(spec.fields.items())]


def repair_column(name: str, columns: Sequence[str], least: float = 0.85) -> str | None:
    """The one column close enough to a misspelt name, if it is clearly the closest."""
    scored = sorted(((difflib.SequenceMatcher(None, name.lower(), c.lower()).ratio(), c) for c in columns), reverse=True)
    if scored and scored[0][0] >= least and (len(scored) < 2 or scored[0][0] - scored[1][0] > 0.02):
        return scored[0][1]
    return None
