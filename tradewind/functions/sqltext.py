"""Expressions as SQL text, for Columns of many parts.

Each call on a Column is several round trips to the JVM, which adds up to seconds where a
grammar has a thousand nodes. Here expressions are text with the operators of Columns; any
function of Spark SQL is an attribute of `S`. `applied` turns a function of such text into
a Column with one parse.
"""

from __future__ import annotations

import functools
import inspect
import itertools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


class Sql:
    """One expression."""

    def __init__(self, text: str, name: str = ""):
        self.text, self.name = text, name

    def __str__(self) -> str:
        return self.text

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"{self}.{field}")

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"cast({self} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"try_cast({self} AS {kind})")

    def isNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self} IS NULL)")

    def isNotNull(self) -> Sql:  # noqa: N802
        return Sql(f"({self} IS NOT NULL)")

    def isin(self, values: list) -> Sql:
        return Sql(f"({self} IN ({', '.join(map(_text, values))}))")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"rlike({self}, {_text(pattern)})")

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self})")

    def __neg__(self) -> Sql:
        return Sql(f"(- {self})")

    def __hash__(self) -> int:
        return hash(self.text)


def _text(value: object) -> str:
    """A value as SQL: expressions as they are, others as literals."""
    if isinstance(value, Sql):
        return value.text
    if value is None:
        return "NULL"
    if isinstance(value, str):
        plain = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{plain}'"
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value)


for _method, _operator in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "add": "+", "sub": "-", "mul": "*", "and": "AND", "or": "OR"}.items():
    setattr(Sql, f"__{_method}__", lambda a, b, op=_operator: Sql(f"({a} {op} {_text(b)})"))


class Case(Sql):
    """CASE with branches to come."""

    def __init__(self, branches: list[tuple[Sql, object]], other: object = None):
        self.branches, self.other, self.name = branches, other, ""

    @property
    def text(self) -> str:
        each = " ".join(f"WHEN {_text(c)} THEN {_text(v)}" for c, v in self.branches)
        return f"(CASE {each} ELSE {_text(self.other)} END)"

    def when(self, condition: Sql, value: object) -> Case:
        return Case([*self.branches, (condition, value)])

    def otherwise(self, value: object) -> Case:
        return Case(self.branches, value)

    __hash__ = Sql.__hash__


class _Functions:
    """S.f(a, b) is f(a, b); Python functions among the arguments become lambdas."""

    @staticmethod
    def lit(value: object) -> Sql:
        return Sql(_text(value))

    @staticmethod
    def when(condition: Sql, value: object) -> Case:
        return Case([(condition, value)])

    @staticmethod
    def struct(*fields: Sql) -> Sql:
        return Sql("named_struct({})".format(", ".join(f"'{f.name}', {f}" for f in fields)))

    def __getattr__(self, function: str) -> Callable[..., Sql]:
        def call(*args: object) -> Sql:
            return Sql(f"{function}({', '.join(_lambda(a) if callable(a) else _text(a) for a in args)})")

        return call


def _lambda(function: Callable[..., Sql]) -> str:
    names = [f"v{next(_names)}" for _ in inspect.signature(function).parameters]
    body = _text(function(*map(Sql, names)))
    return f"({', '.join(names)}) -> {body}" if len(names) > 1 else f"{names[0]} -> {body}"


S = _Functions()


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """body(value), with value computed once."""
    return S.get(S.transform(S.array(value), body), 0)


def applied(body: Callable[..., Sql], *columns: Column) -> Column:
    """The Column body(*columns): body is called once with names, and parsed once."""
    packed = F.struct(*(c.alias(f"c{k}") for k, c in enumerate(columns)))
    text = _lambda(lambda row: body(*(row[f"c{k}"] for k in range(len(columns)))))
    return F.get(F.call_function("transform", F.array(packed), F.expr(text)), F.lit(0))


def on_columns(function: Callable[..., Sql]) -> Callable[..., Column]:
    """The function for Columns too: with Columns as arguments it gives a Column."""

    @functools.wraps(function)
    def call(*args: Sql | Column, **options: object) -> Sql | Column:
        if any(isinstance(a, Column) for a in args):
            return applied(lambda *each: function(*each, **options), *args)
        return function(*args, **options)

    return call
