"""Spark SQL expressions as text, for expressions of thousands of nodes.

A ``Column`` is built by a call to the JVM for every node, a text by none: ``S.name(...)`` writes a call
of the SQL function, ``Sql`` has the operators, and ``column()`` has Spark parse the whole at once.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, functions as F

_names = count()


def _text(x: object) -> str:
    if isinstance(x, Sql):
        return x.text
    if x is None or isinstance(x, bool):
        return str(x).upper() if x is not None else "NULL"
    if isinstance(x, str):
        escaped = x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
        return f"'{escaped}'"
    return repr(x)


class Sql:
    """An expression. Values of Python beside it are literals."""

    def __init__(self, text: str, name: str | None = None):
        self.text, self.name = text, name

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.text} AS {kind})")

    def column(self) -> Column:
        made = F.expr(self.text)
        return made.alias(self.name) if self.name else made

    def __getitem__(self, field: str | int) -> Sql:
        return Sql(f"{self.text}.`{field}`") if isinstance(field, str) else S.get(self, field)

    def between(self, low: object, high: object) -> Sql:
        return (self >= low) & (self <= high)

    def isin(self, *values: object) -> Sql:
        return S.array_contains(S.array(*values), self)

    def __eq__(self, other: object) -> Sql:  # type: ignore[override]
        return Sql(f"`=`({self.text}, {_text(other)})")

    def __ne__(self, other: object) -> Sql:  # type: ignore[override]
        return ~(self == other)

    def __invert__(self) -> Sql:
        return Sql(f"`not`({self.text})")

    __hash__ = None  # type: ignore[assignment]


def _operator(name: str, swapped: bool = False) -> Callable[[Sql, object], Sql]:
    def of(self: Sql, other: object) -> Sql:
        a, b = (_text(other), self.text) if swapped else (self.text, _text(other))
        return Sql(f"`{name}`({a}, {b})")

    return of


for _method, _name in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "and", "or": "or"}.items():
    setattr(Sql, f"__{_method}__", _operator(_name))
    setattr(Sql, f"__r{_method}__", _operator(_name, swapped=True))
for _method, _name in {"lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Sql, f"__{_method}__", _operator(_name))


class _Functions:
    """``S.name(...)`` is a call of the SQL function ``name``; a Python function among the arguments is a lambda."""

    def __getattr__(self, name: str) -> Callable[..., Sql]:
        return lambda *args: Sql(f"{name}({', '.join(self._lambda(a) if callable(a) and not isinstance(a, Sql) else _text(a) for a in args)})")

    @staticmethod
    def _lambda(body: Callable[..., Sql]) -> str:
        given = body.__code__.co_argcount - len(body.__defaults__ or ())
        names = [f"x{next(_names)}" for _ in range(given)]
        return f"{names[0] if given == 1 else '(' + ', '.join(names) + ')'} -> {_text(body(*map(Sql, names)))}"

    @staticmethod
    def col(name: str) -> Sql:
        return Sql(f"`{name.replace('`', '``')}`")

    @staticmethod
    def lit(value: object) -> Sql:
        return Sql(_text(value))

    @staticmethod
    def struct(*fields: Sql) -> Sql:
        return Sql(f"named_struct({', '.join(f'{_text(f.name)}, {f.text}' for f in fields)})")

    @staticmethod
    def when(test: Sql, then: object, otherwise: object = None) -> Sql:
        return Sql(f"if({test.text}, {_text(then)}, {_text(otherwise)})")


S = _Functions()


def let(value: Sql, body: Callable[[Sql], Sql]) -> Sql:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return S.get(S.transform(S.array(value), body), 0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Sql) -> Sql:
    """A-Z to a-z and nothing else."""
    return let(text, lambda t: S.when(S.octet_length(t) == S.length(t), S.lower(t), S.translate(t, UPPER, LOWER)))


def text_or_empty(name: str) -> Sql:
    return S.coalesce(S.col(name), "")
