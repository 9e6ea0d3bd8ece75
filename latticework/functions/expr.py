"""Measures and predicates as small trees that become Spark columns; no SQL text is put together."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (dimension, level, column) or (None, None, fact column) to a Spark column.
Resolve = Callable[[str | None, str | None, str], Column]
OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}


class Operand:
    """What can be compared: an attribute, a measure, an expression over measures."""

    def refs(self) -> Iterator[tuple[str | None, str | None, str]]:
        raise NotImplementedError

    def column(self, resolve: Resolve) -> Column:
        raise NotImplementedError

    __hash__ = object.__hash__

    def __eq__(self, other: Any) -> Compare:  # type: ignore[override]
        return Compare("==", self, other)

    def __ne__(self, other: Any) -> Compare:  # type: ignore[override]
        return Compare("!=", self, other)

    def __lt__(self, other: Any) -> Compare:
        return Compare("<", self, other)

    def __le__(self, other: Any) -> Compare:
        return Compare("<=", self, other)

    def __gt__(self, other: Any) -> Compare:
        return Compare(">", self, other)

    def __ge__(self, other: Any) -> Compare:
        return Compare(">=", self, other)

    def isin(self, *values: Any) -> Test:
        given = list(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else list(values)
        return Test(self, lambda c: c.isin(given), tuple(given))

    def between(self, low: Any, high: Any) -> Predicate:
        return (self >= low) & (self <= high)

    def like(self, pattern: str) -> Test:
        return Test(self, lambda c: c.like(pattern))

    def is_null(self) -> Test:
        return Test(self, lambda c: c.isNull())

    def is_not_null(self) -> Test:
        return Test(self, lambda c: c.isNotNull())


def as_operand(x: Any) -> Operand:
    return x if isinstance(x, Operand) else Literal(x)


@dataclass(frozen=True, eq=False)
class Literal(Operand):
    value: Any

    def refs(self):
        return iter(())

    def column(self, resolve: Resolve) -> Column:
        return F.lit(self.value)


class Numeric(Operand):
    """An operand that arithmetic works on, row by row before aggregation."""

    agg = "sum"

    def __add__(self, x: Any) -> Arithmetic:
        return Arithmetic("+", self, as_operand(x))

    def __sub__(self, x: Any) -> Arithmetic:
        return Arithmetic("-", self, as_operand(x))

    def __mul__(self, x: Any) -> Arithmetic:
        return Arithmetic("*", self, as_operand(x))

    def __truediv__(self, x: Any) -> Arithmetic:
        return Arithmetic("/", self, as_operand(x))

    def __radd__(self, x: Any) -> Arithmetic:
        return Arithmetic("+", as_operand(x), self)

    def __rsub__(self, x: Any) -> Arithmetic:
        return Arithmetic("-", as_operand(x), self)

    def __rmul__(self, x: Any) -> Arithmetic:
        return Arithmetic("*", as_operand(x), self)

    def __rtruediv__(self, x: Any) -> Arithmetic:
        return Arithmetic("/", as_operand(x), self)

    def aggregated(self, agg: str) -> Aggregated:
        """The same expression under another aggregate."""
        return Aggregated(self, agg)


@dataclass(frozen=True, eq=False)
class Arithmetic(Numeric):
    """``/`` gives null where the divisor is 0."""

    op: str
    left: Operand
    right: Operand

    def refs(self):
        yield from self.left.refs()
        yield from self.right.refs()

    def column(self, resolve: Resolve) -> Column:
        a, b = self.left.column(resolve), self.right.column(resolve)
        return F.try_divide(a, b) if self.op == "/" else ARITHMETIC[self.op](a, b)


@dataclass(frozen=True, eq=False)
class Aggregated(Numeric):
    inner: Numeric
    agg: str  # type: ignore[misc]

    def __post_init__(self) -> None:
        if self.agg not in AGGREGATES:
            raise ValueError(f"no aggregate {self.agg!r}; there are {sorted(AGGREGATES)}")

    def refs(self):
        return self.inner.refs()

    def column(self, resolve: Resolve) -> Column:
        return self.inner.column(resolve)


@dataclass(frozen=True, eq=False)
class MeasureRef(Numeric):
    name: str
    fact_column: str
    agg: str = "sum"  # type: ignore[misc]

    def refs(self):
        yield None, None, self.fact_column

    def column(self, resolve: Resolve) -> Column:
        return resolve(None, None, self.fact_column)

    def __repr__(self) -> str:
        return f"Measure({self.name})"


class Predicate:
    """A row filter. ``&``, ``|`` and ``~`` combine."""

    def refs(self) -> Iterator[tuple[str | None, str | None, str]]:
        raise NotImplementedError

    def column(self, resolve: Resolve) -> Column:
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return Combined(operator.and_, (self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Combined(operator.or_, (self, other))

    def __invert__(self) -> Predicate:
        return Negated(self)

    def __bool__(self) -> bool:
        raise TypeError("a predicate has no truth value; combine with &, | and ~, and put comparisons in parentheses")


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    op: str
    left: Operand
    right: Any

    def refs(self):
        yield from self.left.refs()
        yield from as_operand(self.right).refs()

    def column(self, resolve: Resolve) -> Column:
        return OPS[self.op](self.left.column(resolve), as_operand(self.right).column(resolve))


@dataclass(frozen=True, eq=False)
class Test(Predicate):
    operand: Operand
    test: Callable[[Column], Column]
    values: tuple = ()  # what the operand must be one of, where it is such a test

    def refs(self):
        return self.operand.refs()

    def column(self, resolve: Resolve) -> Column:
        return self.test(self.operand.column(resolve))


@dataclass(frozen=True, eq=False)
class Combined(Predicate):
    how: Callable[[Column, Column], Column]
    parts: tuple[Predicate, ...]

    def refs(self):
        for p in self.parts:
            yield from p.refs()

    def column(self, resolve: Resolve) -> Column:
        return reduce(self.how, (p.column(resolve) for p in self.parts))


@dataclass(frozen=True, eq=False)
class Negated(Predicate):
    inner: Predicate

    def refs(self):
        return self.inner.refs()

    def column(self, resolve: Resolve) -> Column:
        return ~self.inner.column(resolve)


def conjuncts(p: Predicate | None) -> Iterator[Predicate]:
    """The parts that must all hold."""
    if isinstance(p, Combined) and p.how is operator.and_:
        for x in p.parts:
            yield from conjuncts(x)
    elif p is not None:
        yield from conjuncts(p.implied()) if hasattr(p, "implied") else (p,)
