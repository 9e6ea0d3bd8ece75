"""Members of level attributes and sets of them: lazy, path-qualified, and without shared state."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Numeric, Resolve, Test
from ..model import Level, ModelError

if TYPE_CHECKING:
    from ..session import Cube


class NoSuchMember(AttributeError, KeyError):
    """The attribute has no such member."""


@dataclass(frozen=True, eq=False)
class AttributeRef(Numeric):
    """A column of a level: ``cube.customer.nation.n_name``."""

    cube: Cube
    dimension: str
    level: str
    name: str

    def refs(self):
        yield self.dimension, self.level, self.name

    def column(self, resolve: Resolve) -> Column:
        return resolve(self.dimension, self.level, self.name)

    def __repr__(self) -> str:
        return f"{self.dimension}.{self.level}.{self.name}"

    def __getitem__(self, value: Any) -> Member:
        """The member with this value; the level's table isn't read until a query is."""
        return Member(self, value)

    def members(self) -> MemberSet:
        """All members."""
        return MemberSet(self)

    def frame(self) -> DataFrame:
        """``key`` and ``member`` of every row of the level, labels repeated under other parents."""
        from ..plans.planner import level_frame

        return level_frame(self.cube, self.dimension, self.level, [self.name])

    def distinct_labels(self) -> DataFrame:
        return self.frame().select("member").distinct()


@dataclass(frozen=True)
class Step:
    """One ancestor of a member: its level, attribute and value."""

    level: str
    attribute: str
    value: Any


@dataclass(frozen=True, eq=False)
class Member:
    """A value of an attribute, within the ancestors of ``path`` (nearest last).

    Without a path it stands for all members of that value under any ancestor.
    """

    attribute: AttributeRef
    value: Any
    path: tuple[Step, ...] = ()

    def __repr__(self) -> str:
        return f"Member({'/'.join([*(str(s.value) for s in self.path), str(self.value)])})"

    def same(self, other: Member) -> bool:
        a, b = self.attribute, other.attribute
        return (a.dimension, a.level, a.name, self.value, self.path) == (b.dimension, b.level, b.name, other.value, other.path)

    @property
    def parent(self) -> Member | None:
        if not self.path:
            return None
        s = self.path[-1]
        return Member(replace(self.attribute, level=s.level, name=s.attribute), s.value, self.path[:-1])

    def _child_attribute(self) -> AttributeRef:
        a = self.attribute
        d = a.cube.model.dimension(a.dimension)
        child = d.child(a.level)
        if child is None:
            raise ModelError(f"{a.dimension}.{a.level} is the lowest level")
        return replace(a, level=child, name=d.level(child).label)

    def _as_path(self) -> tuple[Step, ...]:
        return (*self.path, Step(self.attribute.level, self.attribute.name, self.value))

    def children(self) -> MemberSet:
        """All members of the level below under this one."""
        return MemberSet(self._child_attribute(), under=self)

    def __getitem__(self, value: Any) -> Member:
        """A child by its label: ``year[2022]["January"]``."""
        return Member(self._child_attribute(), value, self._as_path())

    def __getattr__(self, name: str) -> Member:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def condition(self, resolve: Resolve) -> Column:
        a = self.attribute
        own = _equals(resolve(a.dimension, a.level, a.name), self.value)
        return reduce(Column.__and__, [_equals(resolve(a.dimension, s.level, s.attribute), s.value) for s in self.path], own)

    def refs(self):
        yield from self.attribute.refs()
        for s in self.path:
            yield self.attribute.dimension, s.level, s.attribute

    def exists(self) -> bool:
        from ..plans.planner import members_frame

        return bool(members_frame(MemberSet(self.attribute, (self,))).take(1))

    def checked(self) -> Member:
        """This member if the level has it, else ``NoSuchMember``."""
        if not self.exists():
            raise NoSuchMember(repr(self))
        return self


def _equals(column: Column, value: Any) -> Column:
    """Equality that compares a text literal with a number by its number, as databases do."""
    return column.isNull() if value is None else column == F.lit(value)


@dataclass(frozen=True, eq=False)
class MemberSet:
    """Members of one attribute: all of them, all under a parent, or a list. Lazy; a selection
    belongs to the axis that it is put on and to nothing else."""

    attribute: AttributeRef
    listed: tuple[Member, ...] | None = None
    under: Member | None = None

    @classmethod
    def of(cls, members: Any) -> MemberSet:
        """From what axes take: a set, an attribute (all members), a member or a list of members."""
        if isinstance(members, MemberSet):
            return members
        if isinstance(members, AttributeRef):
            return members.members()
        given = [members] if isinstance(members, Member) else list(members)
        if not given:
            raise ValueError("an axis needs at least one member")
        first = given[0].attribute
        for m in given:
            if repr(m.attribute) != repr(first):
                raise ValueError(f"members of {first} and {m.attribute} can't share an axis")
        return cls(first, tuple(given))

    @property
    def is_all(self) -> bool:
        return self.listed is None and self.under is None

    def refs(self):
        yield from self.attribute.refs()
        for m in [*(self.listed or ()), *([self.under] if self.under else [])]:
            yield from m.refs()

    def condition(self, resolve: Resolve) -> Column | None:
        """The filter that the set means; None for all members."""
        parts = []
        if self.under:
            parts.append(self.under.condition(resolve))
        if self.listed is not None:
            plain = [m.value for m in self.listed if not m.path and m.value is not None]
            some = [m.condition(resolve) for m in self.listed if m.path or m.value is None]
            a = self.attribute
            if plain:
                some.append(resolve(a.dimension, a.level, a.name).isin(plain))
            parts.append(reduce(Column.__or__, some) if some else F.lit(False))
        return reduce(Column.__and__, parts) if parts else None

    def as_test(self) -> Test | None:
        """A test on one attribute that all members of the set pass, for pruning."""
        if self.listed is not None and not any(m.path for m in self.listed):
            return self.attribute.isin([m.value for m in self.listed])
        ways = [m._as_path() for m in self.listed] if self.listed is not None else [self.under._as_path()] if self.under else []
        tops = {(w[0].level, w[0].attribute) for w in ways}
        if len(tops) != 1:
            return None
        level, name = tops.pop()
        return replace(self.attribute, level=level, name=name).isin([w[0].value for w in ways])

    def frame(self) -> DataFrame:
        """``key, member`` of the set's rows in the level's table."""
        from ..plans.planner import members_frame

        return members_frame(self)

    def load(self, limit: int = 10_000) -> list[Member]:
        """The members one by one, for navigation; more than ``limit`` are refused."""
        rows = self.frame().select("member").distinct().orderBy("member").take(limit + 1)
        if len(rows) > limit:
            raise ValueError(f"{self.attribute} has more than {limit} members here; use frame()")
        path = self.under._as_path() if self.under else ()
        return [Member(self.attribute, r.member, path) for r in rows]

    def _list(self, other: MemberSet) -> tuple[tuple[Member, ...], tuple[Member, ...]]:
        if repr(self.attribute) != repr(other.attribute) or self.listed is None or other.listed is None:
            raise ValueError("only lists of members of one attribute combine")
        return self.listed, other.listed

    def __or__(self, other: MemberSet) -> MemberSet:
        a, b = self._list(other)
        return MemberSet(self.attribute, (*a, *(m for m in b if not any(m.same(x) for x in a))))

    def __and__(self, other: MemberSet) -> MemberSet:
        a, b = self._list(other)
        return MemberSet(self.attribute, tuple(m for m in a if any(m.same(x) for x in b)))

    def __sub__(self, other: MemberSet) -> MemberSet:
        a, b = self._list(other)
        return MemberSet(self.attribute, tuple(m for m in a if not any(m.same(x) for x in b)))


@dataclass(frozen=True)
class LevelRef:
    """A level of a dimension: its columns are attributes."""

    cube: Cube
    dimension: str
    level: Level

    @property
    def name(self) -> str:
        return self.level.name

    @property
    def label(self) -> AttributeRef:
        return AttributeRef(self.cube, self.dimension, self.level.name, self.level.label)

    def attributes(self) -> list[str]:
        """The columns besides the key and the label."""
        return [a for a in self.level.attributes if a not in (self.level.key, self.level.label)]

    def members(self) -> MemberSet:
        return self.label.members()

    def metadata(self) -> DataFrame:
        """The level as RDF triples."""
        from ..plans.metadata import triples_frame

        return triples_frame(self.cube, dimension=self.dimension, level=self.level.name)

    def __getitem__(self, column: Any) -> AttributeRef | Member:
        """A column by its name; any value that isn't text is a member of the label."""
        if not isinstance(column, str):
            return self.label[column]
        if column not in self.level.all_columns:
            raise ModelError(f"level {self.dimension}.{self.level.name} has no column {column!r}; it has {list(self.level.all_columns)}")
        return AttributeRef(self.cube, self.dimension, self.level.name, column)

    def __getattr__(self, column: str) -> AttributeRef:
        if column.startswith("__"):
            raise AttributeError(column)
        try:
            return self[column]
        except ModelError as e:
            raise AttributeError(str(e)) from None

    def parent(self) -> str:
        return self.cube.model.dimension(self.dimension).parent(self.level.name)

    def child(self) -> str | None:
        return self.cube.model.dimension(self.dimension).child(self.level.name)


@dataclass(frozen=True)
class DimensionRef:
    """A dimension of a cube: its visible levels are attributes."""

    cube: Cube
    name: str

    def hierarchies(self) -> list[str]:
        return self.cube.model.dimension(self.name).hierarchies()

    def lowest_level(self) -> str:
        return self.cube.model.dimension(self.name).lowest_level()

    def metadata(self) -> DataFrame:
        """The dimension and its levels as RDF triples."""
        from ..plans.metadata import triples_frame

        return triples_frame(self.cube, dimension=self.name)

    def __getitem__(self, level: str) -> LevelRef:
        return LevelRef(self.cube, self.name, self.cube.model.dimension(self.name).level(level))

    def __getattr__(self, level: str) -> LevelRef:
        if level.startswith("__"):
            raise AttributeError(level)
        try:
            return self[level]
        except ModelError as e:
            raise AttributeError(str(e)) from None
