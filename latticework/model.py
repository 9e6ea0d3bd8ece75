"""The multidimensional model: plain frozen values without any Spark state."""

from __future__ import annotations

from dataclasses import dataclass, replace

ALL = "ALL"


class ModelError(ValueError):
    """A name or operation that the model doesn't allow."""


@dataclass(frozen=True)
class ForeignKey:
    """``table.column`` refers to ``to_table.to_column``."""

    table: str
    column: str
    to_table: str
    to_column: str


@dataclass(frozen=True)
class Level:
    """One level of a hierarchy.

    ``key`` identifies a member and ``label`` names it. A level has a table of its own (snowflake),
    or, with ``table`` None, its columns stand in the level below (star): in the lower level's
    table, or for a dimension derived from a fact column in ``columns``, SQL expressions by name in
    which ``{fk}`` is that column, and ``spans`` says which of them are a ``year`` or a ``year_month``
    of it, so that tests of those prune its scan. ``parent_fk`` is the column with the key of the level above
    where that has its own table.
    """

    name: str
    key: str
    label: str
    attributes: tuple[str, ...] = ()
    table: str | None = None
    parent_fk: str | None = None
    columns: tuple[tuple[str, str], ...] = ()
    spans: tuple[tuple[str, str], ...] = ()

    @property
    def all_columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.key, self.label, *self.attributes)))


@dataclass(frozen=True)
class Dimension:
    """A role: levels from the lowest up (the top, ``ALL``, is implied), reached from the fact's
    column ``fact_fk``. ``lowest`` is where the visible levels begin after a roll-up."""

    name: str
    fact_fk: str
    levels: tuple[Level, ...]
    lowest: int = 0

    def hierarchies(self) -> list[str]:
        """Visible level names from the lowest up, ``ALL`` last."""
        return [*(x.name for x in self.levels[self.lowest :]), ALL]

    def lowest_level(self) -> str:
        return self.hierarchies()[0]

    def index(self, level: str) -> int:
        """Position of a level; ``ALL`` comes after the last."""
        if level == ALL:
            return len(self.levels)
        for i, x in enumerate(self.levels):
            if x.name == level:
                return i
        raise ModelError(f"dimension {self.name!r} has no level {level!r}; it has {[x.name for x in self.levels]}")

    def level(self, name: str) -> Level:
        i = self.index(name)
        if i < self.lowest or i == len(self.levels):
            raise ModelError(f"level {name!r} of dimension {self.name!r} is not visible; visible are {self.hierarchies()}")
        return self.levels[i]

    def parent(self, level: str) -> str:
        return ALL if (i := self.index(level) + 1) >= len(self.levels) else self.levels[i].name

    def child(self, level: str) -> str | None:
        i = self.index(level)
        return self.levels[i - 1].name if i > self.lowest else None

    @property
    def derived(self) -> bool:
        return self.levels[0].table is None


@dataclass(frozen=True)
class StoredMeasure:
    """A numeric fact column and how it aggregates."""

    name: str
    column: str
    agg: str = "sum"


@dataclass(frozen=True)
class CubeModel:
    """A fact table, its dimensions and measures.

    ``hierarchy_join``: ``full`` joins every used dimension up to its top, so facts whose ancestors
    are missing are left out even where those aren't used; ``needed`` joins as far as a query needs,
    which is the same where the keys are known to be sound.
    """

    name: str
    fact: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[StoredMeasure, ...]
    hierarchy_join: str = "full"

    def dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.name == name:
                return d
        raise ModelError(f"cube {self.name!r} has no dimension {name!r}; it has {[d.name for d in self.dimensions]}")

    def measure(self, name: str) -> StoredMeasure:
        for m in self.measures:
            if m.name == name:
                return m
        raise ModelError(f"cube {self.name!r} has no measure {name!r}; it has {[m.name for m in self.measures]}")

    def _with(self, changed: dict[str, int]) -> CubeModel:
        return replace(self, dimensions=tuple(replace(d, lowest=changed.get(d.name, d.lowest)) for d in self.dimensions))

    def rollup(self, **to: str) -> CubeModel:
        """Drop the levels below the given ones (``ALL``: all of them). The model itself stays."""
        changed = {}
        for name, level in to.items():
            d = self.dimension(name)
            i = d.index(level)
            if i < d.lowest:
                raise ModelError(f"roll-up of {name!r} from {d.lowest_level()!r} to {level!r} would go down")
            changed[name] = i
        return self._with(changed)

    def drilldown(self, **to: str) -> CubeModel:
        """Bring levels back down to the given ones. ``ALL`` on a dimension at its top is no move."""
        changed = {}
        for name, level in to.items():
            d = self.dimension(name)
            i = d.index(level)
            if i > d.lowest:
                raise ModelError(f"drill-down of {name!r} from {d.lowest_level()!r} to {level!r} would go up")
            changed[name] = i
        return self._with(changed)
