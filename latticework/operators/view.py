"""Queries on a cube: immutable specifications that compile to one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.expr import Aggregated, MeasureRef, Numeric, Predicate
from ..model import ALL, ModelError
from .members import AttributeRef, DimensionRef, Member, MemberSet

if TYPE_CHECKING:
    from ..session import Cube

#: Names of the first axes, by number.
AXES = ("columns", "rows", "pages", "sections", "chapters")


@dataclass(frozen=True, eq=False)
class View:
    """Axes by number, measures by name, and a filter.

    Every method returns a new view; nothing is read before ``to_df`` and what builds on it runs.
    """

    cube: Cube
    axes: Mapping[int, MemberSet] = field(default_factory=dict)
    chosen: Mapping[str, Numeric] | None = None
    predicate: Predicate | None = None
    having_: Predicate | None = None
    default: str | None = None
    top: tuple[int, tuple[tuple[str, bool], ...]] | None = None

    # -- names -------------------------------------------------------------------------------
    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        return getattr(self.cube, name)

    def __getitem__(self, name: str) -> DimensionRef | MeasureRef:
        return self.cube[name]

    def dimensions(self) -> list[str]:
        return self.cube.dimensions()

    # -- axes --------------------------------------------------------------------------------
    def axis(self, number: int, members: Any) -> View:
        """Put members on axis ``number``, instead of what is there."""
        if number < 0:
            raise ValueError("axes count from 0")
        new = MemberSet.of(members)
        for n, s in self.axes.items():
            if n != number and (s.attribute.dimension, s.attribute.level) == (new.attribute.dimension, new.attribute.level):
                raise ModelError(f"{new.attribute} is on axis {n} already")
        return replace(self, axes={**self.axes, number: new})

    def columns(self, members: Any) -> View:
        return self.axis(0, members)

    def rows(self, members: Any) -> View:
        return self.axis(1, members)

    def pages(self, members: Any) -> View:
        return self.axis(2, members)

    def sections(self, members: Any) -> View:
        return self.axis(3, members)

    def chapters(self, members: Any) -> View:
        return self.axis(4, members)

    def ordered_axes(self) -> list[MemberSet]:
        if sorted(self.axes) != list(range(len(self.axes))):
            raise ModelError(f"axes {sorted(self.axes)} leave a gap")
        return [self.axes[n] for n in range(len(self.axes))]

    # -- filters -----------------------------------------------------------------------------
    def where(self, predicate: Predicate) -> View:
        """Filter rows before aggregation; takes the place of an earlier filter."""
        return replace(self, predicate=predicate)

    def and_where(self, predicate: Predicate) -> View:
        return replace(self, predicate=predicate if self.predicate is None else self.predicate & predicate)

    def having(self, predicate: Predicate) -> View:
        """Filter cells after aggregation; measures stand for their aggregates."""
        return replace(self, having_=predicate)

    # -- measures ----------------------------------------------------------------------------
    def measures(self, *stored: Numeric | str, **calculated: Numeric) -> View:
        """Choose measures: stored ones by themselves, calculated ones by keyword."""
        chosen: dict[str, Numeric] = {}
        for m in stored:
            ref = self.cube.measure(m) if isinstance(m, str) else m
            if not isinstance(ref, (MeasureRef, Aggregated)):
                raise ModelError("calculated measures need a name: measures(name=...)")
            inner = ref
            while isinstance(inner, Aggregated):
                inner = inner.inner
            if not isinstance(inner, MeasureRef):
                raise ModelError("calculated measures need a name: measures(name=...)")
            chosen[inner.name if isinstance(ref, MeasureRef) else f"{ref.agg}_{inner.name}"] = ref
        for name, m in calculated.items():
            if not isinstance(m, Numeric):
                raise ModelError(f"{name!r} is no measure")
            chosen[name] = m
        return replace(self, chosen=chosen)

    def no_measures(self) -> View:
        """Only the coordinates that exist."""
        return replace(self, chosen={})

    def with_measures(self, *stored: Numeric | str) -> View:
        """The same view with other measures; this one keeps its own."""
        return self.measures(*stored)

    def default_measure(self, measure: MeasureRef | str) -> View:
        """Use this measure wherever none is chosen."""
        return replace(self, default=measure if isinstance(measure, str) else measure.name)

    def used_measures(self) -> dict[str, Numeric]:
        if self.chosen is not None:
            return dict(self.chosen)
        if self.default:
            return {self.default: self.cube.measure(self.default)}
        return {m.name: self.cube.measure(m.name) for m in self.cube.model.measures}

    # -- navigation --------------------------------------------------------------------------
    def rollup(self, **to: str) -> View:
        """Show dimensions at a coarser level; ``ALL`` takes them off their axis."""
        return self._move(self.cube.rollup(**to), to)

    def drilldown(self, **to: str) -> View:
        """Show dimensions at a finer level."""
        for name, level in to.items():
            at = [s.attribute.level for s in self.axes.values() if s.attribute.dimension == name]
            d = self.cube.model.dimension(name)
            if at and d.index(level) > d.index(at[0]):
                raise ModelError(f"drill-down of {name!r} from {at[0]!r} to {level!r} would go up")
        down = {n: x for n, x in to.items() if self.cube.model.dimension(n).index(x) < self.cube.model.dimension(n).lowest}
        return self._move(self.cube.drilldown(**down), to)

    def _move(self, cube: Cube, to: Mapping[str, str]) -> View:
        axes: list[MemberSet] = []
        left = dict(to)
        for s in self.ordered_axes():
            a = s.attribute
            level = left.pop(a.dimension, None)
            if level is None:
                axes.append(s)
            elif level != ALL:
                d = cube.model.dimension(a.dimension)
                axes.append(s if level == a.level else MemberSet(AttributeRef(cube, d.name, level, d.level(level).label)))
        for name, level in left.items():
            if level != ALL:
                d = cube.model.dimension(name)
                axes.append(MemberSet(AttributeRef(cube, name, level, d.level(level).label)))
        return replace(self, cube=cube, axes=dict(enumerate(axes)))

    def slice(self, member: Member) -> View:
        """Fix one member: filter by it and take its dimension off the axes."""
        axes = [s for s in self.ordered_axes() if s.attribute.dimension != member.attribute.dimension]
        return replace(self, axes=dict(enumerate(axes))).and_where(InSet(MemberSet(member.attribute, (member,))))

    def dice(self, on: Mapping[str | int, Any]) -> View:
        """Restrict axes (by number or name) to members."""
        out = self
        for axis, members in on.items():
            name = axis.removesuffix("s") + "s" if isinstance(axis, str) else axis
            n = axis if isinstance(axis, int) else AXES.index(name) if name in AXES else -1
            if n not in self.axes:
                raise ModelError(f"no axis {axis!r}")
            new = MemberSet.of(members)
            old = self.axes[n]
            if new.attribute.dimension != old.attribute.dimension:
                raise ModelError(f"axis {axis!r} shows {old.attribute}, not {new.attribute}")
            same = repr(new.attribute) == repr(old.attribute)
            out = out.axis(n, new) if same and old.is_all else out.and_where(InSet(new))
        return out

    # -- results -----------------------------------------------------------------------------
    def limit(self, n: int, *by: str, descending: bool = True) -> View:
        """Only the ``n`` first cells in the order of these output columns."""
        return replace(self, top=(n, tuple((c, descending) for c in by)))

    def to_df(self, *, keys: bool = False) -> DataFrame:
        """One row a cell: axis columns ``<dimension>_<level>`` (with ``_key`` columns if ``keys``)
        and measures."""
        from ..plans.planner import compile_view

        return compile_view(self, keys=keys)

    def subtotals(self, *, how: str = "rollup") -> DataFrame:
        """Cells with subtotals over the axes: ``rollup`` from the last axis, or all of a ``cube``.
        Null stands for all members; ``level_of`` numbers the grouping."""
        from ..plans.planner import compile_view

        return compile_view(self, grouping=how)

    def shares(self, measure: str, *, of: str) -> DataFrame:
        """Cells with ``share``: the part of ``measure`` in its total for each ``of`` member."""
        from ..plans.planner import share_of

        return share_of(self, measure, of)

    def crosstab(self) -> DataFrame:
        """Even axes across, odd axes down, as a Spark DataFrame."""
        from .crosstab import crosstab

        return crosstab(self)

    def output(self, *, flat: bool = False) -> pd.DataFrame:
        """The aggregated cells in pandas: a cross-tab, or flat rows."""
        from .crosstab import to_pandas

        return self.to_df().toPandas() if flat or not self.axes else to_pandas(self)


@dataclass(frozen=True, eq=False)
class InSet(Predicate):
    """Membership in a set of members, ancestors included."""

    members: MemberSet

    def refs(self):
        return self.members.refs()

    def implied(self):
        return self.members.as_test()

    def column(self, resolve):
        from pyspark.sql import functions as F

        condition = self.members.condition(resolve)
        return F.lit(True) if condition is None else condition
