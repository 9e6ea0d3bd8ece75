"""The public face: a session holds cubes by name, a cube is a model bound to a source."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.expr import MeasureRef
from .model import CubeModel, ForeignKey, ModelError
from .operators.members import DimensionRef
from .operators.view import View
from .sources.tables import TableSource


@dataclass(frozen=True, eq=False)
class Cube:
    """Dimensions and measures are attributes (``cube.customer``, ``cube.revenue``), or items where
    a name is taken by a method (``cube["rows"]``)."""

    model: CubeModel
    source: TableSource

    @property
    def name(self) -> str:
        return self.model.name

    def dimensions(self) -> list[str]:
        return [d.name for d in self.model.dimensions]

    def measures(self) -> list[str]:
        return [m.name for m in self.model.measures]

    def measure(self, name: str) -> MeasureRef:
        m = self.model.measure(name)
        return MeasureRef(m.name, m.column, m.agg)

    def __getitem__(self, name: str) -> DimensionRef | MeasureRef:
        if name in self.dimensions():
            return DimensionRef(self, name)
        if name in self.measures():
            return self.measure(name)
        raise ModelError(f"cube {self.name!r} has no dimension or measure {name!r}")

    def __getattr__(self, name: str) -> Any:
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self[name]
        except ModelError as e:
            raise AttributeError(str(e)) from None

    def view(self) -> View:
        """A view without axes, with all measures."""
        return View(self)

    def rollup(self, **to: str) -> Cube:
        return Cube(self.model.rollup(**to), self.source)

    def drilldown(self, **to: str) -> Cube:
        return Cube(self.model.drilldown(**to), self.source)

    def metadata(self) -> DataFrame:
        """The model as RDF triples (subject, predicate, object)."""
        from .plans.metadata import triples_frame

        return triples_frame(self)


class CubeSession:
    """Cubes by name."""

    def __init__(self, *cubes: Cube) -> None:
        self._cubes = {c.name: c for c in cubes}

    @classmethod
    def infer(cls, spark: SparkSession, source: TableSource, *, name: str = "cube", keys: Iterable[ForeignKey] | None = None, **how) -> CubeSession:
        """Infer the cube of a source; errors are raised. See ``plans.infer.infer_model``."""
        from .plans.infer import infer_model

        return cls(Cube(infer_model(source, name=name, keys=keys, **how), source))

    @property
    def views(self) -> list[str]:
        return list(self._cubes)

    def add(self, cube: Cube) -> None:
        self._cubes[cube.name] = cube

    def cube(self, name: str) -> Cube:
        if name not in self._cubes:
            raise KeyError(f"no cube {name!r}; there are {self.views}")
        return self._cubes[name]

    def load_view(self, name: str) -> View:
        return self.cube(name).view()

    def __getattr__(self, name: str) -> View:
        if name.startswith("_") or name not in self._cubes:
            raise AttributeError(name)
        return self.load_view(name)
