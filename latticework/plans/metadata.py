"""The model as RDF triples in the QB and QB4OLAP vocabularies, with stable ids for blank nodes."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..model import CubeModel

if TYPE_CHECKING:
    from ..session import Cube

# Namespaces of the vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
QB = "http://purl.org/linked-data/cube#"
QB4O = "http://purl.org/qb4olap/cubes/"


def triples(model: CubeModel, base: str = "http://example.org/", *, dimension: str | None = None, level: str | None = None) -> list[tuple[str, str, str]]:
    """Distinct triples in a fixed order: of the cube, of one dimension, or of one of its levels."""
    out: dict[tuple[str, str, str], None] = {}
    dsd = f"{base}{model.name}_dsd"
    say = lambda s, p, o: out.setdefault((s, p, o))
    if not dimension:
        say(dsd, RDF_TYPE, f"{QB}DataStructureDefinition")
    for d in [model.dimension(dimension)] if dimension else model.dimensions:
        node, blank = f"{base}{d.name}", f"_:dimension_{d.name}"
        visible = d.levels[d.lowest :]
        if not level:
            say(dsd, f"{QB}component", blank)
            say(blank, f"{QB4O}level", f"{base}{visible[0].name}" if visible else f"{base}ALL")
            say(node, RDF_TYPE, f"{QB}DimensionProperty")
        for i, lv in enumerate(visible):
            if level not in (None, lv.name):
                continue
            at = f"{base}{lv.name}"
            say(at, RDF_TYPE, f"{QB4O}LevelProperty")
            say(at, f"{QB4O}inDimension", node)
            if i + 1 < len(visible):
                say(at, f"{QB4O}parentLevel", f"{base}{visible[i + 1].name}")
            for a in dict.fromkeys((lv.label, *lv.attributes)):
                say(f"{base}{a}", RDF_TYPE, f"{QB}AttributeProperty")
                say(at, f"{QB4O}hasAttribute", f"{base}{a}")
    for m in () if dimension else model.measures:
        blank = f"_:measure_{m.name}"
        say(dsd, f"{QB}component", blank)
        say(blank, f"{QB4O}hasAggregateFunction", f"{QB4O}{m.agg}")
        say(blank, f"{QB}measure", f"{base}{m.name}")
        say(f"{base}{m.name}", RDF_TYPE, f"{QB}MeasureProperty")
    return list(out)


def triples_frame(cube: Cube, **of: str) -> DataFrame:
    """``subject, predicate, object``; as many rows as the model has statements."""
    return cube.source.spark.createDataFrame(triples(cube.model, **of), "subject string, predicate string, object string")
