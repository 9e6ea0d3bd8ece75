"""Cross-tabs: even axes across, odd axes down, measures innermost, null where no cell is."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.planner import axis_name, column_name, compile_view, needed, resolve, role_frame
from ..sources.prepared import scratch_path

if TYPE_CHECKING:
    from .members import MemberSet
    from .view import View


class AmbiguousLabelError(ValueError):
    """Members of an axis have equal labels, even with their ancestors' labels before them."""


#: Columns of a cross-tab; a wider one is refused in favour of the long form.
MOST_COLUMNS = 10_000


def _paths(view: View, s: MemberSet, keys: list[Any]) -> dict[Any, str]:
    """For these keys, which the driver holds, the labels of the member and its ancestors from the
    top, joined by "/"; other members of the level stay where they are."""
    cube, a = view.cube, s.attribute
    d = cube.model.dimension(a.dimension)
    i = d.index(a.level)
    refs = [(d.name, a.level, a.name), (d.name, a.level, d.levels[i].key), *((d.name, lv.name, lv.label) for lv in d.levels[i + 1 :])]
    by, _ = needed(cube, refs)
    if d.derived:
        from ..plans.planner import derived_columns

        fact = cube.source.table(cube.model.fact)
        rows = fact.select(*[derived_columns(d, lv, c).alias(column_name(d.name, lv, c)) for lv, cs in by[d.name].items() for c in cs])
    else:
        rows, _ = role_frame(cube, d, by[d.name], full=False, start=i)
    parts = [resolve(*r).cast("string") for r in (*reversed(refs[2:]), refs[0])]
    paths = rows.select(resolve(*refs[1]).alias("key"), F.concat_ws("/", *parts).alias("path"))
    wanted = cube.source.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("wanted", paths.schema["key"].dataType)]))
    return {r.key: r.path for r in paths.join(F.broadcast(wanted), F.col("key").eqNullSafe(F.col("wanted")), "left_semi").distinct().collect()}


def _order(s: MemberSet, labels: list[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """Requested order where members are listed, else by key."""
    if s.listed is not None:
        place: dict[Any, int] = {}
        for i, m in enumerate(s.listed):
            place.setdefault(m.value, i)
        return sorted(labels, key=lambda kl: (place.get(kl[1], len(place)), str(kl[0])))
    try:
        return sorted(labels, key=lambda kl: (kl[0] is None, kl[0]))
    except TypeError:
        return sorted(labels, key=lambda kl: str(kl[0]))


def layout(view: View, cells: pd.DataFrame) -> tuple[list[str], dict[str, dict[Any, Any]], dict[str, list[Any]]]:
    """Axis columns, the title of every key, and the keys of each axis in order."""
    names, titles, orders = [], {}, {}
    for s in view.ordered_axes():
        n = axis_name(s, view.cube)
        names.append(n)
        pairs = list(dict.fromkeys(zip(cells[f"{n}_key"], cells[n], strict=True)))
        labels = dict(pairs)
        if len(set(labels.values())) < len(labels):
            labels = _paths(view, s, list(labels))
            if len(set(labels.values())) < len(labels):
                raise AmbiguousLabelError(f"members of {s.attribute} have equal labels and ancestors")
        titles[n] = labels
        orders[n] = [k for k, _ in _order(s, pairs)]
    return names, titles, orders


def to_pandas(view: View) -> pd.DataFrame:
    """The cross-tab of the aggregated cells in pandas."""
    measures = list(view.used_measures())
    cells = compile_view(view, keys=True).toPandas()
    names, titles, orders = layout(view, cells)
    across, down = names[::2], names[1::2]
    frame = cells[[*measures]].copy()
    for n in names:
        frame[n] = pd.Categorical([titles[n][k] for k in cells[f"{n}_key"]], [titles[n][k] for k in orders[n]], ordered=True)
    if not down:
        frame["_"] = 0
        down = ["_"]
    frame = frame.set_index([*down, *across])
    if not frame.index.is_unique:
        raise AmbiguousLabelError("several cells share a place")
    if not measures:
        frame["exists"] = True
        measures = ["exists"]
    out = frame[measures].unstack(list(range(len(down), len(down) + len(across))))
    out.columns = out.columns.reorder_levels([*range(1, len(across) + 1), 0])
    place = {n: {titles[n][k]: i for i, k in enumerate(orders[n])} for n in across}
    order = sorted(out.columns, key=lambda c: (*[place[n][v] for n, v in zip(across, c, strict=False)], measures.index(c[-1])))
    out = out[order].sort_index()
    out.columns.names = [*across, None]
    if down == ["_"]:
        out = out.reset_index(drop=True)
    return out


def crosstab(view: View) -> DataFrame:
    """The cross-tab as a Spark DataFrame: odd axes are columns of their own, each member of the
    even axes gives a column ``<member>[|<member>]_<measure>``. The view runs once: its cells are
    written down, and their heads and places read from there."""
    measures = list(view.used_measures())
    axes = view.ordered_axes()
    cells = compile_view(view, keys=True)
    if not axes:
        return cells
    spark, path = view.cube.source.spark, scratch_path(view.cube.source.spark, "cells")
    cells.write.parquet(path)
    cells = spark.read.schema(cells.schema).parquet(path)
    names = [axis_name(s, view.cube) for s in axes]
    across, down = names[::2], names[1::2]
    heads = cells.select(*[x for n in across for x in (n, f"{n}_key")]).distinct().limit(MOST_COLUMNS + 1).toPandas()
    if len(heads) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns; use the long form")
    titles, orders = {}, {}
    for s, n in zip(axes[::2], across, strict=True):
        pairs = list(dict.fromkeys(zip(heads[f"{n}_key"], heads[n], strict=True)))
        titles[n], orders[n] = dict(pairs), [k for k, _ in _order(s, pairs)]
        if len(set(titles[n].values())) < len(pairs):
            titles[n] = _paths(view, s, list(titles[n]))
    place = {n: {k: i for i, k in enumerate(orders[n])} for n in across}
    combos = sorted(heads[[f"{n}_key" for n in across]].itertuples(index=False, name=None), key=lambda c: [place[n][k] for n, k in zip(across, c, strict=True)])
    sums = [F.first(F.when(_same(across, c), F.col(m)), ignorenulls=True).alias("|".join(str(titles[n][k]) for n, k in zip(across, c, strict=True)) + f"_{m}") for c in combos for m in measures]
    by = [x for n in down for x in (n, f"{n}_key")]
    out = cells.groupBy(*by).agg(*sums) if by else cells.agg(*sums)
    return out.drop(*[f"{n}_key" for n in down])


def _same(names: list[str], keys: tuple) -> Any:
    out = F.lit(True)
    for n, k in zip(names, keys, strict=True):
        out = out & F.col(f"{n}_key").eqNullSafe(F.lit(k))
    return out


def ordered(view: View) -> DataFrame:
    """Cells in the order that the members were asked for: axis by axis, listed members by their
    place, others by key."""
    cells = compile_view(view, keys=True)
    by = []
    for s in view.ordered_axes():
        n = axis_name(s, view.cube)
        if s.listed is not None:
            by.append(F.array_position(F.array(*[F.lit(m.value) for m in s.listed]), F.col(n)))
        by.append(F.col(f"{n}_key"))
    return cells.orderBy(*by).drop(*[f"{axis_name(s, view.cube)}_key" for s in view.ordered_axes()])
