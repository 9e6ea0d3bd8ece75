"""From a view to one lazy DataFrame: fact, one join chain a role, filter, one aggregation."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import AGGREGATES, Compare, MeasureRef, Numeric, Predicate, Test, conjuncts
from ..model import Dimension, Level, ModelError

if TYPE_CHECKING:
    from ..operators.members import MemberSet
    from ..operators.view import View
    from ..session import Cube

Ref = tuple[str | None, str | None, str]


def _year(y: int) -> tuple[datetime, datetime]:
    return datetime(y, 1, 1), datetime(y + 1, 1, 1)


def _month(ym: int) -> tuple[datetime, datetime]:
    y, m = divmod(ym, 100)
    return datetime(y, m, 1), datetime(y + m // 12, m % 12 + 1, 1)


#: The time from and before which a calendar column has a value.
SPANS = {"year": _year, "year_month": _month}


def column_name(dimension: str, level: str, column: str) -> str:
    return f"{dimension}__{level}__{column}"


def needed(cube: Cube, refs: Iterable[Ref]) -> tuple[dict[str, dict[str, dict[str, None]]], dict[str, None]]:
    """Columns by dimension and level, and fact columns."""
    by: dict[str, dict[str, dict[str, None]]] = {}
    fact: dict[str, None] = {}
    for dimension, level, column in refs:
        if dimension is None:
            fact[column] = None
        else:
            by.setdefault(dimension, {}).setdefault(level, {})[column] = None
    return by, fact


def role_frame(cube: Cube, d: Dimension, columns: dict[str, dict[str, None]], *, full: bool, start: int = 0) -> tuple[DataFrame, str]:
    """One flat frame of a role from level ``start`` up, and the name of the column that the fact's
    (or lower level's) foreign key meets. Only what is needed is selected, and only levels up to
    the highest needed one are joined, or all of them if ``full``."""
    top = max([d.index(x) for x in columns], default=start)
    if full:
        top = len(d.levels) - 1
    frame, link = None, ""
    anchor = start
    while d.levels[anchor].table is None:  # columns that stand in a lower level's table
        anchor -= 1
    i = anchor
    while i <= top:
        base = d.levels[i]
        group: list[Level] = [base]
        while i + len(group) < len(d.levels) and d.levels[i + len(group)].table is None:
            group.append(d.levels[i + len(group)])
        table = cube.source.table(base.table)
        key = column_name(d.name, base.name, "_key")
        picked = [F.col(base.key).alias(key)]
        for lv in group:
            picked += [F.col(c).alias(column_name(d.name, lv.name, c)) for c in columns.get(lv.name, {})]
        up = i + len(group)
        if up <= top and group[-1].parent_fk:
            picked.append(F.col(group[-1].parent_fk).alias(column_name(d.name, base.name, "_up")))
        part = table.select(*picked)
        if frame is None:
            frame, link = part, key
        else:
            frame = frame.join(part, F.col(below) == F.col(key), "inner").drop(below, key)
        below = column_name(d.name, base.name, "_up")
        i = up
    return frame, link


def fits_broadcast(cube: Cube, d: Dimension) -> bool:
    """Whether a role's lowest table, as Spark estimates it, is within the session's broadcast
    threshold. A chain of N:1 joins upward has no more rows than that table, which the optimizer's
    product estimate for joins doesn't know; larger roles are left to its own choice."""
    table = cube.source.table(d.levels[0].table)
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return limit > 0 and int(str(size)) <= limit


def derived_columns(d: Dimension, level: str, column: str) -> Column:
    """A column of a level that is computed from the fact's own column."""
    made = dict(d.levels[d.index(level)].columns)
    if column not in made:
        raise ModelError(f"level {d.name}.{level} doesn't derive {column!r}")
    return F.expr(made[column].format(fk=f"`{d.fact_fk}`")) if isinstance(made[column], str) else made[column]


def spans(cube: Cube, predicate: Predicate | None) -> list[tuple[str, datetime, datetime]]:
    """(fact column, from, before) of the times that a predicate's conjuncts on calendar levels leave:
    no more than what the predicate says, in a form that reaches the scan's statistics."""
    out = []
    for p in conjuncts(predicate):
        if isinstance(p, Compare) and isinstance(p.right, int) and not isinstance(p.right, bool):
            a, op, values = p.left, p.op, [p.right]
        elif isinstance(p, Test) and p.values and all(type(v) is int for v in p.values):
            a, op, values = p.operand, "==", p.values
        else:
            continue
        if not hasattr(a, "dimension") or not (d := cube.model.dimension(a.dimension)).derived:
            continue
        kind = dict(d.levels[d.index(a.level)].spans).get(a.name)
        if kind is None or op == "!=":
            continue
        try:
            begins, ends = zip(*(SPANS[kind](v) for v in values))
        except ValueError:  # no such month or year
            continue
        low = {"==": min(begins), ">=": min(begins), ">": max(ends)}.get(op, datetime.min)
        high = {"==": max(ends), "<=": max(ends), "<": min(begins)}.get(op, datetime.max)
        out.append((d.fact_fk, low, high))
    return out


def within(fact: DataFrame, times: list[tuple[str, datetime, datetime]]) -> DataFrame:
    """The fact's rows in all spans; literals have the column's own type, so nothing is cast."""
    kinds = {"timestamp_ntz": "TIMESTAMP_NTZ", "timestamp": "TIMESTAMP", "date": "DATE"}
    for column, low, high in times:
        if kind := kinds.get(dict(fact.dtypes).get(column, "")):
            text = lambda t: F.expr(f"{kind} '{t:%Y-%m-%d}'")  # noqa: B023, E731
            if low > datetime.min:
                fact = fact.filter(F.col(column) >= text(low))
            if high < datetime.max:
                fact = fact.filter(F.col(column) < text(high))
    return fact


def joined(cube: Cube, refs: list[Ref], first: Iterable[str], times: list[tuple[str, datetime, datetime]] = ()) -> DataFrame:
    """The fact with all needed columns, named by ``column_name``; fact columns keep theirs. Roles
    in ``first`` (those that filter) are joined before the others; a role whose columns are written
    with the fact isn't joined. ``times`` prune the fact's scan."""
    model = cube.model
    by, fact_columns = needed(cube, refs)
    written = getattr(cube.source, "columns", set())
    there = [column_name(n, lv, c) for n, levels in by.items() for lv, cs in levels.items() for c in cs if column_name(n, lv, c) in written]
    by = {n: left for n, levels in by.items() if (left := {lv: more for lv, cs in levels.items() if (more := {c: None for c in cs if column_name(n, lv, c) not in written})})}
    stored = [model.dimension(n) for n in by if not model.dimension(n).derived]
    made = [derived_columns(model.dimension(n), lv, c).alias(column_name(n, lv, c)) for n, levels in by.items() if model.dimension(n).derived for lv, cs in levels.items() for c in cs]
    links = {d.name: f"{d.name}__fk" for d in stored}
    plain = {*fact_columns, *(model.dimension(n).fact_fk for n in by), *(c for c, _, _ in times)}
    # a source whose fact is itself a join may know that less of it will do
    fact = cube.source.fact_for(plain) if hasattr(cube.source, "fact_for") else cube.source.table(model.fact)
    out = within(fact, times).select(*[F.col(c) for c in fact_columns], *there, *[F.col(d.fact_fk).alias(links[d.name]) for d in stored], *made)
    order = list(dict.fromkeys([*[n for n in first if n in links], *links]))
    for name in order:
        d = model.dimension(name)
        frame, key = role_frame(cube, d, by[name], full=model.hierarchy_join == "full")
        if model.hierarchy_join == "needed" and list(by[name]) == [d.levels[0].name] and list(by[name][d.levels[0].name]) == [d.levels[0].key]:
            # the key stands in the fact
            out = out.withColumn(column_name(name, d.levels[0].name, d.levels[0].key), F.col(links[name])).drop(links[name])
            continue
        if fits_broadcast(cube, d):
            frame = F.broadcast(frame)
        out = out.join(frame, F.col(links[name]) == F.col(key), "inner").drop(links[name], key)
    return out


def resolve(dimension: str | None, level: str | None, column: str) -> Column:
    return F.col(column) if dimension is None else F.col(column_name(dimension, level, column))


def aggregate(m: Numeric) -> Column:
    return AGGREGATES[m.agg](m.column(resolve))


def axis_name(s: MemberSet, cube: Cube) -> str:
    a = s.attribute
    label = cube.model.dimension(a.dimension).levels[cube.model.dimension(a.dimension).index(a.level)].label
    return f"{a.dimension}_{a.level}" if a.name == label else f"{a.dimension}_{a.level}_{a.name}"


def key_ref(s: MemberSet, cube: Cube) -> Ref:
    d = cube.model.dimension(s.attribute.dimension)
    return d.name, s.attribute.level, d.levels[d.index(s.attribute.level)].key


def compile_view(view: View, *, keys: bool = False, grouping: str | None = None) -> DataFrame:
    """Group by each axis's level key and label, so equal labels under other parents stay apart."""
    cube, axes, measures = view.cube, view.ordered_axes(), view.used_measures()
    if not axes and not measures:
        raise ModelError("a view needs an axis or a measure")
    refs: list[Ref] = []
    filters: list[Ref] = []
    for s in axes:
        d = cube.model.dimension(s.attribute.dimension)
        d.level(s.attribute.level)  # must be visible
        refs += [*s.attribute.refs(), key_ref(s, cube)]
        filters += [] if s.is_all else list(s.refs())
    if view.predicate is not None:
        filters += list(view.predicate.refs())
    for m in measures.values():
        refs += list(m.refs())
    if not any(r[0] is None for r in [*refs, *filters]) and not axes:
        raise ModelError("a measure must use a column of the fact")
    times = spans(cube, view.predicate) + [t for s in axes for t in spans(cube, s.as_test())]
    rows = joined(cube, [*refs, *filters], [r[0] for r in filters if r[0]], times)
    for s in axes:
        if (condition := s.condition(resolve)) is not None:
            rows = rows.filter(condition)
    if view.predicate is not None:
        rows = rows.filter(view.predicate.column(resolve))
    labels = [(axis_name(s, cube), resolve(*next(iter(s.attribute.refs()))), resolve(*key_ref(s, cube))) for s in axes]
    names = [n for n, _, _ in labels]
    if clash := {n for n in names if n in measures}:
        raise ModelError(f"measures are named like axes: {sorted(clash)}")
    aggregates = [aggregate(m).alias(n) for n, m in measures.items()]
    grouped = [x for n, label, key in labels for x in (label.alias(n), key.alias(f"{n}_key"))]
    if grouping:
        if not measures or not axes:
            raise ModelError("subtotals need axes and measures")
        flat = rows.select(*grouped, *[F.col(c) for c in dict.fromkeys(r[2] for r in refs if r[0] is None)])
        flat = flat.select("*", *[F.struct(n, f"{n}_key").alias(f"{n}__member") for n in names])
        members = [f"{n}__member" for n in names]
        out = getattr(flat, grouping)(*members).agg(F.grouping_id().alias("level_of"), *aggregates)
        out = out.select(*[F.col(f"{n}__member.{n}").alias(n) for n in names], *[F.col(f"{n}__member.{n}_key").alias(f"{n}_key") for n in names if keys], "level_of", *measures)
    elif axes:
        # a level whose label is its key is grouped by one column
        one = {n for n, s in zip(names, axes, strict=True) if next(iter(s.attribute.refs())) == key_ref(s, cube)}
        grouped = [x for n, label, key in labels for x in ((label.alias(n),) if n in one else (label.alias(n), key.alias(f"{n}_key")))]
        out = rows.groupBy(*grouped).agg(*aggregates) if aggregates else rows.select(*grouped).distinct()
        both = lambda n: [F.col(n), F.col(n).alias(f"{n}_key") if n in one else F.col(f"{n}_key")]
        out = out.select(*[x for n in names for x in (both(n) if keys else [F.col(n)])], *measures)
    else:
        out = rows.agg(*aggregates)
    if view.having_ is not None:
        by_column = {m.fact_column: n for n, m in measures.items() if isinstance(m, MeasureRef)}
        out = out.filter(view.having_.column(lambda d, lv, c: F.col(by_column.get(c, c)) if d is None else F.col(f"{d}_{lv}")))
    if view.top:
        n, by_ = view.top
        out = out.orderBy(*[F.col(c).desc() if down else F.col(c).asc() for c, down in by_], *[F.col(x) for x in names]).limit(n)
    return out


def share_of(view: View, measure: str, of: str) -> DataFrame:
    """The window runs over aggregated cells."""
    cells = view.to_df()
    total = F.sum(measure).over(W.partitionBy(of))
    return cells.withColumn("share", F.try_divide(F.col(measure), total))


def level_frame(cube: Cube, dimension: str, level: str, columns: list[str]) -> DataFrame:
    """``key`` and ``member`` (the first of ``columns``) of a level's rows."""
    d = cube.model.dimension(dimension)
    lv = d.level(level)
    i = d.index(level)
    if d.derived:
        rows = cube.source.table(cube.model.fact).select(derived_columns(d, level, lv.key).alias("key"), derived_columns(d, level, columns[0]).alias("member"))
        return rows.distinct()
    if lv.table is None:
        while d.levels[i].table is None:
            i -= 1
        return cube.source.table(d.levels[i].table).select(F.col(lv.key).alias("key"), F.col(columns[0]).alias("member")).distinct()
    return cube.source.table(lv.table).select(F.col(lv.key).alias("key"), F.col(columns[0]).alias("member"))


def members_frame(s: MemberSet) -> DataFrame:
    """``key, member`` of the rows that a set means; ancestors come by joins up the hierarchy."""
    a = s.attribute
    cube = a.cube
    d = cube.model.dimension(a.dimension)
    condition = s.condition(resolve)
    if condition is None:
        return level_frame(cube, a.dimension, a.level, [a.name])
    by, _ = needed(cube, [*s.refs(), key_ref(s, cube)])
    key = F.col(column_name(*key_ref(s, cube))).alias("key")
    member = F.col(column_name(a.dimension, a.level, a.name)).alias("member")
    if d.derived:
        fact = cube.source.table(cube.model.fact)
        rows = fact.select(*[derived_columns(d, lv, c).alias(column_name(d.name, lv, c)) for lv, cs in by[d.name].items() for c in cs]).distinct()
    else:
        rows, _ = role_frame(cube, d, by[d.name], full=False, start=d.index(a.level))
    out = rows.filter(condition).select(key, member)
    return out.distinct() if d.levels[d.index(a.level)].table is None else out


def children_count(cube: Cube, dimension: str, level: str) -> DataFrame:
    """``key, member, n_children``: how many members of the level below each one has."""
    d = cube.model.dimension(dimension)
    child = d.child(level)
    if child is None:
        raise ModelError(f"{dimension}.{level} is the lowest level")
    label, key, below = d.level(level).label, d.level(level).key, d.level(child).key
    by = {level: {key: None, label: None}, child: {below: None}}
    if d.derived:
        fact = cube.source.table(cube.model.fact)
        rows = fact.select(*[derived_columns(d, lv, c).alias(column_name(dimension, lv, c)) for lv, cs in by.items() for c in cs])
    else:
        rows, _ = role_frame(cube, d, by, full=False, start=d.index(child))
    pick = lambda lv, c, to: F.col(column_name(dimension, lv, c)).alias(to)
    return rows.select(pick(level, key, "key"), pick(level, label, "member"), pick(child, below, "child")).groupBy("key", "member").agg(F.count_distinct("child").alias("n_children"))
