"""From tables to a model: which one is the fact, what refers to what, and how levels stack."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import CubeModel, Dimension, ForeignKey, Level, ModelError, StoredMeasure
from ..sources.tables import TableSource


def edit_distance(a: str, b: str) -> int:
    """Fewest insertions, deletions and replacements of letters from ``a`` to ``b``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def table_counts(source: TableSource, tables: Iterable[str] | None = None) -> dict[str, int]:
    return {t: source.count(t) for t in (tables or source.names())}


def fact_table(counts: Mapping[str, int]) -> str:
    """The table with most rows; of equals the first by name."""
    if not counts:
        raise ModelError("the source has no tables")
    return min(counts, key=lambda t: (-counts[t], t))


def stem(column: str) -> str:
    """A column's name without its table's prefix and without ``_id`` or ``key`` at the end."""
    name = column.lower()
    for end in ("_id", "_key", "key", "id"):
        if name.endswith(end) and len(name) > len(end):
            name = name[: -len(end)].rstrip("_")
            break
    head, _, tail = name.partition("_")
    return tail if tail and len(head) <= 2 else name


def candidate_keys(source: TableSource, tables: Iterable[str]) -> list[ForeignKey]:
    """Foreign keys by name: a column refers to the table whose first column has its name, or its
    stem where the stems are alike."""
    schemas = {t: source.table(t).schema for t in tables}
    firsts = {t: s[0].name for t, s in schemas.items() if len(s)}
    out = []
    for t, s in schemas.items():
        for f in s:
            if f.name == firsts[t] and t in firsts and len([1 for x in firsts.values() if x == f.name]) == 1:
                continue  # its own key
            for other, key in firsts.items():
                if other != t and (f.name == key or (stem(f.name) == stem(key) and len(stem(key)) > 1)) and isinstance(f.dataType, type(source.table(other).schema[0].dataType)):
                    out.append(ForeignKey(t, f.name, other, key))
    return out


def verified(source: TableSource, keys: Iterable[ForeignKey]) -> list[ForeignKey]:
    """Keys that hold: the target is unique and every value that isn't null has a target."""
    out = []
    unique: dict[tuple[str, str], bool] = {}
    for k in keys:
        target = (k.to_table, k.to_column)
        if target not in unique:
            row = source.table(k.to_table).agg(F.count(k.to_column).alias("n"), F.count_distinct(k.to_column).alias("d")).first()
            unique[target] = row.n == row.d
        if not unique[target]:
            continue
        from_ = source.table(k.table).select(F.col(k.column).alias("v")).filter("v IS NOT NULL").distinct()
        if not from_.join(source.table(k.to_table).select(F.col(k.to_column).alias("w")), F.col("v") == F.col("w"), "left_anti").take(1):
            out.append(k)
    return out


def label_of(columns: list[str], table: str) -> str:
    """The column named most like its table; of equals the first."""
    if not columns:
        raise ModelError(f"level table {table!r} has no column besides its keys")
    return min(columns, key=lambda c: edit_distance(c.lower(), table.lower()))


def hierarchy(source: TableSource, table: str, key: str, keys: list[ForeignKey], labels: Mapping[str, str]) -> tuple[Level, ...]:
    """Levels from ``table`` up its chain of foreign keys."""
    levels: list[Level] = []
    while True:
        up = [k for k in keys if k.table == table]
        if len(up) > 1:
            raise ModelError(f"level table {table!r} refers to several tables, {[k.to_table for k in up]}; hierarchies are linear")
        names = [f.name for f in source.table(table).schema]
        plain = [c for c in names if c != key and (not up or c != up[0].column)]
        label = labels.get(table) or label_of(plain, table)
        if label not in plain:
            raise ModelError(f"level table {table!r} has no label column {label!r}")
        levels.append(Level(table, key, label, tuple(c for c in plain if c != label), table, up[0].column if up else None))
        if not up:
            return tuple(levels)
        if up[0].to_table in {x.name for x in levels}:
            raise ModelError(f"the levels above {levels[0].name!r} form a circle")
        table, key = up[0].to_table, up[0].to_column


def role_names(tables: list[str]) -> list[str]:
    """A table that plays several roles: the last one keeps its name, earlier ones get a number."""
    total, seen, out = Counter(tables), Counter(), []
    for t in tables:
        seen[t] += 1
        out.append(t if seen[t] == total[t] else f"{t}{seen[t]}")
    return out


def infer_model(
    source: TableSource,
    *,
    name: str = "cube",
    tables: Iterable[str] | None = None,
    keys: Iterable[ForeignKey] | None = None,
    fact: str | None = None,
    labels: Mapping[str, str] | None = None,
    roles: Mapping[str, str] | None = None,
    exclude: Iterable[str] = (),
    hierarchy_join: str | None = None,
) -> CubeModel:
    """The cube of a source.

    ``keys`` are foreign keys that are known; without them those of the source's catalog, and where it
    declares none, they are found by name and checked against the data. ``fact``, ``labels`` (column by table), ``roles`` (dimension name by the fact's
    column) and ``exclude`` (numeric fact columns that are no measures) overrule what is inferred.
    """
    names = list(tables or source.names())
    fact = fact or fact_table(table_counts(source, names))
    if fact not in names:
        raise ModelError(f"no table {fact!r}")
    if keys is None and hasattr(source, "keys"):
        keys = [k for k in source.keys() if k.table in names and k.to_table in names] or None
    known = list(keys) if keys is not None else verified(source, candidate_keys(source, names))
    schema = source.table(fact).schema
    place = {f.name: i for i, f in enumerate(schema)}
    links = sorted((k for k in known if k.table == fact), key=lambda k: place[k.column])
    if not links:
        raise ModelError(f"fact table {fact!r} refers to no other table")
    titles = role_names([k.to_table for k in links])
    dims = tuple(Dimension((roles or {}).get(k.column, t), k.column, hierarchy(source, k.to_table, k.to_column, known, labels or {})) for k, t in zip(links, titles, strict=True))
    if len({d.name for d in dims}) < len(dims):
        raise ModelError(f"several dimensions are named alike: {[d.name for d in dims]}")
    in_keys = {k.column for k in known if k.table == fact} | {k.to_column for k in known if k.to_table == fact} | set(exclude)
    measures = tuple(StoredMeasure(f.name, f.name) for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in in_keys)
    return CubeModel(name, fact, dims, measures, hierarchy_join or "full")
