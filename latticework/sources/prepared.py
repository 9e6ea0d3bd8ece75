"""A cube's fact written once with its dimensions' columns, so that queries scan and don't join."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ModelError
from .tables import TableSource

if TYPE_CHECKING:
    from ..session import Cube


class PreparedSource(TableSource):
    """The tables of ``base``, with the written fact in place of its own. ``columns`` names what of
    the dimensions it holds."""

    def __init__(self, base: TableSource, fact: str, path: str, columns: set[str]) -> None:
        super().__init__(base.spark)
        self.base, self.fact, self.path, self.columns = base, fact, path, columns

    def names(self) -> list[str]:
        return self.base.names()

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path) if name == self.fact else self.base.table(name)

    def count(self, name: str) -> int:
        return self._load(name).count() if name == self.fact else self.base.count(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it, removed when the driver ends: in the
    session's checkpoint folder, else in the warehouse; on one machine a temporary folder will do."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        root = tempfile.gettempdir() if alone else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip(os.sep)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def prepare(cube: Cube, path: str, *, sort_by: str | None = None, rows: int | None = None) -> Cube:
    """Write the fact with all level columns above its dimensions' lowest tables to ``path`` as
    Parquet, in ranges of the fact column ``sort_by`` so that scans prune by it, and return the cube
    on it. Queries that use other columns of a lowest table still join that one.

    ``rows`` is how many the fact has, where that is known without its own joins. If fewer were
    written, some have keys without a target: then queries would depend on which dimensions they
    use, and the cube isn't prepared but ``ModelError`` raised."""
    from ..plans.planner import column_name, joined

    model = cube.model
    refs = []
    for d in model.dimensions:
        for lv in d.levels if d.derived else [x for i, x in enumerate(d.levels) if i]:
            refs += [(d.name, lv.name, c) for c in ((n for n, _ in lv.columns) if d.derived else lv.all_columns)]
    plain = dict.fromkeys([*(m.column for m in model.measures), *(d.fact_fk for d in model.dimensions)])
    out = joined(cube, [*refs, *((None, None, c) for c in plain)], [])
    if sort_by:
        out = out.repartitionByRange(F.col(sort_by)).sortWithinPartitions(sort_by)
    out.write.mode("overwrite").parquet(path)
    source = PreparedSource(cube.source, model.fact, path, {column_name(*r) for r in refs})
    expected = cube.source.count(model.fact) if rows is None else rows
    if (n := source.count(model.fact)) != expected:
        raise ModelError(f"{expected} facts but {n} of them with sound keys in all dimensions")
    return type(cube)(model, source)
