"""Things that several operators of this subpackage share: the cluster's shared folder, shipping
of the package to the executors, and Arrow plumbing for vectorised per-batch code."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a temporary folder is made and set, on one machine only (tests);
    a cluster must name one.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not on_one_machine(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))
        named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop FileSystem, Hadoop Path) of ``path``; works for every store that Spark can reach."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and a lost
    executor costs a read instead of a recomputation. Shuffle files go when the write has ended."""
    path = scratch(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What is written within leaves no shuffle files on the executors' disks."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(*written: DataFrame) -> None:
    """Delete what ``materialise`` has written, once nothing reads it any more."""
    for df in written:
        for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
            fs, p = filesystem(df.sparkSession, folder)
            fs.delete(p, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors. Those on the driver's machine that got its folder
    or path have it; all others are sent it, whatever the driver's own path is."""
    there = {os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x}
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or on_one_machine(spark) and (str(ROOT) in there or os.path.abspath(os.getcwd()) == str(ROOT)):
        return
    import zipfile

    out = Path(tempfile.mkdtemp()) / "latticework.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (ROOT / "latticework").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, kind: str | T.DataType) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind, True)


def own_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | list]], schema: T.StructType, *, limit: int = 4 << 20, text: str | None = "text") -> DataFrame:
    """``mapInArrow`` in which ``fn`` gets record batches of about ``limit`` bytes of column
    ``text`` (one row at least) and yields lists of Arrow arrays in the order of ``schema``."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        try:
            for out in fn(cut(batches, text, limit)):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)) for x, f in zip(out, target, strict=True)], schema=target)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows here hold whole texts, so what goes to a Python worker at a time is bounded by bytes (one
    row at least) and not by rows alone; a bound that the session has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # as Spark has it
        spark.conf.set(key, str(size))


def give_back() -> None:
    """Return a worker's free memory to the system at the end of a task; the worker lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def cut(batches: Iterator[pa.RecordBatch], text: str | None, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``limit`` bytes of column ``text``; every row stays whole."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if text is None or b.num_rows < 2:
            if b.num_rows:
                yield b
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes + 64)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def smallest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest ``by``, a 64-bit hash. A threshold from the row count keeps
    all but about 2 n rows out, so tasks don't each send n candidates to the driver."""
    total = df.count()
    share = min(1.0, 2 * (n + 50) / max(total, 1))
    while share < 1:
        few = df.filter(F.col(by) < F.lit(int(-(1 << 63) + share * (1 << 64))))
        if few.select(by).limit(n).count() == n:
            return few.orderBy(by).limit(n)
        share = min(1.0, share * 2)
    return df.orderBy(by).limit(n)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings, null as the empty string."""
    return [x if x is not None else "" for x in column(batch, name).to_pylist()]


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Path of a public vocabulary file: in ``folder`` if given, else in the installed package."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)
