"""Where a cube's tables come from: a name becomes a DataFrame of one session."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ForeignKey

def rtrimmed(df: DataFrame) -> DataFrame:
    """String columns without trailing blanks, as fixed-width columns of databases compare."""
    return df.select(*[F.rtrim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


class TableSource:
    """Base of all sources; tables are lazy and read once a session."""

    def __init__(self, spark: SparkSession, *, trim: bool = False) -> None:
        self.spark, self.trim = spark, trim
        self._seen: dict[str, DataFrame] = {}

    def names(self) -> list[str]:
        raise NotImplementedError

    def _load(self, name: str) -> DataFrame:
        raise NotImplementedError

    def table(self, name: str) -> DataFrame:
        if name not in self._seen:
            df = self._load(name)
            self._seen[name] = rtrimmed(df) if self.trim else df
        return self._seen[name]

    def count(self, name: str) -> int:
        """Rows of a table; Parquet answers from its footers."""
        return self._load(name).count()


class FrameSource(TableSource):
    """DataFrames by name: derived tables, test data."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame], **how) -> None:
        super().__init__(spark, **how)
        self.frames = dict(frames)

    def names(self) -> list[str]:
        return sorted(self.frames)

    def _load(self, name: str) -> DataFrame:
        return self.frames[name]


class FileSource(TableSource):
    """A folder with one file or folder a table, on any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, *, format: str = "parquet", suffix: str | None = None, options: Mapping[str, str] | None = None, schemas: Mapping[str, str | T.StructType] | None = None, trim: bool = False) -> None:
        super().__init__(spark, trim=trim)
        self.path, self.format = path.rstrip("/"), format
        self.suffix = f".{format}" if suffix is None else suffix
        self.options, self.schemas = dict(options or {}), dict(schemas or {})

    def names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(n.removesuffix(self.suffix) for n in found if n.endswith(self.suffix) and not n.startswith((".", "_")))

    def exists(self, name: str) -> bool:
        """Whether the folder has a file or folder of this full name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _load(self, name: str) -> DataFrame:
        reader = self.spark.read.format(self.format).options(**self.options)
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.load(f"{self.path}/{name}{self.suffix}")


def parquet(spark: SparkSession, path: str, **how) -> FileSource:
    return FileSource(spark, path, **how)


def delimited(spark: SparkSession, path: str, schemas: Mapping[str, str | T.StructType], *, sep: str = "|", suffix: str = ".tbl", **how) -> FileSource:
    """Delimited text with declared schemas, as benchmark generators write it."""
    return FileSource(spark, path, format="csv", suffix=suffix, options={"sep": sep}, schemas=schemas, **how)


class CatalogSource(TableSource):
    """Tables of a database of the session's catalog."""

    def __init__(self, spark: SparkSession, database: str | None = None, **how) -> None:
        super().__init__(spark, **how)
        self.database = database or spark.catalog.currentDatabase()

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database))

    def _load(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{name}`")


class JdbcSource(TableSource):
    """Tables of a relational database: those named, or all base tables of its catalog (in
    ``schema``, if given). ``splits`` names (column, lower, upper, parts) for tables that are read in
    parallel. Keys are those that the catalog declares."""

    def __init__(self, spark: SparkSession, url: str, tables: list[str] | None = None, *, schema: str | None = None, properties: Mapping[str, str] | None = None, splits: Mapping[str, tuple[str, int, int, int]] | None = None, trim: bool = True) -> None:
        super().__init__(spark, trim=trim)
        self.url, self.schema, self.properties, self.splits = url, schema, dict(properties or {}), dict(splits or {})
        self.tables = None if tables is None else list(tables)

    def _catalog(self, ask: Callable, columns: list[str]) -> list[tuple]:
        """Rows that the driver's metadata gives to ``ask(metadata)``."""
        jvm = self.spark._jvm
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            found, rows = ask(connection.getMetaData()), []
            while found.next():
                rows.append(tuple(found.getString(c) for c in columns))
            return rows
        finally:
            connection.close()

    def names(self) -> list[str]:
        if self.tables is None:
            kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 1)
            kinds[0] = "TABLE"
            rows = self._catalog(lambda m: m.getTables(None, self.schema, "%", kinds), ["TABLE_NAME", "TABLE_SCHEM"])
            self.tables = [n for n, schema in rows if schema not in ("pg_catalog", "information_schema")]
        return sorted(self.tables)

    def primary_key(self, table: str) -> list[str]:
        rows = self._catalog(lambda m: m.getPrimaryKeys(None, self.schema, table), ["KEY_SEQ", "COLUMN_NAME"])
        return [c for _, c in sorted(rows, key=lambda r: int(r[0]))]

    def keys(self) -> list[ForeignKey]:
        """Foreign keys of one column, table by table."""
        out = []
        for t in self.names():
            rows = self._catalog(lambda m, t=t: m.getImportedKeys(None, self.schema, t), ["FK_NAME", "FKCOLUMN_NAME", "PKTABLE_NAME", "PKCOLUMN_NAME"])
            alone = Counter(r[0] for r in rows)
            out += [ForeignKey(t, c, to, key) for name, c, to, key in rows if alone[name] == 1]
        return out

    def _load(self, name: str) -> DataFrame:
        if name in self.splits:
            column, lower, upper, parts = self.splits[name]
            return self.spark.read.jdbc(self.url, name, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=self.properties)
        return self.spark.read.jdbc(self.url, name, properties=self.properties)


def postgres(spark: SparkSession, dbname: str, user: str, password: str, host: str, port: int | str, tables: list[str] | None = None, **how) -> JdbcSource:
    """A PostgreSQL database by its connection record."""
    return JdbcSource(spark, f"jdbc:postgresql://{host}:{port}/{dbname}", tables, properties={"user": user, "password": password, "driver": "org.postgresql.Driver"}, **how)
