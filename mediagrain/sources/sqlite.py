"""A relational source: tables of a SQLite file, read in ranges of an integer key by as many tasks, with filters pushed down.

    spark.dataSource.register(SqliteSource)
    spark.read.format("mediagrain_sqlite").option("path", "/shared/music.db").option("table", "tracks").option("key", "id").load()

The file must be readable under its path by every executor. Filters that SQL can judge alike (comparisons, in,
null tests on columns of the table) run in SQLite; a row comes from exactly one range, rows with a null key from
the first.
"""

import sqlite3
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Column types of SQLite and of Spark.
TYPES = {"INTEGER": "bigint", "TEXT": "string", "REAL": "double", "BLOB": "binary"}
ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class KeyRange(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, key: str, parts: int, batch: int, schema: StructType):
        self.path, self.table, self.key, self.parts, self.batch, self.fields = path, table, key, parts, batch, schema.fields
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        names = {f.name: f.dataType.simpleString() for f in self.fields}
        for f in filters:
            path = getattr(f, "attribute", ())
            column = path[0] if len(path) == 1 and path[0] in names else None
            if column is None or names[column] == "binary":
                yield f
            elif type(f) in COMPARED and isinstance(f.value, (int, float, str)):
                self.where.append((f"{quoted(column)} {COMPARED[type(f)]} ?", [f.value]))
            elif isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value) and len(f.value) <= 500:
                self.where.append((f"{quoted(column)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{quoted(column)} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            else:
                yield f

    def partitions(self) -> list[KeyRange]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min({quoted(self.key)}), max({quoted(self.key)}) FROM {quoted(self.table)}").fetchone()
        if low is None or self.parts == 1:
            return [KeyRange(None, None)]
        cuts = sorted({low + (high - low + 1) * k // self.parts for k in range(1, self.parts)} - {low})
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        where, values = [w for w, _ in self.where], [v for _, vs in self.where for v in vs]
        key = quoted(self.key)
        if part.low is not None:
            where, values = [*where, f"{key} >= ?"], [*values, part.low]
        if part.high is not None:
            where, values = [*where, f"({key} < ?{' OR ' + key + ' IS NULL' if part.low is None else ''})"], [*values, part.high]
        sql = f"SELECT {', '.join(quoted(f.name) for f in self.fields)} FROM {quoted(self.table)}{' WHERE ' + ' AND '.join(where) if where else ''}"
        kinds = [ARROW[f.dataType.simpleString()] for f in self.fields]
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            found = db.execute(sql, values)
            while rows := found.fetchmany(self.batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.name for f in self.fields])
        finally:
            db.close()


class SqliteSource(DataSource):
    """Options: path, table, key (an integer column; rowid if not given), parts (4), batch (10 000 rows)."""

    @classmethod
    def name(cls) -> str:
        return "mediagrain_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {TYPES.get(kind.upper(), 'string')}" for _, name, kind, *_ in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        o = self.options
        return SqliteReader(o["path"], o["table"], o.get("key", "rowid"), int(o.get("parts", 4)), int(o.get("batch", 10_000)), schema)


def read_sqlite(spark, path: str, table: str, key: str, parts: int = 4):
    """A table of a SQLite file."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format(SqliteSource.name()).options(path=path, table=table, key=key, parts=parts).load()
