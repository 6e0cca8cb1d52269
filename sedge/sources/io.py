"""read() and write(): files by their suffix, tables, and objects in memory.

Files and databases are read by ranges, one in each task, and written as folders with a file from each
task; paths without a scheme are those of Spark's default file system. What tasks open
themselves (Arrow files, SQLite and DuckDB databases) must lie where all executors can reach it.
"""

from __future__ import annotations

import difflib
import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes as D
from ..errors import BackendError
from ..operators.frame import Frame


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests on one machine, a local folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise BackendError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sedge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(suffix: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(session())}/frame-{uuid.uuid4().hex}.{suffix}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/frame-{uuid.uuid4().hex}"
    kept = df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.NullType)])  # Parquet has no void
    kept.write.parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])


class Database:
    """The tables of a Spark catalog."""

    def __init__(self, spark: SparkSession | None = None):
        self._spark = spark or session()

    @property
    def tables(self) -> list[str]:
        return [t.name for t in self._spark.catalog.listTables()]

    def table(self, name: str) -> Frame:
        if not self._spark.catalog.tableExists(name):
            near = difflib.get_close_matches(name, self.tables, n=1)
            raise KeyError(f"no table {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return Frame(self._spark.table(name))

    def sql(self, query: str) -> Frame:
        return Frame(self._spark.sql(query))

    def __getattr__(self, name: str) -> Frame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def __dir__(self):
        return self.tables


#: Rows of an object in memory for each partition, so that small ones keep their order through files.
ROWS = 10_000


def _arrow(table) -> DataFrame:
    return session().createDataFrame(table).coalesce(max(1, table.num_rows // ROWS))


#: Rows of a database table that one task reads.
RANGE = 1 << 18


def _by_tasks(n: int, schema, batches) -> DataFrame:
    """The rows of n tasks in turn; batches(k) gives the k-th task's record batches, which are cast to the schema."""
    from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

    kinds = from_arrow_schema(schema, prefer_timestamp_ntz=True)
    want = to_arrow_schema(kinds)

    def run(tasks):
        for task in tasks:
            for k in task.column(0).to_pylist():
                for batch in batches(k):
                    yield from batch.cast(want).to_batches() if hasattr(batch, "to_batches") else [batch.cast(want)]

    return session().range(0, n, 1, max(1, n)).mapInArrow(run, kinds)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _opened(path: str, at: str):
    import pyarrow as pa

    source = _file_system(path)[0].open_input_file(at)
    head = source.read(6)
    source.seek(0)
    return pa.ipc.open_file(source) if head == b"ARROW1" else pa.ipc.open_stream(source)


def _read_ipc(path: str, table=None) -> DataFrame:
    """A task for each record batch of files, and for each stream."""
    from pyarrow import fs

    system, base = _file_system(path)
    files = [base]
    if system.get_file_info(base).type == fs.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(base)) if f.path.endswith((".arrow", ".feather", ".ipc")))
    tasks, schema = [], None
    for at in files:
        opened = _opened(path, at)
        schema = schema or opened.schema
        tasks += [(at, k) for k in range(opened.num_record_batches)] if hasattr(opened, "num_record_batches") else [(at, None)]
    if schema is None:
        raise FileNotFoundError(f"no Arrow files in {path!r}")

    def batches(k):
        at, number = tasks[k]
        opened = _opened(path, at)
        return opened if number is None else [opened.get_batch(number)]

    return _by_tasks(len(tasks), schema, batches)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _chosen(names: list[str], table: str | None) -> str:
    name = table or (names[0] if len(names) == 1 else None)
    if name not in names:
        raise KeyError(f"choose a table of {names}")
    return name


def _ranges(low: int | None, high: int | None) -> list[tuple[int, int]]:
    return [] if low is None else [(a, min(a + RANGE - 1, high)) for a in range(low, high + 1, RANGE)]


def _read_sqlite(path: str, table: str | None = None) -> DataFrame:
    """A task for each range of row ids; columns have the types that they are declared with."""
    import sqlite3

    import pyarrow as pa

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        name = _chosen([r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")], table)
        columns = [(r[1], r[2].upper()) for r in con.execute(f"PRAGMA table_info({_quoted(name)})")]
        try:
            ranges = _ranges(*con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(name)}").fetchone())
            where = " WHERE rowid BETWEEN ? AND ? ORDER BY rowid"
        except sqlite3.OperationalError:  # a table without row ids is one range
            ranges, where = [()], ""
    # the rules by which SQLite itself gives a declared type its affinity
    kind = lambda t: pa.int64() if "INT" in t else pa.string() if any(x in t for x in ("CHAR", "CLOB", "TEXT")) else pa.binary() if "BLOB" in t or not t else pa.float64()
    schema = pa.schema([(c, kind(t)) for c, t in columns])

    def batches(k):
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
            rows = con.execute(f"SELECT {', '.join(_quoted(c) for c, _ in columns)} FROM {_quoted(name)}{where}", ranges[k])
            while some := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)

    return _by_tasks(len(ranges), schema, batches)


def _arrow_from_pandas(pdf) -> DataFrame:
    import pyarrow as pa

    return _arrow(pa.Table.from_pandas(pdf, preserve_index=False))


def _duck_tables(con) -> list[str]:
    return [r[0] for r in con.execute("SELECT table_name FROM information_schema.tables ORDER BY 1").fetchall()]


def _read_duckdb(con, table: str | None) -> DataFrame:
    """The rows of a connection, which only the driver has."""
    name = _chosen(_duck_tables(con), table)
    warnings.warn("rows of a DuckDB connection pass through the driver; read the database file, or Parquet, for large tables", stacklevel=3)
    return _arrow(con.execute(f"SELECT * FROM {_quoted(name)}").to_arrow_table())


def _read_duckdb_file(path: str, table: str | None = None) -> DataFrame:
    """A task for each range of row ids; a view, which has none, is one range."""
    import duckdb

    with duckdb.connect(path, read_only=True) as con:
        name = _chosen(_duck_tables(con), table)
        schema = con.execute(f"SELECT * FROM {_quoted(name)} LIMIT 0").to_arrow_table().schema
        try:
            ranges = [f" WHERE rowid BETWEEN {a} AND {b}" for a, b in _ranges(*con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(name)}").fetchone())]
        except duckdb.BinderException:
            ranges = [""]
    warnings.warn("each task opens the DuckDB file: it must lie where all executors can reach it", stacklevel=3)

    def batches(k):
        with duckdb.connect(path, read_only=True, config={"threads": 1}) as con:
            yield con.execute(f"SELECT * FROM {_quoted(name)}{ranges[k]}").to_arrow_table()

    return _by_tasks(len(ranges), schema, batches)


def _csv(sep: str):
    return lambda path, table=None: session().read.csv(path, header=True, inferSchema=True, sep=sep)


def _no_excel(path: str, table=None):
    raise BackendError("reading and writing Excel files needs a library that isn't installed; save the sheet as csv")


READERS = {
    ".parquet": lambda path, table=None: session().read.parquet(path),
    ".pq": lambda path, table=None: session().read.parquet(path),
    ".csv": _csv(","), ".csv.gz": _csv(","), ".tsv": _csv("\t"), ".tsv.gz": _csv("\t"),
    ".jsonl": lambda path, table=None: session().read.json(path),
    ".ndjson": lambda path, table=None: session().read.json(path),
    ".json": lambda path, table=None: session().read.json(path, multiLine=True),
    ".arrow": _read_ipc, ".feather": _read_ipc, ".ipc": _read_ipc,
    ".sqlite": _read_sqlite, ".sqlite3": _read_sqlite,
    ".db": _read_duckdb_file, ".duckdb": _read_duckdb_file, ".ddb": _read_duckdb_file,
    ".xlsx": _no_excel,
}


def _match(path: str, formats: dict):
    bare = path.split("?")[0].rstrip("/").lower()
    found = [s for s in formats if bare.endswith(s)]
    if not found:
        raise ValueError(f"can't tell the format of {path!r}; known suffixes: {', '.join(sorted(formats))}")
    return formats[max(found, key=len)]


def register_format(suffix: str, reader=None, writer=None) -> None:
    """Make read() and write() know a further suffix: reader(path, table) -> DataFrame, writer(frame, path, table)."""
    if reader:
        READERS[suffix] = reader
    if writer:
        WRITERS[suffix] = lambda frame, path, table, single: writer(frame, path, table)


def _object(obj, table: str | None) -> DataFrame | None:
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    if isinstance(obj, DataFrame):
        return obj
    if isinstance(obj, SparkSession):
        return obj.table(table)
    if isinstance(obj, dict):
        return _arrow(pa.table(obj))
    if isinstance(obj, pd.DataFrame):
        return _arrow_from_pandas(obj)
    if isinstance(obj, pa.Table):
        return _arrow(obj)
    if type(obj).__module__.split(".")[0] in ("duckdb", "_duckdb"):
        return _read_duckdb(obj, table)
    if hasattr(obj, "to_arrow"):  # polars frames
        return _arrow(obj.to_arrow())
    if hasattr(obj, "keys") and table is not None:  # a dictionary of dataset splits
        if table not in obj.keys():
            raise KeyError(f"choose a split of {list(obj.keys())}")
        return _object(obj[table], None)
    if hasattr(obj, "data") and hasattr(getattr(obj, "data", None), "table"):  # datasets over Arrow
        return _arrow(obj.data.table)
    if hasattr(obj, "numpy"):  # tensors
        obj = obj.numpy()
    if hasattr(obj, "__array__"):
        a = np.asarray(obj)
        if a.ndim > 2:
            raise ValueError(f"an array of {a.ndim} dimensions isn't a table")
        return _arrow(pa.table({"value": a} if a.ndim == 1 else {f"column_{i}": a[:, i] for i in range(a.shape[1])}))
    return None


def read(source, table: str | None = None) -> Frame:
    """A frame of a file, a folder, a URL, a table or an object in memory."""
    if isinstance(source, (str, os.PathLike)):
        return Frame(_match(str(source), READERS)(str(source), table))
    df = _object(source, table)
    if df is None:
        raise TypeError(f"can't read a {type(source).__name__}")
    return Frame(df)


def from_schema(schema: dict[str, D.DType]) -> Frame:
    df = session().createDataFrame([], ", ".join(f"`{k}` {t.spark}" for k, t in schema.items()))
    return Frame(df, dict(schema), attached=False)


def read_sql(query: str, source=None) -> Frame:
    """The rows of a query: Spark's own, or that of a source, a DuckDB connection, which passes through the driver."""
    if source is None or isinstance(source, SparkSession):
        return Frame((source or session()).sql(query))
    return Frame(_arrow(source.execute(query).to_arrow_table()))


def read_table(name: str, source=None) -> Frame:
    return Frame(session().table(name)) if source is None else read(source, name)


def read_parquet(path: str) -> Frame:
    return Frame(READERS[".parquet"](path))


def read_csv(path: str) -> Frame:
    return Frame(READERS[".csv"](path))


def read_ipc(path: str) -> Frame:
    return Frame(_read_ipc(path))


def read_duckdb(path: str, table: str | None = None) -> Frame:
    return Frame(_read_duckdb_file(path, table))


def _one_file(df: DataFrame, kind: str, path: str, options: dict) -> None:
    """All rows through one task to one file, which then takes the path's place."""
    jvm = df.sparkSession._jvm
    part, end = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(path)
    system = end.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    try:
        df.coalesce(1).write.format(kind).options(**options).save(part.toString())
        (one,) = (f.getPath() for f in system.listStatus(part) if f.getPath().getName().startswith("part-"))
        system.delete(end, True)
        if not system.rename(one, end):
            raise BackendError(f"can't put the file at {path!r}")
    finally:
        system.delete(part, True)


def _spark_files(kind: str, **options):
    """A folder, written in parallel, or one file."""

    def put(frame: Frame, path: str, table: str | None, single: bool) -> None:
        df = frame.to_spark()
        if single:
            _one_file(df, kind, path, options)
        else:
            df.write.mode("overwrite").format(kind).options(**options).save(path)

    return put


def _write_json(frame: Frame, path: str, table: str | None, single: bool) -> None:
    """Each file is one JSON array."""

    def array(batches):
        import pyarrow as pa

        lines = ["["]
        for batch in batches:
            for row in batch.column(0).to_pylist():
                lines.append(row if lines == ["["] else "," + row)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
            lines = []
        yield pa.RecordBatch.from_arrays([pa.array([*lines, "]"], pa.string())], names=["value"])

    df = frame.to_spark()
    rows = df.select(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))
    texts = (rows.coalesce(1) if single else rows).mapInArrow(array, "value string")
    if single:
        _one_file(texts, "text", path, {})
    else:
        texts.write.mode("overwrite").text(path)


def _write_ipc(frame: Frame, path: str, table: str | None, single: bool) -> None:
    """A file from each task. A task writes under a name of its own first, so one that is run again leaves one file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    system, base = _file_system(path)
    df = frame.to_spark()
    schema, folder = to_arrow_schema(df.schema), f"{base}.{uuid.uuid4().hex}"
    system.create_dir(folder)

    def put(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        where, own = _file_system(path)[0], f"{folder}/{uuid.uuid4().hex}.part"
        with where.open_output_stream(own) as sink, pa.ipc.new_file(sink, schema) as writer:
            for batch in batches:
                writer.write_batch(batch.cast(schema))
        where.move(own, f"{folder}/part-{TaskContext.get().partitionId():05d}.arrow")
        return iter(())

    (df.coalesce(1) if single else df).mapInArrow(put, "done long").count()
    if not system.get_file_info(f"{folder}/part-00000.arrow").is_file:  # no rows, so no task may have run
        import pyarrow as pa

        with system.open_output_stream(f"{folder}/part-00000.arrow") as sink:
            pa.ipc.new_file(sink, schema).close()
    if os.path.isdir(base):
        system.delete_dir(base)
    if single:
        system.move(f"{folder}/part-00000.arrow", base)
        system.delete_dir(folder)
    else:
        system.move(folder, base)


def _write_duckdb(frame: Frame, path: str, table: str | None, single: bool) -> None:
    """A database file has one writer: Spark writes Parquet to the shared folder, from which DuckDB streams it into the table."""
    import duckdb

    if not table:
        raise ValueError("writing to a database file needs a table name")
    at = scratch("parquet")
    if not at.startswith(("file:", "/")):
        raise BackendError("writing to a DuckDB file needs a spark.checkpoint.dir that the driver reaches as files")
    frame.to_spark().write.parquet(at)
    files = "/" + at.removeprefix("file:").lstrip("/")
    with duckdb.connect(path) as con:
        con.execute(f"CREATE OR REPLACE TABLE {_quoted(table)} AS SELECT * FROM read_parquet(?)", [f"{files}/*.parquet"])


WRITERS = {
    ".parquet": _spark_files("parquet"), ".pq": _spark_files("parquet"),
    ".csv": _spark_files("csv", header=True), ".tsv": _spark_files("csv", header=True, sep="\t"),
    ".csv.gz": _spark_files("csv", header=True, compression="gzip"), ".tsv.gz": _spark_files("csv", header=True, sep="\t", compression="gzip"),
    ".jsonl": _spark_files("json", ignoreNullFields=False), ".ndjson": _spark_files("json", ignoreNullFields=False),
    ".json": _write_json, ".arrow": _write_ipc, ".feather": _write_ipc, ".ipc": _write_ipc,
    ".db": _write_duckdb, ".duckdb": _write_duckdb, ".ddb": _write_duckdb, ".xlsx": lambda frame, path, table, single: _no_excel(path),
}


def write(frame: Frame, path: str, table: str | None = None, single: bool = False, suffix: str | None = None) -> None:
    """Write a frame by the path's suffix: a folder with a file from each task, or one file, by one task, if `single`."""
    put = WRITERS[suffix] if suffix else _match(path, WRITERS)
    put(frame, path, table, single)
