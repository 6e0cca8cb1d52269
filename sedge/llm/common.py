"""What the operators for training data share: scratch tables, columns by position, maps over texts, memos, digests."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows whose results a task holds at once.
SLICE = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir where the cluster names it.

    Only where that is unset and Spark runs on one machine, as in tests, a local folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sedge-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage, fixes generated ids, and survives the loss of executors.
    The files are scratch: they belong to the application and may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sedge-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of queries that have ended: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_position(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: names that differ by case alone, or not at all, can't clash."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def need(df: DataFrame, *names: str) -> DataFrame:
    """df cut down to the named columns (the first of each exact name); extra columns, whatever their names, go no further."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {df.columns}")
    return by_position(df).select(*[F.col(f"c{df.columns.index(n)}").alias(n) for n in names])


def from_texts(rows: DataFrame, start: Callable, made: str, column: str = "text", keep: bool = False) -> DataFrame:
    """rows with the columns `made` (DDL) after their own; `column` itself goes unless `keep`.

    start() runs once in a task and returns a function from a list of the column's values to a list
    of tuples, one for each. All other columns pass as Arrow arrays, whatever their names and types:
    an integer beside a null stays exact. An empty table gives an empty result.
    """
    at = rows.columns.index(column)
    kept = [i for i in range(len(rows.columns)) if keep or i != at]
    new = T.DataType.fromDDL(made)
    types = list(to_arrow_schema(new).types)
    plain = by_position(rows)
    schema = T.StructType([plain.schema[i] for i in kept] + [T.StructField(f"m{i}", f.dataType) for i, f in enumerate(new.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                found = list(zip(*make(batch.column(at).to_pylist()), strict=True))
                arrays = [batch.column(i) for i in kept] + [pa.array(x, t) for x, t in zip(found, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*[rows.columns[i] for i in kept], *new.names)


def map_texts(docs: DataFrame, start: Callable) -> DataFrame:
    """docs with each text replaced by what the function of start() gives for it; a row for which it gives False goes.

    The columns keep their places, names, types and values.
    """
    at = docs.columns.index("text")
    plain = by_position(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        make = start()
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                texts = make(batch.column(at).to_pylist())
                arrays = [pa.array([None if t is False else t for t in texts], pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns)]
                out = pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
                yield out.filter(pa.array([t is not False for t in texts], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def frequent(table: DataFrame, count: Column, most: int) -> Column | None:
    """A condition that holds for the most frequent rows of the table, at most `most`; None if it holds for none.

    It asks for a level of counts, in sixteenths of a power of two, so only a few hundred numbers reach the driver.
    """
    level = F.floor(F.log2(count) * 16).cast("int")
    total, least = 0, None
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return None if least is None else level >= least


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the documents whose labels nothing may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def give_back() -> None:
    """Return what earlier tasks of this Python worker have freed to the system: it counts as the executor's memory until then."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


class Memo(dict):
    """What make() gives for keys, kept for keys of at most `longest` characters in two generations of at most `most` keys.

    Both bounds together bound its bytes, whatever the texts. When the young generation is full the old one goes.
    """

    def __init__(self, make: Callable, most: int = 200_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
