"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of JVM-side data that a size-checked broadcast may hold.
BROADCAST_LIMIT_BYTES = 64 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this machine's
    serves a local session (as in tests); on a cluster it is an error, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Settings while a table is written: its shuffle files go once it is there, and Python workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Rows of an Arrow batch: of texts, and where a row may hold a whole set of shingles or more.
BATCH_ROWS, WIDE_ROWS = 1000, 200
#: Bytes of an Arrow batch that a worker returns.
OUT_BYTES = 1 << 20
#: Tasks that parts of a dealt table are spread over at most; a task takes its parts one after another.
MOST_TASKS = 20_000

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Writes a table in the shared folder and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    with settings(spark, _WRITING | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch_rows)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def short_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_ROWS rows from now on: what an operator returns runs later, and texts by the
    ten thousand would fill workers, and the executors' memory outside their heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that materialize wrote and that no later job reads."""
    for table in tables:
        if table is not None and (path := _paths.pop(table, None)) is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z alone, so that lengths and all other characters stay."""
    return F.translate(column, UPPER, UPPER.lower())


def doc_hash_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def row_key(id_column: str, text_column: str) -> Column:
    """A string equal for rows of equal id and text; nulls are told from values."""
    return F.concat_ws(
        "|",
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")),
        F.hex(F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))),
        F.length(F.coalesce(F.col(text_column), F.lit(""))).cast("string"),
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    """Whether df, a materialised table, fits a broadcast: it counts rows, at row_bytes each, and stops at the limit."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Holds session settings while jobs run."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def release() -> None:
    """Gives memory that this process no longer uses back to the system; where the C library has no such call, less of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_short(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about OUT_BYTES at most, but for one row: the JVM holds each whole, outside its heap."""
    rows = max(batch.num_rows * OUT_BYTES // max(batch.nbytes, 1), 1)
    for at in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(at, rows)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that returns short batches, and releases its memory at its end: workers are reused, and would hold
    on to it while idle."""

    def task(batches: Iterator) -> Iterator:
        try:
            for batch in run(batches):
                yield from in_short(batch)
        finally:
            release()

    return task


def parts_for(total_bytes: int, part_bytes: int) -> int:
    """Into how many parts data of this size are dealt, so that a task can hold one whole."""
    return max(-(-int(total_bytes) // part_bytes), 1)


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a column part (0 to parts - 1), each part whole and in one piece in a task."""
    tasks = min(parts, MOST_TASKS)
    return rows.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part, of batches in order of their column part."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != held[-1]["part"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
