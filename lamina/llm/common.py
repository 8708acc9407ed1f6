"""What the operators of this subpackage share: tables, the shared folder, sized joins, Arrow passes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..session import ready

#: Rows and bytes that one side of a join may have, as counted, to be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bytes of a row group of a stored table: a writer holds one in memory, and a reader skips them by their statistics.
ROW_GROUP = 16 << 20
#: Rows and bytes handed to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20

_run = uuid.uuid4().hex
_used: set[str] = set()
_tables: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and by bytes, so that long texts don't add up in a worker. Spark reads these settings of the session
    as it runs a plan, so they stay for the session; smaller ones that are there are left."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(key).strip()
        if not (own.isdigit() and 0 < int(own) <= most):
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """A folder of this run under spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, as in tests; on a cluster,
    whose machines don't share one, an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (sc.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lamina-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/lamina-{_run}"
    if folder not in _used:
        _used.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: computed once, its lineage cut, and no executor's loss loses it.
    The table stays until the scratch() about it ends, or the driver does."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
    if _tables:
        _tables[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored() within it are removed at its end, but for those stored by the function that it gives: these are of whoever called,
    and must not depend on others but by having been written."""
    _tables.append([])

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        if len(_tables) > 1:
            _tables[-2].append(_tables[-1][-1])
        _tables[-1].pop()
        return out

    try:
        yield kept
    finally:
        for path in _tables.pop():
            _remove(spark, path)


def row_bytes(kind: DataType, c: Column) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, StringType | BinaryType):
        out = F.octet_length(c) + 24
    elif isinstance(kind, ArrayType):
        inner = kind.elementType
        fixed = not isinstance(inner, StringType | BinaryType | ArrayType | StructType)
        out = F.size(c) * 8 + 24 if fixed else F.aggregate(c, F.lit(24).cast("long"), lambda total, x: total + row_bytes(inner, x).cast("long"))
    elif isinstance(kind, StructType):
        out = sum((row_bytes(f.dataType, c[f.name]) for f in kind.fields), F.lit(16))
    else:
        return F.lit(8)
    return F.coalesce(out, F.lit(8))


def is_small(df: DataFrame) -> bool:
    """Whether df, counted by rows and bytes, may be sent to every executor. It must be cheap to read: a stored table or an aggregate of one."""
    size = sum((row_bytes(f.dataType, F.col(f"`{f.name}`")) for f in df.schema.fields), F.lit(32).cast("long"))
    rows, total = df.agg(F.count(F.lit(1)), F.sum(size)).first()
    return rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES


def sized_join(large: DataFrame, small: DataFrame, on: list[str], how: str = "inner", fits: bool | None = None) -> DataFrame:
    """large joined to small: by broadcast if small is_small(); else by a shuffle of both, in which
    Spark splits what a hot key brings to one task (spark.sql.adaptive.skewJoin) and sends small's rows of that key to each part.

    how: inner, left or left_semi, all of which can be split."""
    if is_small(small) if fits is None else fits:
        return large.join(F.broadcast(small), on, how)
    return large.join(small.hint("merge"), on, how)


def parted_join(rows: DataFrame, other: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined to other, which has a row a key, where both grow with the input: by a shuffle of both, but for the rows of the keys in
    `hot` (a stored table of the column key alone), which stay where they are and get other's rows by a sized_join(). how: inner or left_semi."""
    flagged = sized_join(rows, hot.withColumn("_hot", F.lit(True)), [key], "left")
    few = stored(sized_join(other, hot, [key], "left_semi"), "of-hot-keys")
    there = sized_join(flagged.where("_hot").drop("_hot"), few, [key], how)
    return there.unionByName(flagged.where("_hot is null").drop("_hot").join(other.hint("merge"), [key], how))


def give_back() -> None:
    """At the end of a pass: memory that a worker has no more use for, as it lives on beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_pass(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """per_batch over df's Arrow batches; schema: of what it returns."""
    small_batches(df.sparkSession)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (out := per_batch(batch)) is not None:
                yield out
        give_back()

    return df.mapInArrow(over, schema)


class Kept(dict):
    """Results that a worker keeps by a key (str or bytes) from batch to batch, up to about `most` bytes and what one call adds:
    workers are used again by later stages, and whatever they hold stands beside those stages' own."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.size = most, 0

    def room(self) -> None:
        """To be called before results are looked up that shall be there later in the same call."""
        if self.size > self.most:
            self.clear()
            self.size = 0

    def add(self, found: dict) -> None:
        self.update(found)
        self.size += 180 * len(found) + 2 * sum(map(len, found))


def ascii_lower(c: Column) -> Column:
    """c with A-Z, and no other letters, in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_id(c: Column) -> Column:
    """A text's number: with the row's id it tells rows apart that share an id."""
    return F.xxhash64(c)


def row_key(id_col: Column, text: Column) -> list[Column]:
    """_k1 and _k2: what a row's results are joined by. Never null; rows with equal id and text share them, and their results."""
    return [F.xxhash64(F.lit("id"), id_col).alias("_k1"), F.xxhash64(F.lit("text"), text).alias("_k2")]


KEY = ["_k1", "_k2"]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (all of docs' columns, whatever their names), _k1 and _k2."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *row_key(F.col(id_col), F.col(text_col)))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")
