"""Byte payloads as rows (stream_id, data), and block maps as rows (block, ...)."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ready


def texts(df: DataFrame, stream: str | Column, text: str = "text") -> DataFrame:
    """A stream for each row: its text in UTF-8; a null text is an empty stream."""
    return df.select(F.col(stream).alias("stream_id") if isinstance(stream, str) else stream.alias("stream_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))


#: Bytes of a file that one row has.
SEGMENT = 64 << 20


def file_segments(spark: SparkSession, path: str, size: int = SEGMENT) -> DataFrame:
    """Files of any size below a path as segments (stream_id, segment, pos, len, data) of `size` bytes, the last one shorter. Only
    places and lengths are listed, by Spark, which passes over empty files; each task reads its segments by ranges."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return read_places(listed.select(F.col("path").alias("stream_id"), "path", F.lit(0).cast("long").alias("pos"), F.col("length").alias("len"), F.lit("mapped").alias("kind")), size).drop("kind")


def thin_segments(path: str, runs: DataFrame, block_bytes: int, size: int = SEGMENT) -> DataFrame:
    """A device or file with holes as segments for packing: runs (label: whether provisioned, start, end, in blocks, as run_iter()
    gives them) say what is read; the others are segments without data."""
    kind = F.when(F.col("label"), "mapped").otherwise("unmapped")
    return read_places(runs.select(F.lit(path).alias("stream_id"), F.lit(path).alias("path"), (F.col("start") * block_bytes).alias("pos"), ((F.col("end") - F.col("start")) * block_bytes).alias("len"), kind.alias("kind")), size).drop("kind")


def delta_segments(path: str, chunks: DataFrame, size: int = SEGMENT) -> DataFrame:
    """What a delta reads of a device or file: chunks (kind, pos, len, as delta_chunks() gives them) as segments for pack_delta(), those
    of kind mapped with their bytes."""
    return read_places(chunks.select(F.lit(path).alias("stream_id"), F.lit(path).alias("path"), "pos", "len", "kind"), size).drop("stream_id")


def read_places(places: DataFrame, size: int = SEGMENT) -> DataFrame:
    """stream_id, segment, pos, len, kind, data: places (stream_id, path, pos, len, kind) with the bytes of those of kind mapped, which are cut
    to `size` bytes; segments are numbered by their places. Bytes beyond a file's end are an error, but for a last block's."""
    ready(places.sparkSession)
    last = F.when(F.col("kind") == "mapped", F.greatest(F.floor((F.col("len") - 1) / size), F.lit(0))).otherwise(F.lit(0).cast("long"))
    each = places.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
    whole = F.when(F.col("kind") == "mapped", F.least(F.lit(size).cast("long"), F.col("len") - F.col("_k") * size)).otherwise(F.col("len"))
    each = each.select("stream_id", "path", (F.col("pos") + F.col("_k") * size).alias("pos"), whole.alias("len"), "kind")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("stream_id", pa.string()), ("segment", pa.int64()), ("pos", pa.int64()), ("len", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():  # a batch for each, as it may be large
                data = None
                if row["kind"] == "mapped":
                    with open_input(row["path"]) as f:
                        end = f.size()
                        data = f.read_at(row["len"], row["pos"])
                    if len(data) < min(row["len"], max(end - row["pos"], 0)) or (row["len"] and not data):
                        raise OSError(f"{row['path']} ends before {row['pos'] + row['len']}")
                    row["len"] = len(data)  # a last block may be short
                yield pa.RecordBatch.from_pylist([{"stream_id": row["stream_id"], "segment": row["pos"], "pos": row["pos"], "len": row["len"], "kind": row["kind"], "data": data}], schema=schema)

    tasks = 4 * places.sparkSession.sparkContext.defaultParallelism
    return each.repartition(tasks, "stream_id", "pos").mapInArrow(read, "stream_id string, segment long, pos long, len long, kind string, data binary")


def open_input(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote("/" + path[5:].lstrip("/")))
    system, own = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(own)


def files(spark: SparkSession, path: str) -> DataFrame:
    """A stream for each file below a path, of under 2 GiB each; larger ones are read by file_segments()."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("stream_id"), F.col("content").alias("data"))


def block_map(df: DataFrame, block: str, data_block: str, time: str | None = None) -> DataFrame:
    """A device's mapping: block, data_block, time; one row a block."""
    return df.select(F.col(block).cast("long").alias("block"), F.col(data_block).cast("long").alias("data_block"), (F.col(time).cast("long") if time else F.lit(0).cast("long")).alias("time"))


def provisioned(mapping: DataFrame) -> DataFrame:
    return mapping.select("block").distinct()
