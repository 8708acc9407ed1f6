"""From payloads to chunks, and from chunks to distinct blocks with their owners."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import fill_byte, sha256_hex
from ..functions.splitter import Splitter, split

#: Bytes of pieces that the splitter hands on at once, besides those of one stream.
OUT_BYTES = 16 << 20
#: Bytes for each core, as estimated, up to which streams are dealt to all cores before they are split: they may lie in a file or two.
SPREAD_BYTES = 32 << 20


def fixed(streams: DataFrame, size: int) -> DataFrame:
    """stream_id, seq, pos, len, data: pieces of `size` bytes, the last one shorter; none of an empty stream."""
    n = F.octet_length("data")
    each = streams.where(n > 0).select("stream_id", "data", F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("seq"))
    rows = each.select("stream_id", F.col("seq").cast("long").alias("seq"), (F.col("seq").cast("long") * size).alias("pos"), F.expr(f"substring(data, seq * {size} + 1, {size})").alias("data"))
    return rows.select("stream_id", "seq", "pos", F.octet_length("data").cast("long").alias("len"), "data")


def content_defined(streams: DataFrame, block: int, splitter: Splitter = split, named: bool = False) -> DataFrame:
    """As fixed(), cut by content. Streams are split apart from each other, so the work spreads by stream; a stream with
    holes, or a long one, comes as a row for each segment. named: with fill and the 32-byte digest hash, as classified() has them, made
    in the same pass over the bytes."""
    names = ["stream_id", "seq", "pos", "len", "data", *(["fill", "hash"] if named else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()][: len(names) - 1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows, held = [], [], 0

            def out(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                made = pa.RecordBatch.from_arrays([batch.column("stream_id").take(pa.array(owner, pa.int64())), *columns], names)
                owner.clear(), rows.clear()
                return made

            for k, data in enumerate(batch.column("data")):
                raw = data.as_buffer().to_pybytes() if data.is_valid else b""
                at = 0
                for seq, size in enumerate(splitter(raw, block)):
                    part = raw[at : at + size]
                    if not named:
                        rows.append((seq, at, size, part))
                    elif part[0] == part[-1] and part == part[:1] * size:
                        rows.append((seq, at, size, part, part[0], None))
                    else:
                        rows.append((seq, at, size, part, None, hashlib.blake2b(part, digest_size=32).digest()))
                    at += size
                owner += [k] * (len(rows) - len(owner))
                held += len(raw)
                if held > OUT_BYTES and rows:
                    yield out()
                    held = 0
            if rows:
                yield out()

    kind = dict(streams.dtypes)["stream_id"]
    rows = streams.select("stream_id", "data")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < tasks * SPREAD_BYTES:  # as estimated, without running anything
        rows = rows.repartition(tasks)
    return rows.mapInArrow(cut, f"stream_id {kind}, seq long, pos long, len long, data binary" + (", fill int, hash binary" if named else ""))


def classified(chunks: DataFrame) -> DataFrame:
    """With fill (the byte that a chunk consists of) or, where there is none, hash."""
    return chunks.withColumn("fill", fill_byte(F.col("data"))).withColumn("hash", F.when(F.col("fill").isNull(), sha256_hex(F.col("data"))))


def owners(chunks: DataFrame, order: tuple[str, ...] = ("stream_id", "seq"), more: dict[str, Column] | None = None) -> DataFrame:
    """hash, owner (the first chunk with it, as a struct of order's columns), hits, len: each distinct block once.

    An aggregate, not a window: what one block has of chunks is reduced before the shuffle, however many there are."""
    own = {name: f for name, f in (more or {}).items()}
    return chunks.where("hash is not null").groupBy("hash").agg(F.min(F.struct(*order)).alias("owner"), F.count(F.lit(1)).alias("hits"), F.max("len").alias("len"), *(f.alias(n) for n, f in own.items()))


def unseen(blocks: DataFrame, archive: DataFrame) -> DataFrame:
    """The blocks that an archive lacks."""
    return blocks.join(archive.select("hash"), "hash", "left_anti")


def located(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each chunk with its block's owner; fills without one. Fills have no hash, and are no part of the join: they would all meet in one task."""
    owner = dict(blocks.dtypes)["owner"]
    found = chunks.where("hash is not null").join(blocks.select("hash", "owner"), "hash", "left")
    return found.unionByName(chunks.where("hash is null").withColumn("owner", F.lit(None).cast(owner)))


def pack_stats(chunks: DataFrame) -> DataFrame:
    """One row: mapped_size, fill_size, data_written, n_chunks and what follows from them."""
    per = chunks.groupBy("hash").agg(F.sum("len").alias("all"), F.max("len").alias("one"), F.count(F.lit(1)).alias("n"))
    fill = F.col("hash").isNull()
    total = per.agg(F.coalesce(F.sum("all"), F.lit(0)).alias("mapped_size"), F.coalesce(F.sum(F.when(fill, F.col("all"))), F.lit(0)).alias("fill_size"), F.coalesce(F.sum(F.when(~fill, F.col("one"))), F.lit(0)).alias("data_written"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))
    return total.select("*", (F.col("mapped_size") - F.col("data_written") - F.col("fill_size")).alias("duplicate"), F.try_divide("mapped_size", "data_written").alias("ratio"))


def derived(stats: DataFrame, stream_written: Column, seconds: Column | None = None) -> DataFrame:
    """With what a pack reports beside its sums: packed_size and ratio count the recipes' bytes too; bytes_per_second where the time is known."""
    packed = F.col("data_written") + stream_written
    out = stats.withColumn("packed_size", packed).withColumn("ratio", F.try_divide(F.col("mapped_size"), packed))
    return out if seconds is None else out.withColumn("bytes_per_second", F.try_divide(F.col("mapped_size").cast("double"), seconds))


def hit_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("hits").agg(F.count(F.lit(1)).alias("n_blocks"))


def length_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("len").agg(F.count(F.lit(1)).alias("n_blocks"))


def unique_bytes(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.coalesce(F.sum(F.when(F.col("hits") == 1, F.col("len"))), F.lit(0)).alias("unique_bytes"))
