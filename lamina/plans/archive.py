"""The archive and its commands: create, pack, pack a delta, unpack, verify, list, dump.

An archive is a folder of Parquet tables: config (one row), blocks (each distinct block once), mappings (recipes) and streams. A
stream exists once its row in streams is written, which comes last; what an interrupted pack has left is never read."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import adjust_block_size, human_size, list_time
from ..functions.splitter import SPLITTERS
from ..operators import chunks as C
from ..operators import recipes as R
from ..session import ready

SLAB_BYTES = 4 << 20
#: Slabs of a share: blocks are stored in a folder for each share, so that readers of few slabs read few files. Bytes of a stream whose
#: new blocks are dealt together.
SHARE_SLABS, DEALT = 256, 1 << 28
_BLOCKS = "hash binary, slab long, idx long, begin long, len long, data binary, share long"
_MAPPINGS = "stream_id string, seq long, pos long, len long, kind string, fill long, slab long, offset long, nr_entries long, p_begin long, p_end long, begin long, pack string"
_STREAMS = "stream_id string, name string, source_path string, pack_time timestamp, size long, mapped_size long, packed_size long, thin_id int, pack string"


class ArchiveError(ValueError):
    """An archive that isn't there, or is there already, or a stream that it lacks."""


def _segments(streams: DataFrame) -> DataFrame:
    """Streams (stream_id, data) as segments (stream_id, segment, len, data, pos); segments as they are."""
    if "segment" in streams.columns:
        return streams
    zero = F.lit(0).cast("long")
    return streams.select("stream_id", zero.alias("segment"), F.octet_length("data").cast("long").alias("len"), "data", zero.alias("pos"))


def _placed_segments(segments: DataFrame) -> DataFrame:
    """With pos: where each segment begins. The running sum is over the segments' lengths alone."""
    w = Window.partitionBy("stream_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("pos", F.coalesce(F.sum("len").over(w), F.lit(0)))


def _together(spark: SparkSession, *jobs: Callable) -> list:
    """The jobs' results. They run side by side, as none needs another's."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _filled(byte: Column, n: Column) -> Column:
    """n bytes of one value."""
    return F.unhex(F.repeat(F.lpad(F.hex(byte), 2, F.lit("0")), n.cast("int")))


@dataclass
class Archive:
    spark: SparkSession
    root: str

    def __post_init__(self):
        ready(self.spark)

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(name))
        except AnalysisException:  # nothing written yet: an empty relation, which plans leave out
            columns = (c.split(" ") for c in schema.split(", "))
            return self.spark.range(1).where("false").select(*(F.lit(None).cast(kind).alias(name) for name, kind in columns))

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    # -- create, config

    def create(self, block_size: int = 4096, compression: bool = True, splitter: str = "gear") -> Archive:
        """A new archive; its folder must not exist. The block size becomes a power of two of 1 MiB at most. splitter: one of SPLITTERS."""
        if splitter not in SPLITTERS:
            raise ArchiveError(f"no splitter {splitter}")
        if self._exists():
            raise ArchiveError(f"{self.root} exists")
        row = {"block_size": adjust_block_size(block_size), "splitter_alg": splitter, "codec": "zstd" if compression else "none"}
        self.spark.range(1, numPartitions=1).select(*(F.lit(v).alias(k) for k, v in row.items())).write.parquet(self.path("config"))
        return self

    def config(self) -> dict:
        try:
            row = self.spark.read.parquet(self.path("config")).first()
        except AnalysisException as e:
            raise ArchiveError(f"no archive in {self.root}") from e
        if row["splitter_alg"] not in SPLITTERS:
            raise ArchiveError(f"no splitter {row['splitter_alg']}")
        return row.asDict()

    # -- tables

    def streams(self) -> DataFrame:
        return self._read("streams", _STREAMS)

    def blocks(self) -> DataFrame:
        """Blocks of finished packs and of unfinished ones; the latter are whole too, and may be used."""
        return self._read("blocks", _BLOCKS)

    def mappings(self) -> DataFrame:
        return self._read("mappings", _MAPPINGS).join(self.streams().select("stream_id", "pack"), ["stream_id", "pack"], "left_semi")

    def list(self) -> DataFrame:
        """stream_id, size, time, name, by the time of packing; size_text: sizes right-aligned in a column as wide as the longest."""
        rows = self.streams()
        width = rows.agg(F.coalesce(F.max(F.length(F.col("size").cast("string"))), F.lit(0)).alias("_width"))
        rows = rows.crossJoin(F.broadcast(width)).orderBy("pack_time", "stream_id")  # width is one row
        return rows.select("stream_id", "size", list_time(F.col("pack_time")).alias("time"), "name", F.lpad(F.col("size").cast("string"), F.col("_width"), F.lit(" ")).alias("size_text"))

    # -- pack

    def pack(self, streams: DataFrame, name: str | None = None, source_path: str | None = None) -> DataFrame:
        """Archive streams (stream_id, data), or segments (stream_id, segment, len, data; data null for a hole); ids that are there
        already are passed over. Returns one row of statistics."""
        new = _segments(streams).withColumn("stream_id", F.col("stream_id").cast("string")).join(self.streams().select("stream_id"), "stream_id", "left_anti")
        return self._pack(new, name, source_path, None)

    def pack_delta(self, stream_id: str, base: str, segments: DataFrame, name: str | None = None) -> DataFrame:
        """Archive a stream that is known as a change of another: segments (segment, kind, pos, len, data) of kind mapped (read), unmapped,
        or ref (as in base at the same place). Only what has changed is read."""
        return self.pack_deltas(segments.withColumn("stream_id", F.lit(stream_id)).withColumn("base", F.lit(base)), name)

    def pack_deltas(self, segments: DataFrame, name: str | None = None) -> DataFrame:
        """pack_delta() of many streams: segments with stream_id and base. Streams that are there already are passed over."""
        own = segments.withColumn("stream_id", F.col("stream_id").cast("string")).join(self.streams().select("stream_id"), "stream_id", "left_anti")
        refs = own.where("kind = 'ref'").select("stream_id", F.col("pos").alias("start"), (F.col("pos") + F.col("len")).alias("end"))
        pairs = own.where("kind = 'ref'").select("stream_id", F.col("base").cast("string").alias("base")).distinct()
        old = self.mappings().drop("pack").withColumnRenamed("stream_id", "base").join(pairs, "base").drop("base")
        kept = R.overlay(old, refs)
        clip = F.col("kind").isin("data", "partial") & ~F.col("whole")
        start = F.coalesce("p_begin", F.lit(0)) + F.col("skip")
        kept = kept.select("stream_id", "pos", "len", F.when(clip, "partial").otherwise(F.col("kind")).alias("kind"), "fill", "slab", "offset", "nr_entries", F.when(clip, start).otherwise(F.col("p_begin")).alias("p_begin"), F.when(clip, start + F.col("len")).otherwise(F.col("p_end")).alias("p_end"), "begin")
        return self._pack(own.where("kind <> 'ref'").select("stream_id", "segment", "len", "data", "pos"), name, None, kept)

    def _pack(self, segments: DataFrame, name: str | None, source_path: str | None, kept: DataFrame | None) -> DataFrame:
        """The chunks are written once; one shuffle of their hashes finds what is new, one places it. Constant chunks have no hash, and are
        no part of the joins on it."""
        config, pack = self.config(), uuid.uuid4().hex
        staged = lambda df, what: self._staged(df, pack, what)
        if "pos" not in segments.columns:
            segments = _placed_segments(segments)
        twice = segments.groupBy("stream_id", "segment").count().where("count > 1")
        whole = segments.where("data is not null").select(F.struct("stream_id", "segment", "pos").alias("stream_id"), "data")
        cut = C.content_defined(whole, config["block_size"], SPLITTERS[config["splitter_alg"]], named=True)
        hashed = cut.select("stream_id.stream_id", (F.col("stream_id.pos") + F.col("pos")).alias("pos"), "len", "data", "fill", "hash")
        chunks, once, base = _together(self.spark, lambda: staged(hashed, "chunks"), twice.isEmpty, self._next_slab)
        if not once:
            self._drop(f"staging-{pack}")
            raise ArchiveError("a stream is given twice")
        known = self.blocks().select("hash", "slab", "idx", "begin")
        placed = self._placed(C.unseen(C.owners(chunks, ("stream_id", "pos")), known), pack, base)
        rows = chunks.drop("len").join(placed, ["hash", "stream_id", "pos"]).select("hash", "slab", "idx", "begin", "len", "data", F.floor(F.col("slab") / SHARE_SLABS).alias("share"))
        rows = rows.repartition("share", F.col("slab") % 8).sortWithinPartitions("share", "slab", "idx")
        blocks = rows.write.mode("append").partitionBy("share").option("compression", config["codec"])
        place = known.unionByName(placed.select("hash", "slab", "idx", "begin"))
        none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
        found = chunks.where("hash is not null").select("stream_id", "pos", "len", "hash").join(place, "hash")
        entries = found.select("stream_id", "pos", "len", F.lit("data").alias("kind"), *none("fill"), "slab", F.col("idx").alias("offset"), F.lit(1).cast("long").alias("nr_entries"), *none("p_begin", "p_end"), "begin")
        fills = chunks.where("fill is not null").select("stream_id", "pos", "len", F.lit("fill").alias("kind"), F.col("fill").cast("long").alias("fill"), *none("slab", "offset", "nr_entries", "p_begin", "p_end", "begin"))
        holes = segments.where("data is null and len > 0").select("stream_id", "pos", "len", F.lit("unmapped").alias("kind"), *none("fill", "slab", "offset", "nr_entries", "p_begin", "p_end", "begin"))
        entries = entries.unionByName(fills).unionByName(holes)
        if kept is not None:
            entries = entries.unionByName(kept.select(entries.columns))
        runs = R.share_runs(entries.withColumn("seq", F.col("pos")), share=1 << 36)  # numbered by bytes here; a run ends with its share
        runs = runs.select("stream_id", F.col("_seq").alias("seq"), F.col("_seq").alias("pos"), *(c for c in entries.columns if c not in ("stream_id", "pos")), F.lit(pack).alias("pack"))
        mappings = runs.write.mode("append").partitionBy("pack")
        stats = chunks.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total_read"), F.coalesce(F.sum(F.when(F.col("fill").isNotNull(), F.col("len"))), F.lit(0)).alias("fill_size"), F.count(F.lit(1)).alias("n_chunks")).crossJoin(F.broadcast(placed.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("data_written"))))  # one row each
        _, _, out = _together(self.spark, lambda: blocks.parquet(self.path("blocks")), lambda: mappings.parquet(self.path("mappings")), stats.withColumn("duplicate", F.col("total_read") - F.col("fill_size") - F.col("data_written")).first)
        mapped = self._read("mappings", _MAPPINGS).where(F.col("pack") == pack)
        size = mapped.groupBy("stream_id").agg(F.sum("len").alias("size"), F.coalesce(F.sum(F.when(F.col("kind") != "unmapped", F.col("len"))), F.lit(0)).alias("mapped_size"))
        owned = placed.groupBy("stream_id").agg(F.sum("len").alias("packed_size"))
        ids = segments.select("stream_id").union(mapped.select("stream_id")).distinct().join(size, "stream_id", "left").join(owned, "stream_id", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        ids.select("stream_id", F.coalesce(F.lit(name), F.col("stream_id")).alias("name"), F.lit(source_path).cast("string").alias("source_path"), F.current_timestamp().alias("pack_time"), zero("size"), zero("mapped_size"), zero("packed_size"), F.lit(None).cast("int").alias("thin_id"), F.lit(pack).alias("pack")).coalesce(8).write.mode("append").parquet(self.path("streams"))
        self._drop(f"staging-{pack}")
        return self.spark.createDataFrame([out.asDict()], "total_read long, fill_size long, n_chunks long, data_written long, duplicate long")

    def _next_slab(self) -> int:
        return self.blocks().agg(F.coalesce(F.max("slab") + 1, F.lit(0))).first()[0]

    def _placed(self, fresh: DataFrame, pack_id: str, base: int) -> DataFrame:
        """hash, stream_id, pos (of the owner), len, slab, idx, begin: blocks in the order of their owners, in slabs of SLAB_BYTES, numbered on
        from the archive's.

        Stretches of DEALT bytes of a stream are dealt to tasks, and each task begins a slab of its own; then the slabs are numbered through."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, size, slab, idx = TaskContext.get().partitionId(), 0, 0, 0
            for batch in batches:
                out = []
                for n in batch.column("len").to_pylist():
                    if size and size + n > SLAB_BYTES:
                        size, slab, idx = 0, slab + 1, 0
                    out.append((part, slab, idx, size))
                    size += n
                    idx += 1
                columns = [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)]
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("hash", "stream_id", "pos", "len")] + columns, ["hash", "stream_id", "pos", "len", "part", "local", "idx", "begin"])

        dealt = fresh.select("hash", "owner.stream_id", "owner.pos", "len").repartition("stream_id", F.floor(F.col("pos") / DEALT)).sortWithinPartitions("stream_id", "pos")
        local = self._staged(dealt.mapInArrow(pack, "hash binary, stream_id string, pos long, len long, part long, local long, idx long, begin long"), pack_id, "local")
        parts = dict(local.groupBy("part").agg(F.max("local") + 1).collect())  # a row for each task
        firsts, at = [], base
        for part in range(max(parts, default=-1) + 1):
            firsts.append(str(at))
            at += parts.get(part, 0)
        first = F.element_at(F.split(F.lit(",".join(firsts)), ","), F.col("part").cast("int") + 1).cast("long")  # folded to one array
        return local.select("hash", "stream_id", "pos", "len", (first + F.col("local")).alias("slab"), "idx", "begin")

    def _staged(self, df: DataFrame, pack: str, what: str) -> DataFrame:
        path = self.path(f"staging-{pack}/{what}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    # -- unpack, verify, dump

    def pieces(self, stream_ids: list[str] | None = None) -> DataFrame:
        """stream_id, pos, len, kind, fill, data of each block, fill or hole, cut to what the stream has of it; holes have no data, and a
        fill's is left to its byte. Of the blocks, only the shares of slabs that the streams asked for are made of are read."""
        rows, blocks = self.mappings(), self.blocks()
        if stream_ids is not None:
            rows = rows.where(F.col("stream_id").isin(stream_ids))
            shares = rows.where("slab is not null").select(F.floor(F.col("slab") / SHARE_SLABS).alias("share")).distinct().collect()  # a number for each GiB
            blocks = blocks.where(F.col("share").isin([x[0] for x in shares]))
        data = rows.where(F.col("kind").isin("data", "partial")).withColumn("idx", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("nr_entries") - 1)))
        data = data.join(blocks.select("slab", "idx", F.col("begin").alias("_begin"), F.col("len").alias("size"), "data"), ["slab", "idx"])
        data = data.withColumn("at", F.col("_begin") - F.col("begin") - F.coalesce("p_begin", F.lit(0)))  # of the block, from the entry's beginning
        start, end = F.greatest(F.col("at"), F.lit(0)), F.least(F.col("at") + F.col("size"), F.col("len"))
        cut = data.where(start < end).select("stream_id", (F.col("pos") + start).alias("pos"), (end - start).alias("len"), F.lit("data").alias("kind"), F.lit(None).cast("long").alias("fill"), F.substring(F.col("data"), (start - F.col("at") + 1).cast("int"), (end - start).cast("int")).alias("data"))
        rest = rows.where(F.col("kind").isin("fill", "unmapped")).select("stream_id", "pos", "len", "kind", "fill", F.lit(None).cast("binary").alias("data"))
        return cut.unionByName(rest)

    def unpack(self, stream_ids: list[str] | None = None) -> DataFrame:
        """stream_id, data: each stream's bytes, holes as zeros. A stream of under 2 GiB is put together in one row; larger ones are
        read as pieces()."""
        known = self.streams().select("stream_id")
        if stream_ids is not None:
            known = known.where(F.col("stream_id").isin(stream_ids))
        part = F.coalesce("data", _filled(F.coalesce("fill", F.lit(0)), F.col("len")))
        whole = self.pieces(stream_ids).withColumn("part", part).groupBy("stream_id").agg(F.expr("listagg(part) within group (order by pos)").alias("data"))
        return known.join(whole, "stream_id", "left").select("stream_id", F.coalesce("data", F.lit(b"")).alias("data"))

    def _binned(self, rows: DataFrame, width: int) -> DataFrame:
        """Pieces or segments (stream_id, pos, len, data and others), cut at every `width` bytes of their streams, with the number of the bin."""
        last = F.floor((F.col("pos") + F.col("len") - 1) / width)
        low = lambda k: F.greatest(F.col("pos"), k * width)
        size = lambda k: F.least(F.col("pos") + F.col("len"), (k + 1) * width) - low(k)
        part = lambda k: F.struct(k.alias("bin"), low(k).alias("pos"), size(k).alias("len"), F.substring(F.col("data"), (low(k) - F.col("pos") + 1).cast("int"), size(k).cast("int")).alias("data"))
        cut = rows.where("len > 0").withColumn("_parts", F.transform(F.sequence(F.floor(F.col("pos") / width), last), part))
        others = [c for c in rows.columns if c not in ("pos", "len", "data")]
        return cut.select(*others, F.explode("_parts").alias("_x")).select(*others, "_x.*")

    def verify(self, streams: DataFrame) -> DataFrame:
        """stream_id, ok, reason, position (of the first difference) and verified (bytes before it) of each stream given: streams
        (stream_id, data), or segments as for pack(). A hole is equal to nothing but a hole.

        Both sides are cut at equal places and meet there, so the work grows with the bytes and spreads by them."""
        width = 16 * max(self.config()["block_size"], 256)
        given = _segments(streams).withColumn("stream_id", F.col("stream_id").cast("string"))
        given = given if "pos" in given.columns else _placed_segments(given)
        sizes = given.groupBy("stream_id").agg(F.sum("len").alias("n"))
        source = self._binned(given.select("stream_id", "pos", "len", "data"), width).select("stream_id", "bin", F.col("pos").alias("_pos"), F.col("len").alias("_len"), F.col("data").alias("_data"))
        asked = self.pieces().join(sizes.select("stream_id"), "stream_id", "left_semi")
        both = self._binned(asked, width).join(source, ["stream_id", "bin"])
        start, end = F.greatest("pos", "_pos"), F.least(F.col("pos") + F.col("len"), F.col("_pos") + F.col("_len"))
        both = both.withColumn("_start", start).withColumn("_n", (end - start).cast("int")).where("_n > 0")
        here = F.substring(F.col("_data"), (F.col("_start") - F.col("_pos") + 1).cast("int"), F.col("_n"))
        want = F.coalesce(F.substring(F.col("data"), (F.col("_start") - F.col("pos") + 1).cast("int"), F.col("_n")), _filled(F.col("fill"), F.col("_n")))
        hole, open_ = F.col("kind") == "unmapped", F.col("_data").isNull()
        reason = F.when(hole & ~open_, "expected a hole").when(~hole & open_, "expected data").when(~hole & (here != want), "data mismatch")
        wrong = both.withColumn("reason", reason).where("reason is not null").groupBy("stream_id").agg(F.min(F.struct(F.col("_start").alias("pos"), "reason")).alias("x"))
        rows = sizes.join(self.streams().select("stream_id", "size"), "stream_id", "left").join(wrong, "stream_id", "left")
        why = F.when(F.col("size").isNull(), "not archived").when(F.col("x").isNotNull(), F.col("x.reason")).when(F.col("size") > F.col("n"), "archive longer than input").when(F.col("size") < F.col("n"), "archive too short")
        at = F.when(F.col("x").isNotNull(), F.col("x.pos")).when(why.isNotNull(), F.least(F.coalesce("size", F.lit(0)), F.col("n")))
        return rows.select("stream_id", why.isNull().alias("ok"), why.alias("reason"), at.alias("position"), F.coalesce(at, "n").alias("verified"))

    def restore(self, present: DataFrame, data_block: int, targets: DataFrame | None = None, stream_ids: list[str] | None = None) -> DataFrame:
        """stream_id, pos, len, action, data (what is to be written): the least that makes a target into a stream. present: the blocks
        of data_block bytes that a target has (stream_id, block, data); targets (stream_id, size): a target must be of its stream's size.

        Equal bytes are skipped and others written; of a hole, blocks that the target has are discarded and others passed over."""
        if targets is not None:
            own = self.streams().select("stream_id", F.col("size").alias("_size"))
            wrong = targets.withColumn("stream_id", F.col("stream_id").cast("string")).join(own, "stream_id").where("size <> _size").head(1)
            if wrong:
                raise ArchiveError(f"the target of {wrong[0]['stream_id']} has {wrong[0]['size']} bytes, the stream {wrong[0]['_size']}")
        have = present.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("block").cast("long").alias("bin"), F.col("data").alias("_data"), F.lit(True).alias("_there"))
        rows = self._binned(self.pieces(stream_ids), data_block).join(have, ["stream_id", "bin"], "left")
        want = F.coalesce("data", _filled(F.col("fill"), F.col("len")))
        here = F.substring(F.col("_data"), (F.col("pos") - F.col("bin") * data_block + 1).cast("int"), F.col("len").cast("int"))
        action = F.when(F.col("kind") == "unmapped", F.when(F.col("_there"), "discard").otherwise("forward")).when(F.coalesce(want == here, F.lit(False)), "skip").otherwise("write")
        return rows.withColumn("action", action).select("stream_id", "pos", "len", "action", F.when(F.col("action") == "write", want).alias("data"))

    def dump(self, stream_id: str) -> DataFrame:
        """The instructions of a stream's recipe, with the registers after each."""
        if self.streams().where(F.col("stream_id") == stream_id).isEmpty():
            raise ArchiveError(f"no stream {stream_id}")
        return R.traced(R.encoded(self.mappings().where(F.col("stream_id") == stream_id))).drop("stream_id").orderBy("address")

    def sizes(self) -> DataFrame:
        """n_slabs, n_blocks, data_bytes and the latter as text."""
        out = self.blocks().agg(F.count_distinct("slab").alias("n_slabs"), F.count(F.lit(1)).alias("n_blocks"), F.coalesce(F.sum("len"), F.lit(0)).alias("data_bytes"))
        return out.withColumn("text", human_size(F.col("data_bytes")))
