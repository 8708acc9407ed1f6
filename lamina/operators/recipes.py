"""Recipes as rows: run lengths, positions, overlays, slabs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recipe_codec
from ..session import stored

#: Bytes of a bin in interval joins.
BIN = 1 << 16


#: Numbers (seq) of a stream that are scanned together; runs that reach over their edges are joined afterwards.
SHARE = 1 << 24


_BESIDE = ("p_begin", "p_end", "begin")


def share_runs(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """stream_id, _share, _run, _seq, kind, fill, slab, offset, _at, nr_entries, len: neighbours that continue each other within a share of a
    stream's numbers are one run, numbered from 1; _seq is its first entry's number, _at the bytes before it in the share. One shuffle.

    entries: stream_id, seq, kind (fill, unmapped, data, partial), fill, slab, offset, nr_entries, len. Fills of one byte merge, and
    unmapped ones, and data that goes on where the one before ends; partial ones never do. p_begin, p_end and begin are the first entry's, if
    they are there."""
    fields = ["kind", "fill", "slab", "offset", *(c for c in _BESIDE if c in entries.columns)]
    of = ["stream_id", "_share"]
    w = Window.partitionBy(*of).orderBy("seq")
    cut = entries.withColumn("_share", F.floor(F.col("seq") / share)).withColumn("_cut", F.when(_goes_on(w), 0).otherwise(1)).withColumn("_at", F.sum("len").over(w) - F.col("len"))
    runs = cut.withColumn("_run", F.sum("_cut").over(w)).groupBy(*of, "_run").agg(F.min_by(F.struct(*fields, "_at"), "seq").alias("x"), F.min("seq").alias("_seq"), F.sum("nr_entries").alias("nr_entries"), F.sum("len").alias("len"))
    return runs.select(*of, "_run", "_seq", "x.*", "nr_entries", "len")


def _goes_on(w: Window) -> Column:
    same = lambda c: F.col(c).eqNullSafe(F.lag(c).over(w))
    return same("kind") & ((F.col("kind") == "unmapped") | ((F.col("kind") == "fill") & same("fill")) | ((F.col("kind") == "data") & same("slab") & (F.col("offset") == F.lag(F.col("offset") + F.col("nr_entries")).over(w))))


def rle(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """stream_id, seq, kind, fill, slab, offset, nr_entries, pos, len: neighbours that continue each other are one entry; see share_runs().

    A stream of any length is scanned in shares of its numbers, whose runs are stored. Only the first and last run of each share then meet
    those of the next, and shares are summed up to give places."""
    of = ["stream_id", "_share"]
    found = share_runs(entries, share).drop("_seq")
    fields = [c for c in found.columns if c not in (*of, "_run", "_at", "nr_entries", "len")]
    runs = stored(found.withColumn("_n", F.max("_run").over(Window.partitionBy(*of))))
    edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_n"))
    w = Window.partitionBy("stream_id").orderBy("_share", "_run")
    edges = runs.where(edge).withColumn("_on", F.coalesce(_goes_on(w) & (F.lag("_share").over(w) != F.col("_share")), F.lit(False))).withColumn("_group", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w))
    joined = edges.groupBy("stream_id", "_group").agg(F.min_by(F.struct("_share", "_run", *fields, "_at"), F.struct("_share", "_run")).alias("x"), F.sum("nr_entries").alias("nr_entries"), F.sum("len").alias("len"))
    columns = [*of, "_run", *fields, "_at", "nr_entries", "len"]
    every = runs.where(~edge).select(columns).unionByName(joined.select("stream_id", "x.*", "nr_entries", "len").select(columns))
    # in the entries' order: each share's bytes, and the runs that begin in it
    sizes = runs.groupBy(*of).agg(F.sum("len").alias("_bytes"), F.max("_n").alias("_n")).join(edges.where("_on").select(*of, F.lit(1).alias("_less")), of, "left")
    before = Window.partitionBy("stream_id").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    less = F.coalesce("_less", F.lit(0))
    sizes = sizes.select(*of, so_far(F.col("_bytes")).alias("_pos"), (so_far(F.col("_n") - less) - less).alias("_seq"))
    out = every.join(sizes, of)
    return out.select("stream_id", (F.col("_seq") + F.col("_run") - 1).alias("seq"), "kind", "fill", "slab", "offset", "nr_entries", (F.col("_pos") + F.col("_at")).alias("pos"), "len", *fields[4:])


def running_positions(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """With pos: the bytes of the stream before each entry. Shares are summed by themselves, then through."""
    of = ["stream_id", "_share"]
    own = entries.withColumn("_share", F.floor(F.col("seq") / share))
    before = Window.partitionBy("stream_id").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy(*of).agg(F.sum("len").alias("_bytes")).select(*of, F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    within = F.sum("len").over(Window.partitionBy(*of).orderBy("seq")) - F.col("len")
    return own.withColumn("_at", within).join(base, of).withColumn("pos", F.col("_base") + F.col("_at")).drop("_share", "_base", "_at")


def greedy_slabs(blocks: DataFrame, target: int) -> DataFrame:
    """group, ord, slab, idx: blocks in their order go to a slab until the next would take it over target bytes.

    Each group is packed in one task, from its blocks' places and lengths alone; groups are what is archived as one."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, slab, idx = object(), 0, 0, 0
        for batch in batches:
            slabs, places = [], []
            for g, n in zip(batch.column("group").to_pylist(), batch.column("len").to_pylist(), strict=True):
                if g != group:
                    group, size, slab, idx = g, 0, 0, 0
                if size and size + n > target:
                    size, slab, idx = 0, slab + 1, 0
                slabs.append(slab)
                places.append(idx)
                size += n
                idx += 1
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("ord"), pa.array(slabs, pa.int64()), pa.array(places, pa.int64())], ["group", "ord", "slab", "idx"])

    kinds = dict(blocks.dtypes)
    return blocks.select("group", "ord", "len").repartition("group").sortWithinPartitions("group", "ord").mapInArrow(pack, f"group {kinds['group']}, ord {kinds['ord']}, slab long, idx long")


def overlay(old: DataFrame, runs: DataFrame, width: int = BIN) -> DataFrame:
    """The part of an old recipe (stream_id, pos, len, ...) that each Ref run (stream_id, start, end) takes: the entries that it overlaps,
    with pos and len of the overlap, and skip: the bytes of the entry before it.

    Both sides go to every bin that they cover; a pair counts in the bin where its overlap starts."""
    bins = lambda start, end: F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))
    a = old.where("len > 0").withColumn("_bin", bins(F.col("pos"), F.col("pos") + F.col("len")))
    b = runs.where("end > start").select("stream_id", "start", "end").withColumn("_bin", bins(F.col("start"), F.col("end")))
    met = a.join(b, ["stream_id", "_bin"]).withColumn("_from", F.greatest("pos", "start")).withColumn("_to", F.least(F.col("pos") + F.col("len"), F.col("end")))
    met = met.where((F.col("_from") < F.col("_to")) & (F.floor(F.col("_from") / width) == F.col("_bin")))
    rest = [c for c in old.columns if c not in ("pos", "len")]
    return met.select(*rest, F.col("_from").alias("pos"), (F.col("_to") - F.col("_from")).alias("len"), (F.col("_from") - F.col("pos")).alias("skip"), (F.col("_to") - F.col("_from") == F.col("len")).alias("whole"))


_ENTRY = ("kind", "fill", "slab", "offset", "nr_entries", "len", "p_begin", "p_end")


def _entry(kind: str, fill: int, slab: int, offset: int, count: int, size: int, begin: int | None = None, end: int | None = None) -> tuple:
    return {"fill": ("fill", fill, size), "unmapped": ("unmapped", size), "data": ("data", slab, offset, count), "partial": ("partial", begin, end, slab, offset, count)}[kind]


#: Blocks that one instruction can emit.
LONGEST_RUN = (1 << 20) - 1


def short_runs(entries: Iterable[tuple], lengths: Iterable[int]) -> Iterator[tuple[tuple, int]]:
    """Each entry and its length, runs of data that no instruction could emit as several. The last of these has the run's bytes:
    how many the others have is not known here."""
    for entry, n in zip(entries, lengths, strict=True):
        while entry[0] == "data" and entry[3] > LONGEST_RUN:
            kind, slab, offset, count = entry
            yield (kind, slab, offset, LONGEST_RUN), 0
            entry = (kind, slab, offset + LONGEST_RUN, count - LONGEST_RUN)
        yield entry, n


def encoded(recipes: DataFrame) -> DataFrame:
    """stream_id, raw: each stream's recipe as bytes. Runs of any length are encoded, very long ones as several.

    A stream's entries come to one task in order and are encoded one after another: only the bytes made are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("stream_id").type
                yield from zip(batch.column("stream_id").to_pylist(), *(batch.column(c).to_pylist() for c in _ENTRY), strict=True)

        for stream, group in groupby(rows(), key=lambda r: r[0]):
            pairs = ((_entry(*r[1:]), r[1 + _ENTRY.index("len")]) for r in group)
            sizes: deque[int] = deque()  # of entries that the encoder has taken

            def entries(pairs: Iterable = pairs, sizes: deque = sizes) -> Iterator[tuple]:
                for pair in pairs:
                    for entry, n in short_runs(pair[:1], pair[1:]):
                        sizes.append(n)
                        yield entry

            raw = recipe_codec.encode(entries(), iter(sizes.popleft, None))
            yield pa.RecordBatch.from_arrays([pa.array([stream], kind), pa.array([raw], pa.binary())], ["stream_id", "raw"])

    own = [F.col(c) if c in recipes.columns else F.lit(None).cast("long").alias(c) for c in _ENTRY]
    ordered = recipes.select("stream_id", "seq", *own).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return ordered.mapInArrow(run, f"stream_id {dict(recipes.dtypes)['stream_id']}, raw binary")


def decoded(recipes: DataFrame) -> DataFrame:
    """stream_id, seq, kind, fill, slab, offset, nr_entries, and len of fills and holes (data's is its blocks' to say)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                entries, _ = recipe_codec.decode(raw)
                table = {"kind": [], "fill": [], "slab": [], "offset": [], "nr_entries": [], "len": [], "p_begin": [], "p_end": []}
                for e in entries:
                    whole = {"kind": e[0]}
                    whole |= {"fill": e[1], "len": e[2]} if e[0] == "fill" else {"len": e[1]} if e[0] == "unmapped" else dict(zip(("slab", "offset", "nr_entries"), e[-3:], strict=True))
                    whole |= {"p_begin": e[1], "p_end": e[2]} if e[0] == "partial" else {}
                    for name, column in table.items():
                        column.append(whole.get(name))
                columns = [pa.array(c, pa.string() if name == "kind" else pa.int64()) for name, c in table.items()]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("stream_id")[k], len(entries)), pa.array(range(len(entries)), pa.int64()), *columns], ["stream_id", "seq", *table])

    return recipes.select("stream_id", "raw").mapInArrow(run, f"stream_id {dict(recipes.dtypes)['stream_id']}, seq long, kind string, fill long, slab long, offset long, nr_entries long, len long, p_begin long, p_end long")


def traced(recipes: DataFrame) -> DataFrame:
    """stream_id, address, op, args and stack (registers as slab and offset; null where it can't have changed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                rows = list(recipe_codec.trace(raw))
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("stream_id")[k], len(rows)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["stream_id", "address", "op", "args", "stack"])

    return recipes.select("stream_id", "raw").mapInArrow(run, f"stream_id {dict(recipes.dtypes)['stream_id']}, address long, op string, args array<long>, stack array<array<long>>")


def frequencies(trace: DataFrame) -> DataFrame:
    """op, n: how often each instruction occurs."""
    return trace.groupBy("op").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "op")
