"""Every query of this library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import chunks as C
from .operators import recipes as R
from .operators import runs as B
from .plans.archive import Archive
from .session import shared_folder, table
from .sources import payloads, slab_file
from .streaming import ingest

#: Bytes of a piece where streams are split evenly, and of a slab and a data block in the queries.
PIECE, SLAB, DATA_BLOCK = 256, 4096, 65536

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.texts(table(spark, sf_dir, "documents"), "doc_id")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classified(C.fixed(_streams(spark, sf_dir), PIECE))


_C = f"""
    c AS (SELECT doc_id AS stream_id, k AS seq, k * {PIECE} AS pos, array_slice(b, k * {PIECE} + 1, k * {PIECE} + {PIECE}) AS data
          FROM (SELECT doc_id, b, unnest(range(0, CAST((octet_length(b) + {PIECE - 1}) // {PIECE} AS BIGINT))) AS k FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents))),
    f AS (SELECT *, octet_length(data) AS len, CASE WHEN hex(data) = repeat(substr(hex(data), 1, 2), CAST(octet_length(data) AS BIGINT)) THEN TRUE ELSE FALSE END AS is_fill, sha256(data) AS h FROM c),
    x AS (SELECT stream_id, seq, pos, CAST(len AS BIGINT) AS len, is_fill, CASE WHEN NOT is_fill THEN h END AS hash FROM f),
    o AS (SELECT *, first_value(stream_id) OVER w AS o_stream, first_value(seq) OVER w AS o_seq, count(*) OVER (PARTITION BY hash) AS hits, row_number() OVER w AS rn FROM x WHERE hash IS NOT NULL WINDOW w AS (PARTITION BY hash ORDER BY stream_id, seq))"""


@query("SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, sha256(encode(coalesce(text, ''))) AS digest FROM documents")
def pack_roundtrip_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into a new archive, split by content, and rebuild each from its recipe."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=64)
    archive.pack(_streams(spark, sf_dir))
    return archive.unpack().select(F.col("stream_id").cast("long").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query("SELECT doc_id AS stream_id, TRUE AS ok, CAST(NULL AS VARCHAR) AS reason FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, octet_length(encode(text)) = 0, CASE WHEN octet_length(encode(text)) > 0 THEN 'archive too short' END FROM documents WHERE doc_id % 5 = 0")
def archive_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive the documents, every fifth without its last byte, and verify against the originals."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=64)
    streams = _streams(spark, sf_dir)
    short = F.when((F.col("stream_id") % 5 == 0) & (F.octet_length("data") > 0), F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1)).otherwise(F.col("data"))
    archive.pack(streams.withColumn("data", short))
    return archive.verify(streams).select(F.col("stream_id").cast("long").alias("stream_id"), "ok", "reason")


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(encode(text)) AS digest FROM documents")
def incremental_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two packs one after the other, the second against the blocks of the first, then everything unpacked."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=128)
    streams = _streams(spark, sf_dir)
    archive.pack(streams.where("stream_id % 2 = 0"))
    archive.pack(streams)
    return archive.unpack().select(F.col("stream_id").cast("long").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query(f"WITH {_C} SELECT stream_id, seq, pos, len, sha256(data) AS digest FROM (SELECT * FROM f)")
def split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.fixed(_streams(spark, sf_dir), PIECE).select("stream_id", "seq", "pos", "len", S.sha256_hex(F.col("data")).alias("digest"))


_BYTE = "CAST('0x' || substr(hex({0}), 1, 2) AS INTEGER)"


@query(f"SELECT doc_id, CASE WHEN octet_length(b) > 0 AND hex(b) = repeat(substr(hex(b), 1, 2), CAST(octet_length(b) AS BIGINT)) THEN {_BYTE.format('b')} END AS fill FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)")
def fill_detect_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text."""
    return _streams(spark, sf_dir).select(F.col("stream_id").alias("doc_id"), S.fill_byte(F.col("data")).alias("fill"))


@query(f"WITH {_C} SELECT stream_id, seq, pos, CAST(len AS BIGINT) AS len, CASE WHEN is_fill THEN {_BYTE.format('data')} END AS fill FROM f")
def fill_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    return C.classified(C.fixed(_streams(spark, sf_dir), PIECE)).select("stream_id", "seq", "pos", "len", "fill")


@query(f"WITH {_C} SELECT hash, stream_id, seq, len, hits FROM o WHERE rn = 1")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.owners(_chunks(spark, sf_dir)).select("hash", "owner.stream_id", "owner.seq", "len", "hits")


@query(f"""WITH {_C}, s AS (SELECT CAST((SELECT sum(len) FROM x) AS BIGINT) AS mapped_size, CAST((SELECT coalesce(sum(len), 0) FROM x WHERE is_fill) AS BIGINT) AS fill_size,
       CAST((SELECT sum(len) FROM o WHERE rn = 1) AS BIGINT) AS data_written, (SELECT count(*) FROM x) AS n_chunks) SELECT *, mapped_size - data_written - fill_size AS duplicate, mapped_size / data_written AS ratio FROM s""")
def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pack_stats(_chunks(spark, sf_dir))


@query(f"WITH {_C} SELECT hash, min(len) AS len, count(*) AS hits FROM x WHERE stream_id % 4 = 3 AND hash IS NOT NULL AND hash NOT IN (SELECT hash FROM x WHERE stream_id % 4 < 3 AND hash IS NOT NULL) GROUP BY hash")
def dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    old, new = (C.owners(chunks.where(w)) for w in ("stream_id % 4 < 3", "stream_id % 4 = 3"))
    return C.unseen(new, old).select("hash", "len", "hits")


@query(f"WITH {_C} SELECT hits, count(*) AS n_blocks FROM o WHERE rn = 1 GROUP BY hits")
def hit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hit_histogram(C.owners(_chunks(spark, sf_dir)))


@query(f"WITH {_C} SELECT len, count(*) AS n_blocks FROM o WHERE rn = 1 GROUP BY len")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.length_histogram(C.owners(_chunks(spark, sf_dir)))


@query(f"WITH {_C} SELECT CAST(coalesce(sum(len), 0) AS BIGINT) AS unique_bytes FROM o WHERE hits = 1")
def unique_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unique_bytes(C.owners(_chunks(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_C}, b AS MATERIALIZED (SELECT stream_id, seq, len, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS n FROM o WHERE rn = 1),
       g AS (SELECT stream_id, seq, n, CAST(len AS BIGINT) AS size, CAST(0 AS BIGINT) AS slab, CAST(0 AS BIGINT) AS idx FROM b WHERE n = 1
             UNION ALL SELECT b.stream_id, b.seq, b.n, CASE WHEN g.size + b.len > {SLAB} THEN b.len ELSE g.size + b.len END, CASE WHEN g.size + b.len > {SLAB} THEN g.slab + 1 ELSE g.slab END, CASE WHEN g.size + b.len > {SLAB} THEN 0 ELSE g.idx + 1 END
             FROM g JOIN b ON b.stream_id = g.stream_id AND b.n = g.n + 1)
       SELECT stream_id, seq, slab, idx FROM g""")
def slab_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = C.owners(_chunks(spark, sf_dir)).select(F.col("owner.stream_id").alias("group"), F.col("owner.seq").alias("ord"), "len")
    return R.greedy_slabs(blocks, SLAB).select(F.col("group").alias("stream_id"), F.col("ord").alias("seq"), "slab", "idx")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block's slab is its owner's stream and its place that in it, so that copied passages are runs."""
    chunks = _chunks(spark, sf_dir)
    found = C.located(chunks.select("stream_id", "seq", "len", "fill", "hash"), C.owners(chunks))
    return found.select("stream_id", "seq", "len", F.when(F.col("hash").isNull(), "fill").otherwise("data").alias("kind"), F.col("fill").cast("long").alias("fill"), F.col("owner.stream_id").alias("slab"), F.col("owner.seq").alias("offset"), F.when(F.col("hash").isNotNull(), F.lit(1).cast("long")).alias("nr_entries"))


_RLE = f"""{_C},
    e AS (SELECT x.stream_id, x.seq, x.pos, x.len, CASE WHEN x.is_fill THEN 'fill' ELSE 'data' END AS kind, o.o_stream AS slab, o.o_seq AS off, CASE WHEN x.is_fill THEN ascii(decode(array_slice(f.data, 1, 1))) END AS fill
          FROM x JOIN f USING (stream_id, seq) LEFT JOIN o ON o.stream_id = x.stream_id AND o.seq = x.seq),
    k AS (SELECT *, CASE WHEN kind = lag(kind) OVER w AND ((kind = 'fill' AND fill = lag(fill) OVER w) OR (kind = 'data' AND slab = lag(slab) OVER w AND off = lag(off) OVER w + 1)) THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY stream_id ORDER BY seq) AS run FROM k),
    r AS (SELECT stream_id, CAST(run - 1 AS BIGINT) AS seq, min(kind) AS kind, CAST(min(fill) AS BIGINT) AS fill, arg_min(slab, seq) AS slab, arg_min(off, seq) AS first_entry, CASE WHEN min(kind) = 'data' THEN count(*) END AS nr_entries, min(pos) AS pos, CAST(sum(len) AS BIGINT) AS len FROM g GROUP BY stream_id, run)"""


@query(f"WITH {_RLE} SELECT * FROM r")
def recipe_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rle(_entries(spark, sf_dir)).withColumnRenamed("offset", "first_entry")


@query(f"WITH {_RLE} SELECT stream_id, seq, kind, pos FROM (SELECT stream_id, seq, kind, pos FROM e)")
def running_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.running_positions(_entries(spark, sf_dir)).select("stream_id", "seq", "kind", "pos")


@query(f"WITH {_RLE}, b AS (SELECT DISTINCT o_stream, o_seq, len FROM o) SELECT r.stream_id, r.seq, CAST(sum(b.len) AS BIGINT) AS entry_len FROM r JOIN b ON b.o_stream = r.slab AND b.o_seq >= r.first_entry AND b.o_seq < r.first_entry + r.nr_entries WHERE kind = 'data' GROUP BY r.stream_id, r.seq")
def entry_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each data entry's bytes, from its blocks."""
    chunks = _chunks(spark, sf_dir)
    places = C.owners(chunks).select(F.col("owner.stream_id").alias("slab"), F.col("owner.seq").alias("idx"), "len")
    runs = R.rle(_entries(spark, sf_dir)).where("kind = 'data'").select("stream_id", "seq", "slab", F.explode(F.expr("sequence(offset, offset + nr_entries - 1)")).alias("idx"))
    return runs.join(places, ["slab", "idx"]).groupBy("stream_id", "seq").agg(F.sum("len").alias("entry_len"))


@query(f"WITH {_RLE} SELECT stream_id, seq, kind, fill, slab, first_entry, nr_entries FROM r")
def recipe_vm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes encoded as bytes and run by the machine again."""
    back = R.decoded(R.encoded(R.rle(_entries(spark, sf_dir))))
    return back.select("stream_id", "seq", "kind", "fill", "slab", F.col("offset").alias("first_entry"), "nr_entries")


@query()
def dump_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frequencies(R.traced(R.encoded(R.rle(_entries(spark, sf_dir)))))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS block FROM lineitem), i AS (SELECT block, block - row_number() OVER (ORDER BY block) AS g FROM b), t AS (SELECT min(block) AS s, max(block) + 1 AS e FROM i GROUP BY g), n AS (SELECT *, lag(e, 1, 0) OVER (ORDER BY s) AS before FROM t) SELECT TRUE AS label, s AS \"start\", e AS \"end\" FROM t UNION ALL SELECT FALSE, before, s FROM n WHERE before < s")
def run_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = payloads.provisioned(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block")))
    return B.run_iter(blocks, F.lit(None).cast("long")).where("end is not null")


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two maps of the same device: orders up to 1997, and orders from 1993 with those of first priority moved."""
    orders = table(spark, sf_dir, "orders")
    new = orders.withColumn("to", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey") + 1_000_000).otherwise(F.col("o_custkey")))
    return payloads.block_map(orders.where("o_orderkey % 7 <> 3"), "o_orderkey", "o_custkey"), payloads.block_map(new.where("o_orderkey % 11 <> 5"), "o_orderkey", "to")


_SNAPS = "o AS (SELECT o_orderkey AS block, o_custkey AS d FROM orders WHERE o_orderkey % 7 <> 3), n AS (SELECT o_orderkey AS block, CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1000000 ELSE o_custkey END AS d FROM orders WHERE o_orderkey % 11 <> 5), z AS (SELECT max(o_orderkey) + 10 AS len FROM orders)"
_CHANGE = "d AS (SELECT coalesce(o.block, n.block) AS block, CASE WHEN n.block IS NULL THEN 'removal' WHEN o.block IS NOT NULL AND o.d = n.d THEN 'unchanged' ELSE 'addition' END AS change FROM o FULL OUTER JOIN n ON o.block = n.block)"
_ISLANDS = "i AS (SELECT label, block, block - row_number() OVER (PARTITION BY label ORDER BY block) AS g FROM l), t AS (SELECT label, min(block) AS s, max(block) + 1 AS e FROM i GROUP BY label, g), a AS (SELECT s, e, lag(e, 1, 0) OVER (ORDER BY s) AS before FROM t), w AS (SELECT label, s, e FROM t UNION ALL SELECT '{hole}', before, s FROM a WHERE before < s UNION ALL SELECT '{hole}', max(e), (SELECT len FROM z) FROM t HAVING max(e) < (SELECT len FROM z))"


def _length(spark: SparkSession, sf_dir: str):
    return F.lit(table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] + 10)


@query(f"WITH {_SNAPS}, {_CHANGE} SELECT block, change FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.snapshot_diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_SNAPS}, l AS (SELECT coalesce(o.block, n.block) AS block, CASE WHEN n.block IS NULL THEN 'left' WHEN o.block IS NULL THEN 'right' ELSE 'both' END AS label FROM o FULL OUTER JOIN n ON o.block = n.block), {_ISLANDS.format(hole='neither')} SELECT label, s AS \"start\", e AS \"end\" FROM w")
def dual_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.dual_iter(*_snapshots(spark, sf_dir), _length(spark, sf_dir))


@query(f"WITH {_SNAPS}, {_CHANGE}, l AS (SELECT block, CASE WHEN change = 'addition' THEN 'mapped' ELSE 'unmapped' END AS label FROM d WHERE change <> 'unchanged'), {_ISLANDS.format(hole='ref')} SELECT label AS kind, s * {DATA_BLOCK} AS pos, (e - s) * {DATA_BLOCK} AS len FROM w")
def delta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.delta_chunks(*_snapshots(spark, sf_dir), _length(spark, sf_dir), DATA_BLOCK)


@query(f"""WITH {_RLE}, n AS (SELECT stream_id, CAST(sum(len) AS BIGINT) AS n FROM r GROUP BY stream_id), q AS (SELECT stream_id, n // 4 AS s, n // 2 AS e FROM n UNION ALL SELECT stream_id, n - n // 4, n FROM n)
       SELECT r.stream_id, r.seq, r.kind, greatest(pos, s) AS pos, least(pos + len, e) - greatest(pos, s) AS len, greatest(pos, s) - pos AS skip, (s <= pos AND pos + len <= e) AS whole FROM r JOIN q ON q.stream_id = r.stream_id AND pos < e AND pos + len > s""")
def delta_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delta with two unchanged quarters takes from each document's recipe."""
    old = R.rle(_entries(spark, sf_dir))
    n = old.groupBy("stream_id").agg(F.sum("len").alias("n")).withColumn("q", F.floor(F.col("n") / 4))
    runs = n.select("stream_id", F.explode(F.array(F.struct(F.col("q").alias("start"), F.floor(F.col("n") / 2).alias("end")), F.struct((F.col("n") - F.col("q")).alias("start"), F.col("n").alias("end")))).alias("x")).select("stream_id", "x.*")
    return R.overlay(old, runs, width=1024).select("stream_id", "seq", "kind", "pos", "len", "skip", "whole")


@query(f"WITH {_SNAPS}, b AS (SELECT coalesce(o.block, n.block) AS block, o.block IS NOT NULL AS there, o.d AS w, n.d AS p, n.block IS NOT NULL AS here, coalesce(o.block, n.block) % 13 = 0 AS hole FROM o FULL OUTER JOIN n ON o.block = n.block) SELECT CASE WHEN there AND NOT hole THEN CASE WHEN here AND w = p THEN 'skip' ELSE 'write' END WHEN here THEN 'discard' ELSE 'forward' END AS action, count(*) AS n_blocks, CAST(count(*) * {DATA_BLOCK} AS BIGINT) AS n_bytes FROM b GROUP BY 1")
def thin_restore_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restoring the old map's data, with holes, over the new one's."""
    old, new = _snapshots(spark, sf_dir)
    wanted = old.select("block", F.when(F.col("block") % 13 != 0, F.col("data_block")).alias("value"))
    actions = B.restore_actions(wanted, new.select("block", F.col("data_block").alias("value")))
    return actions.groupBy("action").agg(F.count(F.lit(1)).alias("n_blocks")).withColumn("n_bytes", F.col("n_blocks") * DATA_BLOCK)


@query(f"""WITH {_C}, y AS (SELECT stream_id, seq, pos, CASE WHEN stream_id % 6 = 1 AND seq = 1 THEN sha256(encode('x')) ELSE sha256(data) END AS a FROM f WHERE NOT (stream_id % 6 = 2 AND seq > 2)), v AS (SELECT stream_id, seq, pos, sha256(data) AS a FROM f WHERE NOT (stream_id % 6 = 3 AND seq > 0))
       SELECT coalesce(y.stream_id, v.stream_id) AS stream_id, min(coalesce(y.pos, v.pos)) AS position, arg_min(CASE WHEN v.a IS NULL THEN 'archive longer than input' WHEN y.a IS NULL THEN 'archive too short' ELSE 'data mismatch' END, coalesce(y.pos, v.pos)) AS reason
       FROM y FULL OUTER JOIN v ON y.stream_id = v.stream_id AND y.seq = v.seq WHERE y.a IS NULL OR v.a IS NULL OR y.a <> v.a GROUP BY 1""")
def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first difference of each stream whose archived pieces aren't those of the input."""
    chunks = C.fixed(_streams(spark, sf_dir), PIECE).select("stream_id", "seq", "pos", S.sha256_hex(F.col("data")).alias("digest"))
    archived = chunks.where("not (stream_id % 6 = 2 and seq > 2)").select("stream_id", "seq", "pos", F.when(F.expr("stream_id % 6 = 1 and seq = 1"), S.sha256_hex(F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("digest")).alias("a"))
    given = chunks.where("not (stream_id % 6 = 3 and seq > 0)").select("stream_id", "seq", "pos", F.col("digest").alias("b"))
    both = archived.join(given, ["stream_id", "seq", "pos"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    reason = F.when(F.col("b").isNull(), "archive longer than input").when(F.col("a").isNull(), "archive too short").otherwise("data mismatch")
    return both.groupBy("stream_id").agg(F.min(F.struct("pos", reason.alias("reason"))).alias("x")).select("stream_id", F.col("x.pos").alias("position"), "x.reason")


@query("SELECT source AS name, count(*) AS n_streams, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size FROM documents GROUP BY source ORDER BY 1")
def list_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_streams"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long")).alias("size")).orderBy("name")


@query(f"SELECT count(DISTINCT l_orderkey) AS n_blocks, CAST(count(DISTINCT l_orderkey) * {DATA_BLOCK} AS BIGINT) AS mapped_size FROM lineitem")
def provisioned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By bitmaps: one for each share of the blocks, and their ones counted."""
    bits = table(spark, sf_dir, "lineitem").groupBy(F.expr("bitmap_bucket_number(l_orderkey)").alias("share")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(l_orderkey))").alias("bits"))
    return bits.agg(F.sum(F.expr("bitmap_count(bits)")).alias("n_blocks")).withColumn("mapped_size", F.col("n_blocks") * DATA_BLOCK)


@query("SELECT o_orderkey AS n, CAST(CASE WHEN o_orderkey <= 1 THEN 1 ELSE 1 << CAST(ceil(log2(o_orderkey)) AS INTEGER) END AS BIGINT) AS pow2, o_orderkey & 65535 AS fingerprint, (o_orderkey >> 16) & 1023 AS bucket, lower(o_orderpriority) AS base FROM orders")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(n.alias("n"), S.pow2(n).alias("pow2"), S.fingerprint(n).alias("fingerprint"), S.bucket(n, 1024).alias("bucket"), S.basename(F.concat(F.lit("/a/b/"), F.lower("o_orderpriority"))).alias("base"))


_HUMAN = "CASE " + " ".join(f"WHEN n >= {1 << k} THEN printf('%.2f{u}', floor(n / {float(1 << k)} * 100 + 0.5) / 100)" for k, u in ((40, "T"), (30, "G"), (20, "M"), (10, "K"))) + " ELSE printf('%d', n) END"


@query(f"SELECT o_orderkey, {_HUMAN} AS size, strftime(o_orderdate, '%b %d %y %H:%M') AS time FROM (SELECT *, o_orderkey * o_orderkey * 100 AS n FROM orders)")
def scalar_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * 100
    return table(spark, sf_dir, "orders").select("o_orderkey", S.human_size(n).alias("size"), S.list_time(F.col("o_orderdate")).alias("time"))


@query("SELECT doc_id, sha256(encode(coalesce(text, ''))) AS digest FROM documents")
def zstd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document compressed and decompressed."""
    return _streams(spark, sf_dir).select(F.col("stream_id").alias("doc_id"), S.sha256_hex(S.decompress(S.compress(F.col("data")))).alias("digest"))


@query("SELECT props, min(event_id) AS event_id FROM events WHERE props IS NOT NULL GROUP BY props")
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' payloads as a stream, the first event of each kept over all batches."""
    folder = shared_folder(spark)
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "4").parquet(f"{sf_dir}/event[s].parquet")  # a pattern may be one file or a folder
    ingest.first_seen(rows.select("props", "event_id"), "props", "event_id", f"{folder}/seen", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(rows.select("props", "event_id").schema).parquet(f"{folder}/seen/*")


@query("SELECT conv_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, sha256(b) AS digest FROM (SELECT conv_id, encode(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS b FROM conversations GROUP BY conv_id)")
def segmented_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams of segments, each turn split by itself."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=64)
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("segment"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    archive.pack(turns.withColumn("len", F.octet_length("data").cast("long")))
    return archive.unpack().select(F.col("stream_id").cast("long").alias("conv_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


# ---- the archive's commands


@query(f"""WITH {_C} SELECT CAST((SELECT coalesce(sum(len), 0) FROM x) AS BIGINT) AS total_read, CAST((SELECT coalesce(sum(len), 0) FROM x WHERE is_fill) AS BIGINT) AS fill_size, (SELECT count(*) FROM x) AS n_chunks,
       CAST((SELECT coalesce(sum(len), 0) FROM o WHERE rn = 1) AS BIGINT) AS data_written, CAST((SELECT coalesce(sum(len), 0) FROM o WHERE rn > 1) AS BIGINT) AS duplicate""")
def archive_pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pack reports, in an archive that splits evenly."""
    return Archive(spark, shared_folder(spark)).create(block_size=PIECE, splitter="even").pack(_streams(spark, sf_dir))


@query(f"WITH {_C} SELECT count(*) AS n_blocks, CAST(coalesce(sum(len), 0) AS BIGINT) AS data_bytes FROM o WHERE rn = 1")
def archive_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive's gauges after two packs."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=PIECE, splitter="even")
    streams = _streams(spark, sf_dir)
    archive.pack(streams.where("stream_id % 3 = 0"))
    archive.pack(streams)
    return archive.sizes().select("n_blocks", "data_bytes")


_SIZES = "s AS (SELECT CAST(doc_id AS VARCHAR) AS stream_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)"


@query(f"WITH {_SIZES} SELECT stream_id, size, stream_id AS name, lpad(CAST(size AS VARCHAR), CAST((SELECT max(length(CAST(size AS VARCHAR))) FROM s) AS INTEGER), ' ') AS size_text FROM s")
def archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of an archive, without the time of packing."""
    archive = Archive(spark, shared_folder(spark)).create()
    archive.pack(_streams(spark, sf_dir))
    return archive.list().drop("time")


_BYTES = "d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents)"


@query(f"WITH {_BYTES}, q AS (SELECT *, n // 4 AS q FROM d), w AS (SELECT doc_id, unhex(hex(array_slice(b, 1, q)) || hex(array_slice(b, 1, q)) || repeat('00', q) || hex(array_slice(b, 3 * q + 1, n))) AS v FROM q) SELECT doc_id, CAST(octet_length(v) AS BIGINT) AS n_bytes, sha256(v) AS digest FROM w")
def delta_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's next version, packed as a change of the first: its second quarter is new, its third a hole, the others are as they were."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=256)
    streams = _streams(spark, sf_dir)
    archive.pack(streams)
    n = F.octet_length("data").cast("long")
    q = F.floor(n / 4)
    part = lambda k, kind, pos, size, data: F.struct(F.lit(k).cast("long").alias("segment"), F.lit(kind).alias("kind"), pos.alias("pos"), size.alias("len"), data.alias("data"))
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    parts = F.array(part(0, "ref", zero, q, none), part(1, "mapped", q, q, F.substring(F.col("data"), F.lit(1), q.cast("int"))), part(2, "unmapped", 2 * q, q, none), part(3, "ref", 3 * q, n - 3 * q, none))
    segments = streams.select(F.concat(F.col("stream_id").cast("string"), F.lit("+")).alias("stream_id"), F.col("stream_id").alias("base"), F.explode(parts).alias("x")).select("stream_id", "base", "x.*")
    archive.pack_deltas(segments)
    rows = archive.unpack().where("stream_id like '%+'")
    return rows.select(F.rtrim(F.col("stream_id"), F.lit("+")).cast("long").alias("doc_id"), F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


#: Bytes of the hole in the middle of a stream, and of a target's block, in the queries below.
HOLE, TARGET = 100, 64


def _with_holes(streams: DataFrame) -> DataFrame:
    """Segments of streams that have a hole after their first half."""
    n = F.octet_length("data").cast("long")
    h = F.floor(n / 2)
    part = lambda k, size, data: F.struct(F.lit(k).cast("long").alias("segment"), size.alias("len"), data.alias("data"))
    parts = F.array(part(0, h, F.substring(F.col("data"), F.lit(1), h.cast("int"))), part(1, F.lit(HOLE).cast("long"), F.lit(None).cast("binary")), part(2, n - h, F.substring(F.col("data"), h.cast("int") + 1, (n - h).cast("int"))))
    return streams.select("stream_id", F.explode(parts).alias("x")).select("stream_id", "x.*")


@query(f"""WITH {_BYTES}, c AS (SELECT doc_id, n, n // 2 AS h, CASE WHEN n < 2 THEN 0 ELSE doc_id % 4 END AS c FROM d)
       SELECT CAST(doc_id AS VARCHAR) AS stream_id, c = 0 AS ok, CASE c WHEN 1 THEN 'archive longer than input' WHEN 2 THEN 'expected a hole' WHEN 3 THEN 'data mismatch' END AS reason, CASE c WHEN 1 THEN n + {HOLE - 1} WHEN 2 THEN h WHEN 3 THEN 0 END AS position FROM c""")
def verify_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with holes against their sources: the same, one byte less, zeros for the hole, and another first byte."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=256)
    segments = _with_holes(_streams(spark, sf_dir))
    archive.pack(segments)
    sizes = _streams(spark, sf_dir).select("stream_id", F.when(F.octet_length("data") < 2, 0).otherwise(F.col("stream_id") % 4).alias("c"))
    one = segments.join(sizes, "stream_id")
    data = F.when((F.col("c") == 1) & (F.col("segment") == 2), F.substring(F.col("data"), F.lit(1), F.octet_length("data") - 1))
    data = data.when((F.col("c") == 2) & (F.col("segment") == 1), F.unhex(F.repeat(F.lit("00"), HOLE)))
    data = data.when((F.col("c") == 3) & (F.col("segment") == 0), F.concat(F.lit(b"\x01"), F.substring(F.col("data"), F.lit(2), F.octet_length("data")))).otherwise(F.col("data"))
    one = one.withColumn("data", data).withColumn("len", F.coalesce(F.octet_length("data").cast("long"), F.col("len"))).drop("c")
    return archive.verify(one).select("stream_id", "ok", "reason", "position")


@query(f"""WITH {_BYTES}, k AS (SELECT doc_id, n // 2 AS h, k, k * {TARGET} AS lo, least(k * {TARGET} + {TARGET}, n + {HOLE}) AS hi FROM (SELECT doc_id, n, unnest(range(0, (n + {HOLE + TARGET - 1}) // {TARGET})) AS k FROM d)),
       b AS (SELECT doc_id, k, hi - lo AS n, greatest(0, least(hi, h + {HOLE}) - greatest(lo, h)) AS hole FROM k),
       a AS (SELECT doc_id, CASE WHEN k % 4 IN (1, 2) THEN 'write' ELSE 'skip' END AS action, n - hole AS n FROM b UNION ALL SELECT doc_id, CASE WHEN k % 4 = 2 THEN 'forward' ELSE 'discard' END, hole FROM b)
       SELECT CAST(doc_id AS VARCHAR) AS stream_id, action, CAST(sum(n) AS BIGINT) AS n_bytes FROM a GROUP BY ALL HAVING sum(n) > 0""")
def thin_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams with holes over targets of whose blocks every fourth is wrong and every fourth isn't there: bytes by action."""
    archive = Archive(spark, shared_folder(spark)).create(block_size=256)
    streams = _streams(spark, sf_dir)
    archive.pack(_with_holes(streams))
    h = F.floor(F.octet_length("data") / 2).cast("int")
    whole = streams.withColumn("data", F.concat(F.substring(F.col("data"), F.lit(1), h), F.unhex(F.repeat(F.lit("00"), HOLE)), F.substring(F.col("data"), h + 1, F.octet_length("data"))))
    wrong = F.unhex(F.repeat(F.lit("01"), F.col("len").cast("int")))
    present = C.fixed(whole, TARGET).where("seq % 4 <> 2").select("stream_id", F.col("seq").alias("block"), F.when(F.col("seq") % 4 == 1, wrong).otherwise(F.col("data")).alias("data"))
    targets = whole.select("stream_id", F.octet_length("data").cast("long").alias("size"))
    return archive.restore(present, TARGET, targets).groupBy("stream_id", "action").agg(F.sum("len").alias("n_bytes"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS slab, CAST(octet_length(encode(n_name)) AS BIGINT) AS n_bytes, sha256(encode(n_name)) AS digest FROM nation")
def slab_file_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slab file of the nations' names (25 rows), read by slabs."""
    names = [r[0].encode() for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    path = f"{shared_folder(spark)}.slabs"
    slab_file.write(path, names)
    spark.dataSource.register(slab_file.SlabFile)
    return spark.read.format("slab_file").option("slabsPerPartition", "4").load(path).select("slab", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("digest"))
