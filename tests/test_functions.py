"""Plain functions against tables and slower versions of themselves."""

import random

import pytest
from pyspark.sql import functions as F

from lamina import catalog
from lamina.functions import recipe_codec as codec
from lamina.functions import scalars as S
from lamina.functions.splitter import READ, even, split, split_slowly
from lamina.operators import chunks, runs
from lamina.operators.recipes import short_runs
from lamina.plans.archive import Archive
from lamina.sources import payloads, slab_file


def test_pow2():
    assert [S.round_pow2(n) for n in (0, 1, 3, 5, 63, 4097, 16385, 2**32)] == [1, 1, 4, 8, 64, 8192, 32768, 2**32]
    assert [S.is_pow2(n) for n in (0, 1, 2, 3, 64)] == [False, True, True, False, True]
    assert S.adjust_block_size(5000) == 8192 and S.adjust_block_size(1 << 30) == 1 << 20
    with pytest.raises(ValueError):
        S.adjust_block_size(8)


def test_fills_of_whole_texts(spark, tmp_path):
    texts = ["real text", "-" * 40 + "x", "-" * 600, "a" * 300 + "b" * 212, "", None, "é" * 300, "b"]
    spark.createDataFrame([(3 * k, x) for k, x in enumerate(texts)] + [(1, " " * 40 + "y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    whole = {r.doc_id: r.fill for r in catalog.fill_detect_whole(spark, str(tmp_path)).collect()}
    assert whole == {0: None, 3: None, 6: 45, 9: None, 12: None, 15: None, 18: None, 21: 98, 1: None}
    own = [(r.stream_id, r.seq, r.len, r.fill) for r in catalog.fill_pieces(spark, str(tmp_path)).collect() if r.fill is not None]
    assert sorted(own) == [(6, 0, 256, 45), (6, 1, 256, 45), (6, 2, 88, 45), (9, 0, 256, 97), (21, 0, 1, 98)]
    made = [("", None), ("a", 97), ("b" * 39, 98), ("a" * 38 + "b", None)]
    rows = spark.createDataFrame(made, "text string, fill int").select("fill", S.fill_byte(F.encode("text", "UTF-8")).alias("got"))
    assert all(r.fill == r.got for r in rows.collect())


def test_signed():
    assert [S.sign_extend(n, 3) for n in range(8)] == [0, 1, 2, 3, -4, -3, -2, -1]
    assert [S.as_signed(n, 4) for n in (-9, -8, -1, 0, 7, 8)] == [None, 8, 15, 0, 7, None]
    assert [S.as_signed(n, 12) for n in (-2049, -2048, 2047, 2048)] == [None, 2048, 2047, None]


@pytest.mark.parametrize("seed", range(6))
def test_split_is_the_slow_one_and_loses_nothing(seed):
    rng = random.Random(seed)
    for _ in range(30):
        n = rng.randint(0, 5000)
        data = rng.choice((rng.randbytes, bytes, lambda k: bytes(rng.choice(b"ab") for _ in range(k))))(n)
        block, read = rng.choice((16, 20, 64, 256, 1024)), rng.choice((READ, 1000, 4096, 64))
        sizes = split(data, block, read)
        assert sizes == split_slowly(data, block, read)
        assert sum(sizes) == n


def test_split_finds_similar_data():
    rng = random.Random(3)
    pattern, data = rng.randbytes(65536), bytearray()
    for _ in range(8):
        data += pattern + rng.randbytes(rng.randint(16, 1023))
    for _ in range(32):
        at, n = rng.randrange(len(data) - 64), rng.randint(16, 63)
        data[at : at + n] = rng.randbytes(n)
    seen, at = {}, 0
    for n in split(bytes(data), 128):
        piece = bytes(data[at : at + n])
        seen[piece] = seen.get(piece, 0) + 1
        at += n
    assert sum(len(p) for p, hits in seen.items() if hits == 1) < len(data) / 4


def test_split_of_a_period_is_its_length():
    period = bytes(range(256)) * 128
    assert set(split(period * 16, 4096)) == {32768}


VECTORS = [([], ""), ([("fill", 0, 1)], "2101"), ([("data", 0, 0, 4)], "d4"), ([("data", 1, 1, 3)], "1061b1d3"), ([("data", 1, 1, 1023)], "1061b1ef3f"), ([("data", 1, 1, 15999)], "1061b1ffe703")]


@pytest.mark.parametrize(("entries", "raw"), VECTORS)
def test_recipe_vectors(entries, raw):
    assert codec.encode(entries).hex() == raw
    assert codec.decode(bytes.fromhex(raw))[0] == entries


def test_recipes_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        entries = []
        for _ in range(rng.randint(0, 50)):
            place = (rng.choice((rng.randint(0, 5), rng.randint(0, 2**31))), rng.randint(0, 2**20 - 1), rng.choice((1, rng.randint(1, 2**20 - 1))))
            entries.append(rng.choice([("fill", rng.randint(0, 255), rng.choice((3, 300, 70000, 2**40))), ("unmapped", rng.choice((3, 300, 70000, 2**40))), ("data", *place), ("partial", 5, 9, *place)]))
        assert codec.decode(codec.encode(entries))[0] == entries


def test_positions_are_noted():
    entries = [("data", k, 5, 1) for k in range(300)]
    assert codec.decode(codec.encode(entries, [10] * 300))[1] == [(1280, 128), (2560, 256)]


def test_registers():
    m = codec.Machine(stack=[[k, 0] for k in range(4)])
    order = lambda: [s for s, _ in m.stack]
    for i, want in ((2, [2, 0, 1, 3]), (3, [3, 2, 0, 1]), (0, [3, 2, 0, 1])):
        m.rot(i)
        assert order() == want
    m = codec.Machine(stack=[[k, 0] for k in range(4)])
    for i, want in ((2, [2, 0, 1, 2]), (3, [2, 2, 0, 1]), (0, [2, 2, 2, 0])):
        m.dup(i)
        assert order() == want


@pytest.mark.parametrize("raw", ["3f", "d", "24010000", "3701000000020000003701000000020000 00"])
def test_bad_recipes(raw):
    raw = raw.replace(" ", "")
    if len(raw) % 2:
        raw = "e" + raw
    with pytest.raises(codec.RecipeError):
        codec.decode(bytes.fromhex(raw))


def test_too_long_a_run():
    with pytest.raises(codec.RecipeError):
        codec.encode([("data", 0, 0, 1 << 20)])


@pytest.mark.parametrize("compressed", [True, False])
def test_slab_file(spark, tmp_path, compressed):
    slabs = [bytes(512), b"\1" * 1024, b"\2" * 1536, b""]
    path = str(tmp_path / "data")
    slab_file.write(path, slabs, compressed)
    spark.dataSource.register(slab_file.SlabFile)
    rows = spark.read.format("slab_file").option("slabsPerPartition", 2).load(path).orderBy("slab").collect()
    assert [bytes(r.data) for r in rows] == slabs
    raw = bytearray((tmp_path / "data").read_bytes())
    raw[-2 if not compressed else 60] ^= 1
    (tmp_path / "bad").write_bytes(raw if compressed else raw[:16] + b"\0" + raw[17:])
    with pytest.raises(Exception, match="damaged|no slab"):
        spark.read.format("slab_file").load(str(tmp_path / "bad")).collect()


def test_runs_of_any_length_are_encoded():
    entries = [("data", 3, 0, (1 << 20) * 3 + 5), ("data", 3, 7, 2)]
    pairs = list(short_runs(entries, [9, 2]))
    assert sum(n for _, n in pairs) == 11
    back, _ = codec.decode(codec.encode([e for e, _ in pairs], [n for _, n in pairs]))
    assert sum(e[3] for e in back[:-1]) == entries[0][3] and back[-1] == entries[1]
    at = 0
    for _, slab, offset, n in back[:-1]:
        assert (slab, offset) == (3, at)
        at += n


def test_option_numbers():
    assert (S.option_number("4096", "block size"), S.option_number(None, "block size")) == (4096, None)
    for bad in ("", "4k", "-1", "1.0", "\u0661"):
        with pytest.raises(ValueError):
            S.option_number(bad, "block size")


def test_even_pieces():
    assert even(b"abcdefg", 3) == [3, 3, 1] and even(b"", 3) == []


def test_derived_metrics(spark):
    stats = spark.createDataFrame([(1000, 300)], "mapped_size long, data_written long")
    row = chunks.derived(stats, F.lit(100), F.lit(4.0)).first()
    assert (row.packed_size, row.ratio, row.bytes_per_second) == (400, 2.5, 250.0)


def test_files_of_any_size_are_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = {"a": bytes(range(256)) * 10, "c": b"xyz"}
    for name, raw in data.items():
        (tmp_path / "in" / name).write_bytes(raw)
    rows = payloads.file_segments(spark, str(tmp_path / "in"), 1000).orderBy("stream_id", "segment").collect()
    got = {name: [(r.segment // 1000, r.pos, r.len, bytes(r.data)) for r in rows if r.stream_id.endswith("/" + name)] for name in data}
    assert got == {"a": [(k, 1000 * k, min(1000, 2560 - 1000 * k), data["a"][1000 * k : 1000 * k + 1000]) for k in range(3)], "c": [(0, 0, 3, b"xyz")]}
    own = Archive(spark, str(tmp_path / "archive")).create(block_size=256)
    own.pack(payloads.file_segments(spark, str(tmp_path / "in"), 1000))
    assert sorted(bytes(r.data) for r in own.unpack().collect()) == sorted(data.values())


def test_devices_are_read_by_their_maps(spark, tmp_path):
    """Only provisioned blocks are read, and of a changed device only what has changed."""
    old = random.Random(1).randbytes(6400)
    new = old[:640] + random.Random(2).randbytes(1280) + old[1920:]
    (tmp_path / "old").write_bytes(old)
    (tmp_path / "new").write_bytes(new)
    maps = [spark.createDataFrame([(k, data, 0) for k, data in rows], "block long, data_block long, time long") for rows in ([(k, k) for k in range(100) if k not in (40, 41)], [(k, 1000 + k if 10 <= k < 30 else k) for k in range(100) if k not in (40, 41, 50)])]
    length = F.lit(100).cast("long")
    own = Archive(spark, str(tmp_path / "archive")).create(block_size=64)
    own.pack(payloads.thin_segments(str(tmp_path / "old"), runs.run_iter(maps[0].select("block"), length), 64, 500).withColumn("stream_id", F.lit("old")))
    changes = runs.delta_chunks(*maps, length, 64)
    read = payloads.delta_segments(str(tmp_path / "new"), changes, 500)
    assert read.agg(F.sum(F.octet_length("data"))).first()[0] == 1280
    own.pack_delta("new", "old", read)
    hole = lambda raw, *ks: bytearray(raw[: ks[0] * 64]) + bytes(64 * len(ks)) + raw[(ks[-1] + 1) * 64 :]
    want = {"old": bytes(hole(old, 40, 41)), "new": bytes(hole(hole(new, 40, 41), 50))}
    assert {r.stream_id: bytes(r.data) for r in own.unpack().collect()} == want


def test_digests_and_ids(spark):
    import hashlib

    from lamina.session import ready

    ready(spark)
    rows = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray()), (3, None)], "k int, data binary")
    got = {r.k: r for r in rows.select("k", *(f(F.col("data")).alias(str(n)) for n, f in ((32, S.blake2b_256), (8, S.blake2b_64), (4, S.blake2b_32))), S.stream_id(F.col("data")).alias("id")).collect()}
    for k, raw in ((1, b"abc"), (2, b"")):
        assert all(bytes(got[k][str(n)]) == hashlib.blake2b(raw, digest_size=n).digest() for n in (32, 8, 4))
        assert S.hash_le_u64(raw) == int.from_bytes(got[k]["8"], "little")
    assert got[3]["32"] is None
    assert len({r.id for r in got.values()}) == 3 and all(len(r.id) == 16 and int(r.id, 16) >= 0 for r in got.values())
