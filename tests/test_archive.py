"""The archive's commands on small streams."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import recipes, runs
from lamina.plans.archive import Archive, ArchiveError
from lamina.streaming.ingest import first_seen, ingest


@pytest.fixture
def archive(spark, tmp_path):
    return Archive(spark, str(tmp_path / "archive")).create(block_size=4096)


def streams(spark, **data):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "stream_id string, data binary")


def test_create(spark, archive):
    assert archive.config()["block_size"] == 4096
    with pytest.raises(ArchiveError):
        archive.create()
    with pytest.raises(ArchiveError):
        Archive(spark, archive.root + "x").config()


def test_statistics_of_patterns(spark, archive):
    rng = random.Random(1)
    size = 200_010
    got = archive.pack(streams(spark, random=rng.randbytes(size))).first()
    assert (got.total_read, got.fill_size, got.data_written) == (size, 0, size)
    got = archive.pack(streams(spark, fill=b"\7" * size)).first()
    assert (got.total_read, got.fill_size, got.data_written) == (size, size, 0)
    got = archive.pack(streams(spark, period=bytes(range(256)) * 128 * 8)).first()
    assert (got.total_read, got.fill_size, got.data_written) == (32768 * 8, 0, 32768)


def test_round_trip_and_verify(spark, archive):
    rng = random.Random(2)
    a, b = rng.randbytes(70_000), rng.randbytes(50_000)
    data = {"a": a, "b": a[:30_000] + b + a[30_000:], "empty": b"", "zeros": bytes(9_000), "tail": a + b"x"}
    archive.pack(streams(spark, **data))
    again = archive.pack(streams(spark, **data)).first()
    assert (again.n_chunks, again.data_written) == (0, 0)
    assert {r.stream_id: bytes(r.data) for r in archive.unpack().collect()} == data
    assert all(r.ok for r in archive.verify(streams(spark, **data)).collect())
    other = {"a": a[:100] + bytes([a[100] ^ 1]) + a[101:], "b": data["b"][:-1], "empty": b"x", "zeros": bytes(9_001), "new": b"x"}
    found = {r.stream_id: r.reason for r in archive.verify(streams(spark, **other)).collect()}
    assert found == {"a": "data mismatch", "b": "archive longer than input", "empty": "archive too short", "zeros": "archive too short", "new": "not archived"}
    assert [r.name for r in archive.list().collect()] == sorted(data)
    assert archive.dump("b").count() > 0
    assert archive.sizes().first().n_blocks > 0
    with pytest.raises(ArchiveError):
        archive.dump("none")


def test_holes(spark, archive):
    rows = [("s", 0, 5_000, bytearray(b"ab" * 2_500)), ("s", 1, 300, None), ("s", 2, 5_000, bytearray(b"ab" * 2_500))]
    archive.pack(spark.createDataFrame(rows, "stream_id string, segment long, len long, data binary"))
    whole = bytes(rows[0][3]) + bytes(300) + bytes(rows[2][3])
    assert bytes(archive.unpack().first().data) == whole
    assert archive.verify(streams(spark, s=whole)).first().reason == "expected a hole"


def test_delta(spark, archive):
    rng = random.Random(4)
    old, new = rng.randbytes(60_000), rng.randbytes(10_000)
    archive.pack(streams(spark, old=old))
    parts = [(0, "ref", 0, 20_000, None), (1, "mapped", 20_000, 10_000, bytearray(new)), (2, "ref", 30_000, 7_777, None), (3, "unmapped", 37_777, 2_223, None), (4, "ref", 40_000, 20_000, None)]
    archive.pack_delta("new", "old", spark.createDataFrame(parts, "segment long, kind string, pos long, len long, data binary"))
    want = old[:20_000] + new + old[30_000:37_777] + bytes(2_223) + old[40_000:]
    assert {r.stream_id: bytes(r.data) for r in archive.unpack().collect()} == {"old": old, "new": want}
    archive.pack_delta("newer", "new", spark.createDataFrame([(0, "ref", 0, 60_000, None)], "segment long, kind string, pos long, len long, data binary"))
    assert bytes(archive.unpack(["newer"]).first().data) == want


def test_ingest(spark, archive, tmp_path):
    data = {f"s{k}": random.Random(k % 3).randbytes(9_000) for k in range(6)}
    for k in range(3):
        streams(spark, **dict(list(data.items())[2 * k : 2 * k + 2])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("stream_id string, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(rows, archive, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r.stream_id: bytes(r.data) for r in archive.unpack().collect()} == data
    assert archive.sizes().first().data_bytes == 27_000


def bits(spark, text):
    return spark.createDataFrame([(k,) for k, x in enumerate(text) if x == "1"], "block long")


@pytest.mark.parametrize("share", [2, 3, 1 << 16])
@pytest.mark.parametrize(("text", "want"), [("", []), ("000", [(False, 0, 3)]), ("0110001", [(False, 0, 1), (True, 1, 3), (False, 3, 6), (True, 6, 7)]), ("011000100", [(False, 0, 1), (True, 1, 3), (False, 3, 6), (True, 6, 7), (False, 7, 9)])])
def test_runs(spark, text, want, share):
    got = runs.run_iter(bits(spark, text), F.lit(len(text)).cast("long"), share).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("share", [2, 1 << 16])
@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("000", "000", [("neither", 0, 3)]),
        ("0110001", "0110001", [("neither", 0, 1), ("both", 1, 3), ("neither", 3, 6), ("both", 6, 7)]),
        ("010000100", "001000101", [("neither", 0, 1), ("left", 1, 2), ("right", 2, 3), ("neither", 3, 6), ("both", 6, 7), ("neither", 7, 8), ("right", 8, 9)]),
    ],
)
def test_dual_runs(spark, left, right, want, share):
    got = runs.dual_iter(bits(spark, left), bits(spark, right), F.lit(len(left)).cast("long"), share).orderBy("start").collect()
    assert [tuple(r) for r in got] == want


def test_rle_in_shares(spark):
    rng = random.Random(8)
    rows = []
    for stream in "ab":
        for seq in range(120):
            kind = rng.choice(("fill", "data", "data", "unmapped", "partial") if stream == "a" else ("fill", "data"))
            rows.append((stream, seq, kind, rng.randint(0, 1) if kind == "fill" else None, 0 if kind in ("data", "partial") else None, seq if kind in ("data", "partial") else None, 1 if kind in ("data", "partial") else None, rng.randint(1, 9)))
    entries = spark.createDataFrame(rows, "stream_id string, seq long, kind string, fill long, slab long, offset long, nr_entries long, len long")
    want, pos = [], {}
    for stream, _, kind, fill, slab, offset, n, size in rows:
        last = want[-1] if want else None
        at = pos.get(stream, 0)
        pos[stream] = at + size
        if last and last[0] == stream and kind != "partial" and last[2] == kind and (kind != "fill" or last[3] == fill) and (kind != "data" or last[5] + last[6] == offset):
            want[-1] = (*last[:6], last[6] + 1 if n else None, last[7], last[8] + size)
        else:
            want.append((stream, last[1] + 1 if last and last[0] == stream else 0, kind, fill, slab, offset, n, at, size))
    for share in (1, 2, 7, 1 << 24):
        assert [tuple(r) for r in recipes.rle(entries, share).orderBy("stream_id", "seq").collect()] == want


def test_first_seen_after_a_failure(spark, tmp_path):
    """A crash between a batch's write and its commit: the batch runs again."""
    for k, rows in enumerate(([("a", 1), ("b", 2)], [("b", 3), ("c", 4)])):
        spark.createDataFrame(rows, "key string, n long").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        rows = spark.readStream.schema("key string, n long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        first_seen(rows, "key", "n", store, checkpoint).awaitTermination()
        return sorted((r.key, r.n) for r in spark.read.parquet(store).collect())

    want = run()
    assert [k for k, _ in want] == ["a", "b", "c"]
    last = max(int(p.name) for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "checkpoint/commits").glob(f"*{last}*"):
        p.unlink()
    assert run() == want


def test_splitters_and_pruned_reads(spark, tmp_path, monkeypatch):
    from lamina.plans import archive as module

    monkeypatch.setattr(module, "SLAB_BYTES", 1_000)
    monkeypatch.setattr(module, "SHARE_SLABS", 2)
    own = Archive(spark, str(tmp_path / "even")).create(block_size=256, splitter="even")
    data = {f"s{k}": random.Random(k).randbytes(5_000 + k) for k in range(5)}
    own.pack(streams(spark, **data))
    assert {r.len for r in own.pieces().collect()} == {256, *(len(x) % 256 for x in data.values())}
    assert {r.stream_id: bytes(r.data) for r in own.unpack(["s3", "s1"]).collect()} == {k: data[k] for k in ("s1", "s3")}
    assert own.blocks().select("share").distinct().count() > 2
    with pytest.raises(ArchiveError):
        Archive(spark, str(tmp_path / "x")).create(splitter="none")


def test_restore_checks_sizes(spark, archive):
    archive.pack(streams(spark, a=b"x" * 300))
    none = spark.createDataFrame([], "stream_id string, block long, data binary")
    with pytest.raises(ArchiveError):
        archive.restore(none, 64, spark.createDataFrame([("a", 301)], "stream_id string, size long"))
    rows = archive.restore(none, 64, spark.createDataFrame([("a", 300)], "stream_id string, size long")).orderBy("pos").collect()
    assert b"".join(bytes(r.data) for r in rows) == b"x" * 300 and {r.action for r in rows} == {"write"}


def test_verify_names_places(spark, archive):
    raw = random.Random(5).randbytes(200_000)
    archive.pack(streams(spark, a=raw))
    row = archive.verify(streams(spark, a=raw[:150_000] + bytes([raw[150_000] ^ 1]) + raw[150_001:])).first()
    assert row.reason == "data mismatch" and 0 <= 150_000 - row.position <= 16 * 4096 and row.verified == row.position
    holes = spark.createDataFrame([("a", 0, 200_000, None)], "stream_id string, segment long, len long, data binary")
    assert archive.verify(holes).first().reason == "expected data"
