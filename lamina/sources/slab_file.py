"""Slab files: a header, then records of a magic number, a length, a checksum and a payload that may be compressed.

``spark.read.format("slab_file").load(path)`` reads one: a row for each slab, a partition for each run of slabs."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format.
FILE_MAGIC, SLAB_MAGIC, FORMAT_VERSION, COMPRESSED = 0xB927F96A6B611180, 0x20565137A3100A7C, 0, 1
_HEADER, _RECORD = struct.Struct("<QII"), struct.Struct("<QQ8s")


class SlabError(ValueError):
    """A file that isn't a slab file, or a slab that is damaged."""


def _open(path: str, mode: str):
    from pyarrow import fs

    system, own = (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_output_stream(own, compression=None) if mode == "w" else system.open_input_file(own)


def write(path: str, slabs: Iterable[bytes], compressed: bool = True) -> list[int]:
    """The slabs in their order, and beside the file their offsets, which are returned."""
    import zstandard

    pack = zstandard.ZstdCompressor().compress if compressed else bytes
    offsets, at = [], _HEADER.size
    with _open(path, "w") as f:
        f.write(_HEADER.pack(FILE_MAGIC, FORMAT_VERSION, COMPRESSED if compressed else 0))
        for slab in slabs:
            raw = pack(slab)
            f.write(_RECORD.pack(SLAB_MAGIC, len(raw), hashlib.blake2b(raw, digest_size=8).digest()) + raw)
            offsets.append(at)
            at += _RECORD.size + len(raw)
    with _open(path + ".offsets", "w") as f:
        f.write(struct.pack(f"<{len(offsets)}Q", *offsets))
    return offsets


def flags(f) -> int:
    raw = f.read_at(_HEADER.size, 0)
    if len(raw) < _HEADER.size or (head := _HEADER.unpack(raw))[0] != FILE_MAGIC:
        raise SlabError("not a slab file")
    if head[1] != FORMAT_VERSION or head[2] > COMPRESSED:
        raise SlabError(f"version {head[1]}, flags {head[2]}")
    return head[2]


def scan_offsets(f) -> list[int]:
    """Each record's place, from the records' lengths alone; the sidecar is only a shortcut."""
    out, at, size = [], _HEADER.size, f.size()
    while at < size:
        magic, n, _ = _RECORD.unpack(f.read_at(_RECORD.size, at))
        if magic != SLAB_MAGIC:
            raise SlabError(f"no slab at {at}")
        out.append(at)
        at += _RECORD.size + n
    return out


def read_slab(f, at: int, compressed: bool) -> bytes:
    raw = f.read_at(_RECORD.size, at)
    if len(raw) < _RECORD.size or (head := _RECORD.unpack(raw))[0] != SLAB_MAGIC:
        raise SlabError(f"no slab at {at}")
    data = f.read_at(head[1], at + _RECORD.size)
    if hashlib.blake2b(data, digest_size=8).digest() != head[2]:
        raise SlabError(f"the slab at {at} is damaged")
    if not compressed:
        return data
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


class _Part(InputPartition):
    def __init__(self, first: int, offsets: list[int]):
        self.first, self.offsets = first, offsets


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.slabs = options["path"], int(options.get("slabsPerPartition", 16))

    def partitions(self) -> list[_Part]:
        with _open(self.path, "r") as f:
            flags(f)
            offsets = scan_offsets(f)
        return [_Part(k, offsets[k : k + self.slabs]) for k in range(0, len(offsets), self.slabs)]

    def read(self, part: _Part) -> Iterator[tuple[int, int, bytes]]:
        with _open(self.path, "r") as f:
            packed = flags(f) == COMPRESSED
            for k, at in enumerate(part.offsets):
                yield part.first + k, at, read_slab(f, at, packed)


class SlabFile(DataSource):
    """Register with spark.dataSource.register(SlabFile)."""

    @classmethod
    def name(cls) -> str:
        return "slab_file"

    def schema(self) -> str:
        return "slab int, place long, data binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
