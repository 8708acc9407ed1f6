"""WARC archives with a two-level index of captures: sorted keys in compressed blocks, and a sparse directory of the blocks.

An index file is blocks of lines in order of key and, at its end, the directory of its blocks. The table of the files says which
keys each has; it is all that a reader holds."""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shared_folder, sized_join, small_batches, stored

#: Lines of a block of the index, and blocks of an index file, whose directory is held in memory.
BLOCK_LINES, DIRECTORY_ROWS = 1_000, 10_000
#: Payloads of fewer bytes are never stored as revisits.
LEAST_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def url_key(url: str | None) -> str:
    """The url with its host's labels reversed, so that a domain's captures stand together: com,example,www)/path."""
    scheme, found, rest = (url or "").partition("://")
    if not found:
        return url or ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:at].lower().split("."))) + ")" + rest[at:]


def target(url: str) -> str:
    """The url as a header may hold it."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _uuid(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 record: the HTTP response with its payload, or for a revisit its header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uuid(page, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", target(url)))
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _uuid(first, digest)), ("X-Refers-To-Page-Id", str(first))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header, payload (empty for a revisit) and the length of the full payload. ValueError if it is not a whole record."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    own = dict(x.split(": ", 1) for x in lines)
    n = int(own.get("Content-Length", -1))
    if first != "WARC/1.1" or not found or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if own["WARC-Type"] == "response" and (len(payload) != size or "sha256:" + hashlib.sha256(payload).hexdigest() != own["WARC-Payload-Digest"]):
        raise ValueError("the payload is not what was written")
    return own, payload, size


@dataclass
class Archive:
    """files: a stored table with a row for each index file: its first and last key, where its directory is, and its number of blocks. There
    are as many files as tasks wrote them, and one more for every DIRECTORY_ROWS blocks."""

    files: DataFrame


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str = "2000-01-01T00:00:00Z") -> Archive:
    """A record for each row, in files of gzip members (one a record) in the shared folder, and their index.

    Of rows with equal payloads of `least` bytes or more, those with the smallest id are responses and the others revisits
    of it; ids that are null come last, and rows that repeat the smallest id are responses too. Smaller payloads are all
    responses. A null payload is empty; a null url has no target and an empty key. An empty table makes no files.
    A task that runs again writes a file of another name; only files of tasks whose rows were committed are in the index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    copies = (rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                keys, lines = [], []
                for page, url, payload, digest, first in zip(*(batch.column(k).to_pylist() for k in ("page", "url", "payload", "digest", "first")), strict=True):
                    if out is None:
                        system.create_dir(top, recursive=True)
                        out = system.open_output_stream(file_system(name)[1], compression=None)
                    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = pack.compress(record(page, url, payload, digest, first, first is not None and page != first, date)) + pack.flush()
                    out.write(raw)
                    keys.append(url_key(url))
                    lines.append((page, at, len(raw)))
                    at += len(raw)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(x, pa.int64()) for x in zip(*lines, strict=True)), pa.array([name] * len(keys))], ["key", "page", "place", "size", "file"])
        finally:
            if out is not None:
                out.close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        out, at, name, held, directory = None, 0, "", [], []

        def put_block() -> None:
            nonlocal out, at, name
            if out is None:
                name, at = f"{uuid.uuid4().hex}.index", 0
                out = system.open_output_stream(f"{top}/{name}", compression=None)
            raw = packed_lines(held)
            out.write(raw)
            directory.append((held[0][0], held[-1][0], at, len(raw)))
            at += len(raw)
            held.clear()

        def end_file() -> pa.RecordBatch:
            nonlocal out
            raw = packed_lines(directory)
            out.write(raw)
            out.close()
            row = [directory[0][0], directory[-1][1], f"{folder}/{name}", at, len(raw), len(directory)]
            out = None
            directory.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["first", "last", "file", "place", "size", "blocks"])

        try:
            for batch in batches:
                for key, page, place, size, file in zip(*(batch.column(k).to_pylist() for k in ("key", "page", "place", "size", "file")), strict=True):
                    held.append((key, page, file, place, size))
                    if len(held) == BLOCK_LINES:
                        put_block()
                        if len(directory) == DIRECTORY_ROWS:
                            yield end_file()
            if held:
                put_block()
            if directory:
                yield end_file()
        finally:
            if out is not None:
                out.close()

    with scratch(spark) as kept:
        marked = sized_join(rows, stored(copies, "copies"), ["digest"], "left")
        captures = stored(marked.mapInArrow(put, "key string, page long, place long, size long, file string"), "captures")
        ordered = captures.repartitionByRange("key", "page", "file", "place").sortWithinPartitions("key", "page", "file", "place")
        return Archive(kept(ordered.mapInArrow(index, "first string, last string, file string, place long, size long, blocks long"), "files"))


def packed_lines(rows: list) -> bytes:
    return zlib.compress("".join(json.dumps(x) + "\n" for x in rows).encode())


class Reader:
    """Reads ranges of files; keeps the files of one task open."""

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def range(self, path: str, place: int, size: int) -> bytes:
        if path not in self.open:
            if len(self.open) > 64:
                self.close()
            system, own = file_system(path)
            self.open[path] = system.open_input_file(own)
        return self.open[path].read_at(size, place)

    def close(self) -> None:
        for x in self.open.values():
            x.close()
        self.open.clear()

    def lines(self, path: str, place: int, size: int) -> list[list]:
        return [json.loads(x) for x in zlib.decompress(self.range(path, place, size)).splitlines()]

    def record(self, path: str, place: int, size: int) -> tuple[dict[str, str], bytes, int]:
        return parse(zlib.decompress(self.range(path, place, size), 31))


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _row(own: dict[str, str], size: int) -> tuple:
    number = lambda x: None if x is None else int(x)
    return number(own.get("X-Page-Id")), own.get("WARC-Target-URI"), size, own["WARC-Payload-Digest"].removeprefix("sha256:"), own["WARC-Type"], number(own.get("X-Refers-To-Page-Id"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


_BLOCK = "file string, place long, size long"


def _records(blocks: DataFrame, asked: bool) -> DataFrame:
    """The records of blocks (_BLOCK), each by a range of its archive; with asked, those whose key and target are asked for (key, target
    of each row; a block's rows stand together). A block is read once and a record once."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        names = ["file", "place", "size", *(["key", "target"] if asked else [])]
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in names), strict=True))
        try:
            for block, group in groupby(rows, key=lambda r: r[:3]):
                lines = reader.lines(*block)
                wanted: dict[str, set] = {}
                if asked:
                    for r in group:
                        wanted.setdefault(r[3], set()).add(r[4])
                    keys = [x[0] for x in lines]
                    lines = [x for key in wanted for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
                out = []
                for key, _, *place in sorted(lines, key=lambda x: x[2:4]):
                    own, _, n = reader.record(*place)
                    if not asked or own.get("WARC-Target-URI") in wanted[key]:
                        out.append(_row(own, n))
                if out:
                    yield _batch(out)
        finally:
            reader.close()

    return blocks.mapInArrow(get, _READ)


def read(archive: Archive) -> DataFrame:
    """Every record, by the blocks of the index and ranges of the archives; each response's payload is held to its digest."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        try:
            for batch in batches:
                for file, *place in zip(*(batch.column(k).to_pylist() for k in ("file", "place", "size")), strict=True):
                    own = reader.lines(file, *place)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(own)), *(pa.array([x[k] for x in own], pa.int64()) for k in (2, 3))], ["file", "place", "size"])
        finally:
            reader.close()

    return _records(archive.files.mapInArrow(blocks, _BLOCK).repartition(_spread(archive)), False)


def _spread(archive: Archive) -> int:
    """Tasks for the records: a block each, up to some for each core or as many as shuffles have. Their bytes are in the archives, not in
    the shuffle, by whose size Spark would put all into a few."""
    spark = archive.files.sparkSession
    blocks = archive.files.agg(F.sum("blocks")).first()[0] or 0
    return max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", nulls: bool = False) -> DataFrame:
    """The captures of each url asked for, in a row each. A url's key is searched for among the files, then in the directory of each
    file that may have it, then in the blocks that the directory names; records are read by their ranges.

    A url asked for twice is answered once. A null url asks for nothing or, with nulls, for the captures without one. Urls come in order
    of their keys, so that a task needs few directories, one after another; what they ask for is dealt by blocks, however
    many captures one url has. The driver and each task hold the list of the index files, 300 bytes or so each."""
    spark = urls.sparkSession
    small_batches(spark)
    asked = urls.select(F.col(url_col).alias("url")).distinct()
    asked = asked if nulls else asked.where(F.col("url").isNotNull())
    known = sorted(tuple(x) for x in archive.files.select("first", "last", "file", "place", "size").collect())  # one for each task that wrote, and each DIRECTORY_ROWS blocks
    lasts = [x[1] for x in known]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in own], pa.string()), pa.array([None if x is None else target(x) for x in own], pa.string())], ["key", "target"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        held: tuple[int, list, list[str]] = (-1, [], [])
        try:
            for batch in batches:
                rows = []
                for key, uri in zip(*(batch.column(k).to_pylist() for k in ("key", "target")), strict=True):
                    at = bisect.bisect_left(lasts, key)
                    while at < len(known) and known[at][0] <= key:
                        if held[0] != at:
                            directory = reader.lines(*known[at][2:])
                            held = (at, directory, [x[1] for x in directory])
                        for first, _, *place in held[1][bisect.bisect_left(held[2], key) :]:
                            if first > key:
                                break
                            rows.append((known[at][2], *place, key, uri))
                        at += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["file", "place", "size", "key", "target"])
        finally:
            reader.close()

    ordered = asked.mapInArrow(keys, "key string, target string").repartitionByRange("key", "target").sortWithinPartitions("key")
    places = ordered.mapInArrow(search, f"{_BLOCK}, key string, target string")
    return _records(places.repartition(_spread(archive), "file", "place").sortWithinPartitions("file", "place"), True)
