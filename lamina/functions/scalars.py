"""Scalar functions: digests, byte tests, block arithmetic, text of sizes and times."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

MAX_BLOCK = 1 << 20
SECTOR = 512
VERSION = "0.1"


@arrow_udf(BinaryType())
def blake2b_256(values: pa.Array) -> pa.Array:
    """The 32-byte digest that names a block; null stays null."""
    return pa.array([None if not x.is_valid else hashlib.blake2b(x.as_buffer(), digest_size=32).digest() for x in values], pa.binary())


@arrow_udf(BinaryType())
def blake2b_64(values: pa.Array) -> pa.Array:
    return pa.array([None if not x.is_valid else hashlib.blake2b(x.as_buffer(), digest_size=8).digest() for x in values], pa.binary())


@arrow_udf(BinaryType())
def blake2b_32(values: pa.Array) -> pa.Array:
    return pa.array([None if not x.is_valid else hashlib.blake2b(x.as_buffer(), digest_size=4).digest() for x in values], pa.binary())


def hash_le_u64(value: bytes) -> int:
    """The 8-byte digest of a value as a little-endian number."""
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little")


@arrow_udf(BinaryType())
def compress(values: pa.Array) -> pa.Array:
    import zstandard

    c = zstandard.ZstdCompressor()
    return pa.array([None if not x.is_valid else c.compress(x.as_buffer()) for x in values], pa.binary())


@arrow_udf(BinaryType())
def decompress(values: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([None if not x.is_valid else d.decompress(x.as_buffer()) for x in values], pa.binary())


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def fill_byte(data: Column) -> Column:
    """The byte that a value consists of; null if it has two different ones, or none."""
    first = F.substring(F.hex(data), 1, 2)
    return F.when((F.octet_length(data) > 0) & (F.hex(data) == F.repeat(first, F.octet_length(data))), F.conv(first, 16, 10).cast("int"))


def round_pow2(n: int) -> int:
    """The least power of two that is n or more; 1 for 0."""
    return 1 << max(n - 1, 0).bit_length()


def is_pow2(n: int) -> bool:
    return n > 0 and n & (n - 1) == 0


def pow2(n: Column) -> Column:
    """round_pow2 of a long of 2**62 at most, by integers alone."""
    m = F.greatest(n - 1, F.lit(0))
    for k in (1, 2, 4, 8, 16, 32):
        m = m.bitwiseOR(F.shiftright(m, k))
    return m + 1


def adjust_block_size(n: int) -> int:
    """A power of two, of 1 MiB at most; splitting needs 16 at least."""
    if n < 16:
        raise ValueError(f"block size {n} is under 16")
    return min(round_pow2(n), MAX_BLOCK)


def sign_extend(x: int, bits: int) -> int:
    """The number that the low bits stand for in two's complement."""
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def as_signed(delta: int, bits: int) -> int | None:
    """delta's low bits if it fits, else null."""
    return delta & ((1 << bits) - 1) if -(1 << (bits - 1)) <= delta < 1 << (bits - 1) else None


def fingerprint(h: Column) -> Column:
    """The low 16 bits of a hash."""
    return h.bitwiseAND(F.lit(0xFFFF))


def bucket(h: Column, buckets: int) -> Column:
    """The bucket of a hash among a power of two of them, from the bits above the fingerprint."""
    return F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(buckets - 1))


def human_size(n: Column) -> Column:
    """A size with its binary unit and two decimals."""
    out = F.format_string("%d", n)
    for power, unit in ((10, "K"), (20, "M"), (30, "G"), (40, "T")):
        out = F.when(n >= 1 << power, F.format_string(f"%.2f{unit}", n / F.lit(float(1 << power)))).otherwise(out)
    return out


def option_number(text: str | None, name: str) -> int | None:
    """The number that an option's text stands for; none without a text. Only digits are a number."""
    if text is None:
        return None
    if not (text.isascii() and text.isdigit()):
        raise ValueError(f"couldn't parse {name}: {text!r}")
    return int(text)


def list_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd yy HH:mm")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stream_id(*cols: Column) -> Column:
    """16 lower-case hex digits, from content, so that packing again gives the same id."""
    return F.lpad(F.lower(F.hex(F.xxhash64(*cols))), 16, "0")
