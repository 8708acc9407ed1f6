"""Similarity join on word shingles: MinHash candidates, pruned by what their values make likely, the rest verified exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, Kept, arrow_pass, give_back, packed, row_key, scratch, sized_join, small_batches, stored, unpacked
from .components import components

WORDS = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: A pair at the least similarity shares no band with a probability of (1 - 0.8 ** ROWS) ** BANDS, under 5e-8.
BANDS, ROWS = 32, 4
#: MinHash values compared in a step, and the probability of reaching LEAST under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-8
#: Members and bytes of text of a block, about: a group of candidates is met in pairs of blocks, so that no task holds more than two.
BLOCK, BLOCK_BYTES = 256, 8 << 20
_HASHES = BANDS * ROWS
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, _HASHES, dtype=np.uint64)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class _Hashes(Kept):
    """Words' hashes; long words' are not kept."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            self.room()
            self.add({word: value})
        return value


_hashes = _Hashes(8 << 20)


def shingles(text: str) -> np.ndarray:
    """The sorted set of 64-bit hashes of WORDS consecutive words (split at ASCII white space, A-Z in lower case); of all words where there are fewer."""
    words = text.encode().lower().split()
    own = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(words))
    if not n:
        return own
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ own[k : len(words) - n + 1 + k]) * _MIX[0]
        out ^= out >> np.uint64(29)
    out *= _MIX[1]
    return np.unique(out ^ (out >> np.uint64(32)))


def exact_sets(texts: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Each text's set of shingles, as sorted numbers that stand for the words themselves: equal shingles of any of the texts have
    one number. And how many numbers there are. The texts are words with a space between."""
    known: dict[bytes, int] = {b"": 0}
    rows = []
    for text in texts:
        words = text.split(b" ")
        row = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        rows.append(row if len(row) >= WORDS else np.concatenate((row, np.zeros(WORDS - len(row), np.int64))))  # 0 is no word
    counts = [len(r) - WORDS + 1 for r in rows]
    ids = np.concatenate([r[:n] for r, n in zip(rows, counts, strict=True)])
    for k in range(1, WORDS):  # ranks of pairs of ranks
        ids = np.unique(ids * np.int64(len(known)) + np.concatenate([r[k : n + k] for r, n in zip(rows, counts, strict=True)]), return_inverse=True)[1]
    ends = np.cumsum([0, *counts])
    return [np.unique(ids[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], int(ids.max(initial=-1)) + 1


def spaced(text: str) -> bytes:
    """The text's words, A-Z in lower case, with a space between."""
    return b" ".join(text.encode().lower().split())


def signature(items: np.ndarray) -> np.ndarray:
    """The least of each of the hash functions over the set."""
    out = np.empty(_HASHES, np.uint32)
    for k in range(0, _HASHES, 8):
        out[k : k + 8] = (((items[None, :] ^ _ADD[k : k + 8, None]) * _MULTIPLY[k : k + 8, None]) >> np.uint64(32)).min(1)
    return out


def least_matches(k: int) -> int:
    """The fewest matches among k values with which the similarity, uniform beforehand, reaches LEAST with TOLERANCE or more:
    its distribution is then a beta one, whose tail is the binomial sum below."""
    p, total = LEAST[0] / LEAST[1], 0.0
    for m in range(k + 1):
        total += math.comb(k + 1, m) * p**m * (1 - p) ** (k + 1 - m)
        if total >= TOLERANCE:
            return m
    return k


_NEEDED = [least_matches(k) for k in range(STEP, _HASHES + 1, STEP)]


def likely(values: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which of the pairs are still likely when all their values have been compared, a step at a time."""
    left, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for k, needed in enumerate(_NEEDED):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (values[one[left], part] == values[two[left], part]).sum(1)
        keep = matches >= needed
        left, matches = left[keep], matches[keep]
    return left


def _profile(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column("text").to_pylist()
    sets = [shingles(x or "") for x in texts]
    sigs = [signature(s) if len(s) else None for s in sets]
    bands: list[np.ndarray | None] = []
    for s in sigs:
        if s is None:
            bands.append(None)
            continue
        key = np.zeros(BANDS, np.uint64)
        for column in s.reshape(BANDS, ROWS).astype(np.uint64).T:
            key = (key ^ column) * _MIX[0]
            key ^= key >> np.uint64(29)
        bands.append((key * _MIX[1]).view(np.int64))
    names = ["_k1", "_k2", "id"]
    return pa.RecordBatch.from_arrays(
        [batch.column(k) for k in names] + [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()), pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([len(x or "") for x in texts], pa.int64())],
        [*names, "cid", "sig", "bands", "chars"],
    )


def _cells(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in their first columns, across batches."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:width]):
        yield key, list(group)


def _flushed(rows: Iterator[tuple], schema: pa.Schema, most: int = 4_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    give_back()


_CELL = [("band", pa.int32()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]
_FOUND = pa.schema([*_CELL, ("cid", pa.binary()), ("size", pa.int64()), ("near", pa.binary())])
_LINKED = pa.schema([("cid", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell its members that have a likely partner, with the partners' places among them; a pair counts in the first
    band that it shares, and nowhere else."""

    def rows() -> Iterator[tuple]:
        for (band, key, i, j), group in _cells(batches, 4):
            group.sort(key=lambda r: r[5])
            block = np.array([r[4] for r in group])
            values = np.frombuffer(b"".join(r[7] for r in group), np.uint32).reshape(-1, _HASHES)
            if i == j:
                one, two = np.triu_indices(len(group), 1)
            else:
                a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
                one, two = np.repeat(a, len(b)), np.tile(b, len(a))
            keep = likely(values, one, two)
            one, two = one[keep], two[keep]
            first = np.empty(len(one), np.int64)
            for k in range(0, len(one), 20_000):
                same = (values[one[k : k + 20_000]] == values[two[k : k + 20_000]]).reshape(-1, BANDS, ROWS).all(2)
                first[k : k + 20_000] = np.where(same.any(1), same.argmax(1), -1)
            one, two = one[first == band], two[first == band]
            used = np.unique(np.concatenate((one, two)))
            place = np.zeros(len(group), np.int32)
            place[used] = np.arange(len(used))
            order = np.argsort(one, kind="stable")
            one, two = one[order], two[order]
            edge = np.searchsorted(one, used, side="left"), np.searchsorted(one, used, side="right")
            for x, lo, hi in zip(used.tolist(), *map(np.ndarray.tolist, edge), strict=True):
                yield band, key, i, j, group[x][5], group[x][6], place[two[lo:hi]].tobytes()

    return _flushed(rows(), _FOUND)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell its members that have a link: how many documents they are linked to in it, and the least member that
    links lead to. Sets are compared by their shingles' words."""

    def rows() -> Iterator[tuple]:
        for _, group in _cells(batches, 4):
            group.sort(key=lambda r: r[4])
            sets, numbers = exact_sets([r[7] for r in group])
            sizes = np.array([len(s) for s in sets])
            inside = np.zeros(numbers, np.int64)
            links, root = [0] * len(group), list(range(len(group)))

            def top(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, row in enumerate(group):
                near = np.frombuffer(row[6], np.int32)
                near = near[np.minimum(sizes[near], sizes[x]) * LEAST[1] >= np.maximum(sizes[near], sizes[x]) * LEAST[0]]
                if not len(near):
                    continue
                inside[sets[x]] = 1
                common = np.add.reduceat(inside[np.concatenate([sets[y] for y in near])], np.cumsum([0, *sizes[near][:-1]]))
                inside[sets[x]] = 0
                for y in near[LEAST[1] * common >= LEAST[0] * (sizes[near] + sizes[x] - common)].tolist():
                    links[x] += group[y][5]
                    links[y] += row[5]
                    a, b = sorted((top(x), top(y)))
                    root[b] = a
            for x, row in enumerate(group):
                if links[x]:
                    yield row[4], links[x], group[top(x)][4]

    return _flushed(rows(), _LINKED)


def _dealt(df: DataFrame, run: Callable, schema: pa.Schema) -> DataFrame:
    """run over df's cells: each of them whole and in one task, which reads them one after another."""
    keys = [n for n, _ in _CELL]
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two stored tables. Rows: _k1, _k2, id, cid of each row (cid: its set of shingles; null without words). Classes: cid, root,
    rep (the least id of the component), links and pick (the row that stands for it) of those that have copies or links.

    Rows with equal sets are one class and are counted, not paired; such sets are told apart by 128 bits. Classes that share a band are
    a group; groups with the same members are met once, and larger ones in pairs of blocks. Likely pairs are verified on their words."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    with scratch(docs.sparkSession) as kept:
        rows = arrow_pass(docs.select(*row_key(F.col(id_col), text), F.col(id_col).alias("id"), text.alias("text")), _profile, f"_k1 long, _k2 long, id {dict(docs.dtypes)[id_col]}, cid binary, sig binary, bands array<long>, chars long")
        rows = stored(rows, "profiles")
        order = F.struct(F.col("id").isNull().alias("n"), "id", *KEY)
        kinds = stored(rows.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("pick"), F.first("bands").alias("bands"), F.max("chars").alias("chars")), "kinds")
        shared = kinds.select("cid", "size", "chars", F.posexplode("bands").alias("band", "key"))
        groups = shared.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("cid")).alias("x")).where("n > 1")
        groups = groups.groupBy("n", "x").agg(F.min(F.struct("band", "key")).alias("g"), F.max("chars").alias("chars"))
        groups = stored(groups.select("g.band", "g.key", F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.col("n"), F.ceil(F.col("chars") / BLOCK_BYTES))).cast("int").alias("blocks")), "groups")
        members = sized_join(shared.drop("chars"), groups, ["band", "key"])
        members = stored(members.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")), "members")
        wanted = stored(members.select("cid").distinct(), "member-ids")
        sigs = stored(sized_join(rows.where("cid is not null").select("cid", "sig"), wanted, ["cid"], "left_semi").dropDuplicates(["cid"]), "signatures")
        cells = members.join(sigs, "cid").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cells = cells.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cid", "size", "sig")
        found = stored(_dealt(cells, _prune, _FOUND), "likely")
        asked = stored(kinds.join(found.select("cid").distinct(), "cid").select("cid", "pick._k1", "pick._k2"), "asked")
        texts = sized_join(docs.select(*row_key(F.col(id_col), text), text.alias("text")), asked, KEY).dropDuplicates(["cid"])
        words = stored(arrow_pass(texts.select("cid", "text"), lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([spaced(x or "") for x in b.column(1).to_pylist()], pa.binary())], ["cid", "words"]), "cid binary, words binary"), "words")
        linked = stored(_dealt(found.join(words, "cid").select("band", "key", "i", "j", "cid", "size", "near", "words"), _verify, _LINKED), "links")
        roots = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        sums = linked.groupBy("cid").agg(F.sum("links").alias("links"))
        known = kinds.select("cid", "size", "pick").join(sums, "cid", "left").where("size > 1 or links is not null").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        known = stored(known, "known")
        heads = stored(known.groupBy("root").agg(F.min("pick").alias("pick")), "heads")
        out = sized_join(known.drop("pick"), heads, ["root"]).select("cid", "root", "pick", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
        return kept(rows.select(*KEY, "id", "cid"), "rows"), kept(out, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id (the least id among the rows that links lead to, its own without any) and n_links (the other rows whose similarity
    is LEAST or more) of each row.

    A null text, or one without words, has no links, and is in no one's class. Null ids are kept, and come last where an id is chosen;
    repeated rows are copies of each other. An empty table gives no rows. Other columns are left out."""
    rows, found = classes(docs, id_col, text_col)
    marked = sized_join(rows, found.select("cid", F.col("pick.id").alias("_class"), "links", F.lit(True).alias("_in")), ["cid"], "left")
    return marked.select(F.col("id").alias(id_col), F.when(F.col("_in"), F.col("_class")).otherwise(F.col("id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class, that of the least id, all columns as they were, whatever their names; rows in no class stay.

    A null text, or one without words, is in no class. Null ids come last where a row is chosen. Of rows that share id and text one stays, and
    which of them is not defined where their other columns differ. An empty table gives an empty one."""
    with scratch(docs.sparkSession) as kept:
        rows, found = classes(docs, id_col, text_col)
        inside = sized_join(rows, found.select("cid", "pick"), ["cid"])
        flags = inside.groupBy(*KEY).agg(F.max(((F.col("pick._k1") == F.col("_k1")) & (F.col("pick._k2") == F.col("_k2"))).cast("int")).alias("_stays"), F.count(F.lit(1)).alias("_n"))
        flags = kept(flags.where("_stays = 0 or _n > 1").select(*KEY, "_stays"), "flags")
    marked = sized_join(packed(docs, id_col, text_col), flags, KEY, "left")
    again = marked.where("_stays = 1").dropDuplicates(KEY)  # rows repeated in full
    return unpacked(marked.where("_stays is null").unionByName(again))
