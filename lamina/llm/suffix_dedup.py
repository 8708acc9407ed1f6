"""Removal of long byte strings that occur again anywhere, with suffix arrays built group by group.

Every window of a text stands with the least k-gram in it, its anchor: equal windows have equal anchors at equal places, so
that they meet. The bytes about an anchor are cut into blocks aligned at it, and a suffix array of the blocks of all that stands about one
anchor shows which runs of blocks recur; the windows there are then compared byte by byte. Where too much stands about
one anchor for one task, it is parted by more of the bytes that its windows share."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, arrow_pass, give_back, parted_join, row_key, scratch, sized_join, small_batches, stored

LENGTH, GRAM, STEP = 400, 40, 20
#: Blocks sorted at once, and different surroundings of one anchor beyond which they are parted.
TOGETHER, SPLIT = 20_000, 128
#: Rows of an anchor, or copies of a text, beyond which they are not dealt by it: there are so many times fewer such keys than rows.
HOT = 1_000
_PRIME = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


# ---- suffix sorting


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes' order, in time linear in the text and its largest symbol. The last symbol must be 0 and occur nowhere else.

    First the suffixes are grouped by their Lyndon prefixes. A group is a range of `order`, named by its start. From the highest
    down, each member hands its group's prefix to the nearest suffix before it that is in a lower group; those that get it move to
    a new group right above their own, the higher the more members hand it to them. Then the groups fill from the lowest: a
    suffix that has been placed places the one before it, and along the pointers those whose prefixes end there."""
    n = len(text)
    starts = [0] * (max(text) + 2)
    for x in text:
        starts[x + 1] += 1
    size, at = [0] * n, 0
    for x, count in enumerate(starts):
        if count:
            size[at] = count  # of symbol x - 1, whose group starts where the smaller ones end
        at += count
        starts[x] = at
    free = starts[:]
    order, place, group = [0] * n, [0] * n, [0] * n
    for s, x in enumerate(text):
        k = free[x]
        free[x] = k + 1
        order[k], place[s], group[s] = s, k, starts[x]
    before = [-1] * n
    end = n
    while end > 0:
        own = group[order[end - 1]]
        got: dict[int, int] = {}
        if end - own == 1:  # one member
            s = order[own]
            p = s - 1
            while p >= 0 and group[p] > own:
                p = before[p]
            before[s] = p
            if p >= 0:
                got[p] = 1
        else:
            chain: list[int] = []
            for s in order[own:end]:
                p = s - 1
                while p >= 0 and group[p] > own:
                    p = before[p]
                before[s] = p
            for s in order[own:end]:  # those that came to another member go on to where that one does; each is followed once
                p = before[s]
                while p >= 0 and group[p] == own:
                    chain.append(s)
                    s, p = p, before[p]
                for s in chain:
                    before[s] = p
                chain.clear()
            for s in order[own:end]:
                if (p := before[s]) >= 0:
                    got[p] = got.get(p, 0) + 1
        by_count: dict[int, list[int]] = defaultdict(list)
        for p, times in got.items():
            by_count[times].append(p)
        for times in range(max(by_count, default=0), 0, -1):
            moved: dict[int, int] = {}
            for p in by_count.get(times, ()):  # to the end of its group
                g = group[p]
                last = g + size[g] - 1 - moved.get(g, 0)
                q, k = order[last], place[p]
                order[k], order[last], place[q], place[p] = q, p, k, last
                moved[g] = moved.get(g, 0) + 1
            for g, count in moved.items():
                size[g] -= count
                new = g + size[g]
                size[new] = count
                for k in range(new, new + count):
                    group[order[k]] = new
        end = own
    out, free, done = [0] * n, list(range(n)), [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        s = out[k] - 1
        while s >= 0 and not done[s]:
            out[free[group[s]]] = s
            free[group[s]] += 1
            done[s] = True
            s = before[s]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place but the first, how many symbols its suffix shares with the one before it."""
    n = len(text)
    rank = [0] * n
    for k, s in enumerate(order):
        rank[s] = k
    out, h = [0] * n, 0
    for s in range(n):
        k = rank[s]
        if k:
            t = order[k - 1]
            while s + h < n and t + h < n and text[s + h] == text[t + h]:
                h += 1
            out[k] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out


def recurring(contexts: list[tuple[int, int, bytes]], length: int = LENGTH, step: int = STEP) -> list[list[tuple[int, int]]]:
    """For each context (anchor, bytes before the anchor's start, bytes) the spans, from its own start, of windows that another
    context of the same anchor has at the same place. Equal contexts are others of each other."""
    text: list[int] = []
    where: list[tuple[int, int]] = []
    number: dict[tuple, int] = {}
    floor = len(contexts) + 1
    for c, (anchor, lead, raw) in enumerate(contexts):
        first, last = -(lead // step), (len(raw) - lead) // step
        low = lead + first * step
        where += [(c, t) for t in range(first, last)]
        text += [number.setdefault((anchor, t, raw[at : at + step]), len(number) + floor) for t, at in zip(range(first, last), range(low, len(raw), step), strict=False)]
        where.append((c, -1 << 30))
        text.append(1 + c)  # in no other context
    text.append(0)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    least = length // step - 1
    inner, most = least * step, len(order)
    spans: list[list[tuple[int, int]]] = [[] for _ in contexts]
    k = 1
    while k < most:
        if shared[k] < least:
            k += 1
            continue
        first = k - 1
        while k < most and shared[k] >= least:
            k += 1
        t = where[order[first]][1]
        # windows that hold the run and start up to step - 1 bytes before it: the bytes before it and after it decide
        about: dict[tuple[bytes, bytes], list[int]] = {}
        for s in order[first:k]:
            c = where[s][0]
            _, lead, raw = contexts[c]
            at = lead + t * step
            about.setdefault((raw[max(at - step + 1, 0) : at], raw[at + inner : at + inner + step]), []).append(c)
        for (left, right), members in about.items():
            if len(members) > 1 and len(left) + len(right) >= step:
                for c in members:
                    at = contexts[c][1] + t * step
                    spans[c].append((at - len(left), at + inner + len(right)))
        if len(about) > 1:
            for back in range(step):
                same: dict[bytes, list[tuple[bytes, bytes]]] = {}
                for pair in about:
                    if back <= len(pair[0]) and step - back <= len(pair[1]):
                        same.setdefault(pair[0][len(pair[0]) - back :] + pair[1][: step - back], []).append(pair)
                for pairs in same.values():
                    if len(pairs) > 1:
                        for c in (c for pair in pairs for c in about[pair]):
                            at = contexts[c][1] + t * step - back
                            spans[c].append((at, at + length))
    return [merged_pairs(x) for x in spans]


def merged_pairs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


# ---- anchors

_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 17)
        make = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))))
        _powers = make(_PRIME), make(pow(_PRIME, -1, 2**64))
    return _powers


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with the same anchor: the k-gram's hash, its place, and the first and last window's place. A window's
    anchor is the k-gram in it of the least hash, of equals the last: that depends on the window alone."""
    n = len(raw)
    if n < length:
        return (np.empty(0, np.int64),) * 4
    up, down = _grown(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.frombuffer(raw, np.uint8).astype(np.uint64) * up[:n], dtype=np.uint64)))
    h = (sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    m, w = len(h), length - gram + 1
    key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    pad = -m % w
    grid = np.concatenate((key, np.full(pad, 2**64 - 1, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    first = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:] - 1, np.array([len(place) - 1])))
    return h[place[first]].view(np.int64), place[first], first, last


_ANCHORS = "_k1 long, _k2 long, n long, tid binary, gram array<long>, first array<long>, lead array<int>, size array<int>, digest array<binary>"


def _profile(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of each text its length, its digest, and what stands about its anchors: the anchor, where it begins, how many bytes before the
    anchor, how many in all, and their digest."""
    out: list[tuple] = []
    for k1, k2, text in zip(*(batch.column(k).to_pylist() for k in ("_k1", "_k2", "text")), strict=True):
        raw = (text or "").encode()
        gram, at, first, last = anchors(raw)
        first, lead, size = first.tolist(), (at - first).tolist(), (last + LENGTH - first).tolist()
        out.append((k1, k2, len(raw), hashlib.blake2b(raw, digest_size=16).digest(), gram, first, lead, size, [_digest(before, raw[f : f + n]) for f, before, n in zip(first, lead, size, strict=True)]))
    return _rows(out, _ANCHORS)


def _digest(lead: int, part: bytes) -> bytes:
    return hashlib.blake2b(part + lead.to_bytes(4, "big"), digest_size=16).digest()


_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


#: key: what the windows share, at first their anchor; low, high: how far before the windows' anchor they start, from low up to high, not
#: included; gram, digest: of the whole context; shift: where in it the part starts; own: the part's digest; m: different parts of the anchor.
_PART = "key long, low long, high long, gram long, digest binary, shift long, lead long, part binary, times long, own binary, m long"


def _parts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The bytes of the contexts that a text stands for."""
    out: list[tuple] = []
    for text, asked in zip(*(batch.column(k).to_pylist() for k in ("text", "asked")), strict=True):
        raw = (text or "").encode()
        out += [(x["gram"], 0, LENGTH - GRAM + 1, x["gram"], x["digest"], 0, x["lead"], raw[x["at"] : x["at"] + x["size"]], x["times"], x["digest"], x["m"]) for x in asked]
    return _rows(out, _PART)


def _halves(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each part's windows in two halves by where they start before the anchor. The windows of a half share more bytes than those of the whole, and
    these bytes make the half's key: equal windows have equal keys."""
    out: list[tuple] = []
    for key, low, high, gram, digest, shift, lead, part, times in zip(*(batch.column(k).to_pylist() for k in ("key", "low", "high", "gram", "digest", "shift", "lead", "part", "times")), strict=True):
        middle = (low + high) // 2
        for a, b in ((low, middle), (middle, high)):
            far, near = min(lead, b - 1), max(lead + LENGTH - len(part), a)
            if far < near:
                continue
            start = lead - far
            piece = part[start : lead - near + LENGTH]
            common = hashlib.blake2b(b"%d %d %d " % (key, a, b) + part[lead - a : lead + LENGTH + 1 - b], digest_size=8).digest()
            out.append((int.from_bytes(common, "big", signed=True), a, b, gram, digest, shift + start, far, piece, times, _digest(far, piece), 0))
    return _rows(out, _PART)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recurring spans of contexts that come grouped by key; as many groups at a time as make TOGETHER blocks. What occurs more
    than once is sorted twice, which is enough to recur."""

    def results(held: list[tuple]) -> pa.RecordBatch:
        given = [(key, lead, part) for key, _, lead, part, _ in held]
        again = [x for x, row in zip(given, held, strict=True) if row[4] > 1]
        found = recurring(given + again)
        return _rows([(row[0], row[1], [x for s in spans for x in s]) for row, spans in zip(held, found, strict=False) if spans], "key long, own binary, spans array<long>")

    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("key", "own", "lead", "part", "times")), strict=True))
    held: list[tuple] = []
    blocks = 0
    for _, group in groupby(rows, key=lambda r: r[0]):
        for r in group:
            held.append(r)
            blocks += len(r[3]) // STEP * min(r[4], 2)
        if blocks > TOGETHER:
            yield results(held)
            held, blocks = [], 0
    if held:
        yield results(held)
    give_back()


def _dealt(parts: DataFrame) -> DataFrame:
    """Spans of parts (key, own, lead, part, times), a key's in one task."""
    return stored(parts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted, "key long, own binary, spans array<long>"), "recurring")


def repeats(parts: DataFrame, split: int = SPLIT) -> DataFrame:
    """gram, digest and spans of the contexts (_PART, a stored table) with windows that recur; stored tables.

    A key with up to `split` different parts is one task's; other keys' parts are halved into new keys, and again, in nine rounds
    at most, for then all windows of a key are equal. Equal parts are one before they are dealt, and carry how many they were."""
    columns = ["key", "own", "lead", "part", "times"]
    found = _dealt(parts.where(F.col("m") <= split).select(columns)).select(F.col("key").alias("gram"), F.col("own").alias("digest"), "spans")
    many = parts.where(F.col("m") > split)
    if many.isEmpty():
        return found
    while not many.isEmpty():
        parts = stored(arrow_pass(many, _halves, _PART), "halves").drop("m")
        per = parts.groupBy("key", "own").agg(F.sum("times").alias("times"))
        keys = stored(per.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("times").alias("total")).where("total > 1").select("key", "m"), "keys")
        alive = sized_join(parts, keys, ["key"])  # of the hot anchors' parts only
        done = (F.col("m") <= split) | (F.col("high") - F.col("low") == 1)
        few, many = alive.where(done), alive.where(~done)
        one = few.groupBy("key", "own").agg(F.first(F.struct("lead", "part")).alias("x"), F.sum("times").alias("times")).select("key", "own", "x.lead", "x.part", "times")
        here = sized_join(few.select("key", "own", "gram", "digest", "shift"), _dealt(one), ["key", "own"])
        found = found.unionByName(here.select("gram", "digest", F.transform("spans", lambda x: x + F.col("shift")).alias("spans")))
    return stored(found.groupBy("gram", "digest").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeats")


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """_k1, _k2 and spans of the rows that hold a window of LENGTH bytes that starts elsewhere too; spans (start, end, start, end, ...)
    of bytes may overlap. A stored table. Equal texts are one, which recurs as a whole if it is that of several rows."""
    small_batches(docs.sparkSession)
    text = F.col(text_col)
    keyed = docs.select(*row_key(F.col(id_col), text), text.alias("text"))
    with scratch(docs.sparkSession) as kept:
        with scratch(docs.sparkSession) as own:
            found = stored(arrow_pass(keyed, _profile, _ANCHORS), "anchors")
            rows = own(found.select(*KEY, "tid"), "rows")
            pack = F.arrays_zip("gram", "first", "lead", "size", "digest")
            kinds = found.where(F.col("n") >= LENGTH).groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("n", *KEY, pack.alias("found"))).alias("x"))
            kinds = own(kinds.select("tid", "copies", "x.*"), "texts")
        grams = stored(kinds.select(F.explode("found.gram").alias("gram")).groupBy("gram").count().where("count > 1"), "grams")
        hot = stored(grams.where(F.col("count") > HOT).select("gram"), "hot")
        each = kinds.select("tid", F.explode("found").alias("x")).select("tid", "x.*")
        found = stored(parted_join(each, grams.select("gram"), "gram", hot, "left_semi"), "contexts")
        heads = found.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("tid", "first", "lead", "size")).alias("x"))
        heads = stored(heads.select("gram", "digest", F.least("times", F.lit(2)).alias("times"), "x.*"), "heads")
        per = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.sum("times").alias("total")).where("total > 1").select("gram", "m")
        wanted = parted_join(heads, stored(per, "differing"), "gram", hot)
        wanted = wanted.groupBy("tid").agg(F.collect_list(F.struct("gram", "digest", F.col("lead").cast("long").alias("lead"), "size", F.col("first").alias("at"), "times", "m")).alias("asked"))
        wanted = stored(wanted.join(kinds.select("tid", *KEY), "tid").select(*KEY, "asked"), "wanted")
        texts = sized_join(keyed, wanted.select(*KEY), KEY, "left_semi").dropDuplicates(KEY).join(wanted, KEY)
        parts = stored(arrow_pass(texts.select("text", "asked"), _parts, _PART), "parts")
        met = found.select("gram", "digest", "tid", "first").join(repeats(parts, split).hint("merge"), ["gram", "digest"])
        spans = met.groupBy("tid").agg(F.flatten(F.collect_list(F.transform("spans", lambda x: x + F.col("first")))).alias("spans"))
        marks = kinds.select("tid", "copies", "n").join(spans, "tid", "left").where("copies > 1 or spans is not null")
        marks = stored(marks.select("tid", "copies", F.when(F.col("copies") > 1, F.array(F.lit(0).cast("long"), F.col("n"))).otherwise(F.col("spans")).alias("spans")), "marks")
        many = stored(marks.where(F.col("copies") > HOT).select("tid"), "many")
        return kept(parted_join(rows, marks.drop("copies"), "tid", many).groupBy(*KEY).agg(F.first("spans").alias("spans")), "covered-rows")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept (the bytes left) of each row: without every byte that a string of LENGTH bytes
    covers which starts anywhere else, in the same text or another, as the texts were.

    A null text is empty; a text of fewer bytes loses nothing. Null ids are kept; repeated rows are copies of each other, and lose all if
    they are long enough. An empty table gives no rows. Other columns are left out."""
    marks = covered(docs, id_col, text_col, split)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *row_key(F.col(id_col), text), text.alias("text")).join(marks.hint("merge"), KEY, "left")

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = (text or "").encode()
            own = merged_pairs(list(zip(spans[::2], spans[1::2], strict=True))) if spans else []
            ends = [0, *(x for s in own for x in s), len(raw)]
            sizes.append(len(raw))
            removed.append(sum(e - s for s, e in own))
            runs.append(len(own))
            kept.append(b"".join(raw[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = arrow_pass(rows.select("id", "text", "spans"), per_batch, f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("id", id_col)
