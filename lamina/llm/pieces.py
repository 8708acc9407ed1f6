"""Encoding into the pieces of a SentencePiece file by unigram Viterbi over a double-array trie, and decoding."""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, arrow_pass
from .token_counts import resolve

MARK = "▁"
#: As the public library has it: a character without a piece costs so much more than the worst piece.
UNKNOWN_COST = 10.0
#: Units in one vectorised search, and the longest unit that goes there; bytes of results kept by unit, the longest unit kept, and
#: characters encoded in one call.
TOGETHER, LONG = 4_096, 64
KEPT_BYTES, KEPT_CHARS, CALL_CHARS = 48 << 20, 32, 1 << 20
#: Texts that a normaliser, or one that tidies white space, would change.
_AS_THEY_ARE = ("a  b", " a ", "\ufb01 \uff21 e\u0301 \u00bd", "A\tb\nc", "\u3000x")
_UNITS = re.compile(r" +[^ ]+| +$")


@dataclass
class Trie:
    """From state s by byte b to base[s] + b + 1, if check has s there. value: the piece that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(pieces: dict[bytes, int]) -> Trie:
    """States are placed breadth first, each where all its children's slots are free."""
    keys = sorted(pieces)
    size = 1 << 16
    base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
    check[0] = 0
    level = [(0, 0, len(keys), 0)]
    free, fork, used = 257, 257, bytearray(size)  # no slot before the first that every byte can reach
    used[0] = 1
    while level:
        below = []
        for state, lo, hi, depth in level:
            if lo < hi and len(keys[lo]) == depth:
                value[state] = pieces[keys[lo]]
                lo += 1
            if lo == hi:
                continue
            groups, at = [], lo
            while at < hi:
                byte, start = keys[at][depth], at
                while at < hi and keys[at][depth] == byte:
                    at += 1
                groups.append((byte + 1, start, at))
            while used[free]:
                free += 1
            place = max((free if len(groups) == 1 else fork) - groups[0][0], 0)
            while True:
                if place + 300 > size:
                    more = size
                    base.extend([0] * more), check.extend([-1] * more), value.extend([-1] * more), used.extend(bytes(more))
                    size += more
                if not any(used[place + c] for c, _, _ in groups):
                    break
                place += 1
            if len(groups) > 1:  # forks are placed after one another: only single children go back to fill holes
                fork = place + groups[0][0]
            base[state] = place
            for c, start, end in groups:
                used[place + c] = 1
                check[place + c] = state
                below.append((place + c, start, end, depth + 1))
        level = below
    return Trie(*(np.array(x, np.int32) for x in (base, check, value)))


@dataclass
class Model:
    """pieces: the bytes of each id; score: its log score; bytes: the ids of the 256 byte pieces, or none."""

    pieces: list[bytes]
    score: np.ndarray
    byte_ids: list[int]
    unknown: int
    trie: Trie
    kept: Kept = field(default_factory=lambda: Kept(KEPT_BYTES))


@lru_cache(maxsize=2)
def load(name: str) -> Model:
    """A model file's pieces. The scores of a unigram file are log scores as they stand. A file made by merging pairs has each
    piece's rank, negative, instead: there a piece's log score is -ln(n) - rank / n, n pieces, so that fewer pieces
    are better and among as many those of lower rank (runs of marks, which such a file ranks below all, count as twice the last)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=resolve(name))
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    score = np.array([sp.get_score(i) for i in range(n)], np.float32)
    own = score[plain]
    own = own[own > -1e8]
    if len(own) > 1 and (np.diff(own) % 1 == 0).all() and (np.diff(own) < 0).all():
        score = (-np.log(n) + np.maximum(score.astype(float) / n, -2)).astype(np.float32)
    texts = [sp.id_to_piece(i) for i in range(n)]
    byte_ids = sorted((int(texts[i][3:5], 16), i) for i in range(n) if sp.is_byte(i))
    raw = [bytes([int(texts[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else texts[i].encode() for i in range(n)]
    prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
    if not prefix or any(MARK in texts[i].lstrip(MARK) for i in plain):
        raise ValueError("a file that puts a mark before a text, and whose pieces have marks at their beginnings only, is asked for")
    if any(sp.normalize(x) != MARK + x.replace(" ", MARK) for x in _AS_THEY_ARE):
        raise ValueError("a file that changes a text's characters or white space before it looks for pieces is not read")
    return Model(raw, score, [i for _, i in byte_ids], sp.unk_id(), double_array({texts[i].encode(): i for i in plain}))


def _worst(model: Model) -> np.float32:
    return np.float32(model.score[np.unique(model.trie.value[model.trie.value >= 0])].min() - UNKNOWN_COST)


def _width(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _path(model: Model, raw: bytes, back: list[int], piece: list[int]) -> bytes:
    """Ids of the best way, from its end; a character without a piece is its bytes' pieces."""
    out, at = [], len(raw)
    while at > 0:
        start = back[at]
        if piece[at] >= 0:
            out.append(piece[at])
        elif model.byte_ids:
            out += [model.byte_ids[b] for b in reversed(raw[start:at])]
        elif not out or out[-1] != model.unknown:
            out.append(model.unknown)
        at = start
    out.reverse()
    return array("i", out).tobytes()


def _long(model: Model, raw: bytes) -> bytes:
    """Viterbi over one unit of any length, a byte at a time."""
    base, check, value, score = (x.tolist() for x in (model.trie.base, model.trie.check, model.trie.value, model.score))
    unknown, n = float(_worst(model)), len(raw)
    best, back, piece = [-np.inf] * (n + 1), array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    best[0], at = 0.0, 0
    f32 = np.float32
    while at < n:
        wide, state, single = _width(raw[at]), 0, False
        for k in range(at, n):
            to = base[state] + raw[k] + 1
            if check[to] != state or not to:
                break
            state = to
            if (i := value[state]) >= 0:
                single |= k + 1 - at == wide
                if (s := float(f32(best[at]) + f32(score[i]))) > best[k + 1]:
                    best[k + 1], back[k + 1], piece[k + 1] = s, at, i
        if not single and (s := float(f32(best[at]) + f32(unknown))) > best[at + wide]:
            best[at + wide], back[at + wide], piece[at + wide] = s, at, -1
        at += wide
    return _path(model, raw, back, piece)


def _short(model: Model, raws: list[bytes]) -> list[bytes]:
    """Viterbi over many units at once: all of them take the same step from the same place."""
    base, check, value, score = model.trie.base, model.trie.check, model.trie.value, model.score
    count, size = len(raws), max(map(len, raws))
    data = np.zeros((count, size + 4), np.int64)
    lengths = np.array(list(map(len, raws)))
    flat = np.frombuffer(b"".join(raws), np.uint8)
    data[np.repeat(np.arange(count), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    best = np.full((count, size + 5), -np.inf, np.float32)
    best[:, 0] = 0
    back, piece = np.zeros((count, size + 5), np.int32), np.full((count, size + 5), -1, np.int32)
    unknown = _worst(model)
    for at in range(size):
        rows = np.flatnonzero((lengths > at) & (best[:, at] > -np.inf))
        if not len(rows):
            continue
        first = data[rows, at]
        wide = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
        single = np.zeros(count, bool)
        width = np.zeros(count, np.int64)
        width[rows] = wide
        here, state = rows, np.zeros(len(rows), np.int64)
        for k in range(at, size):
            to = base[state] + data[here, k] + 1
            ok = (check[to] == state) & (to > 0) & (lengths[here] > k)
            here, state = here[ok], to[ok]
            if not len(here):
                break
            ids = value[state]
            has = ids >= 0
            if has.any():
                r, i = here[has], ids[has]
                single[r[width[r] == k + 1 - at]] = True
                s = best[r, at] + score[i]
                up = s > best[r, k + 1]
                r, i = r[up], i[up]
                best[r, k + 1], back[r, k + 1], piece[r, k + 1] = s[up], at, i
        r = rows[~single[rows]]
        to = at + width[r]
        s = best[r, at] + unknown
        up = s > best[r, to]
        r, to = r[up], to[up]
        best[r, to], back[r, to], piece[r, to] = s[up], at, -1
    return [_path(model, raw, b, p) for raw, b, p in zip(raws, back.tolist(), piece.tolist(), strict=True)]


def _search(model: Model, units: list[str]) -> list[bytes]:
    raws = [(MARK + x.replace(" ", MARK)).encode() for x in units]
    out: list[bytes] = [b""] * len(raws)
    order = sorted(range(len(raws)), key=lambda i: len(raws[i]))
    short = [i for i in order if len(raws[i]) <= LONG]
    for k in range(0, len(short), TOGETHER):
        part = short[k : k + TOGETHER]
        for i, ids in zip(part, _short(model, [raws[i] for i in part]), strict=True):
            out[i] = ids
    for i in order[len(short) :]:
        out[i] = _long(model, raws[i])
    return out


def units(text: str) -> list[str]:
    """A text's units: spaces with the word that follows them, without the first space. A piece has its marks only at its
    beginning, so that no piece stands across two units and the best way through a text is that through each."""
    if not text:
        return []
    return [x[1:] for x in _UNITS.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")


def encode(model: Model, texts: list[str]) -> list[bytes]:
    """Each text's ids, as 32-bit numbers. Units that occur again are looked up."""
    kept = model.kept
    kept.room()
    split = [units(x) for x in texts]
    new = list(set().union(*split).difference(kept))
    found = dict(zip(new, _search(model, new), strict=True))
    if any(len(x) > KEPT_CHARS for x in new):
        kept.add({k: v for k, v in found.items() if len(k) <= KEPT_CHARS})
        get = lambda x: kept[x] if x in kept else found[x]
    else:
        kept.add(found)
        get = kept.__getitem__
    return [b"".join(map(get, x)) for x in split]


def decode(model: Model, ids: bytes) -> str:
    """The text: pieces and bytes together, bytes that are no UTF-8 as U+FFFD, marks as spaces, without the leading one."""
    raw = b"".join(map(model.pieces.__getitem__, memoryview(ids).cast("i").tolist()))
    text = raw.decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model_file: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int), n_pieces, n_byte_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip
    (whether decoding gives the text again) of each row's whole text.

    A null text is as an empty one, with no ids; a text with U+2581 itself decodes to spaces there, and round_trip is
    false. Null ids are kept; repeated rows give a row each, an empty table none. Other columns are left out."""
    path = model_file

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[model.byte_ids] = True
        texts = [x or "" for x in batch.column(1).to_pylist()]
        ids = _parts(model, texts)
        flat = np.frombuffer(b"".join(ids), np.int32)
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        fallback = np.concatenate((np.zeros(1, np.int32), np.cumsum(is_byte[flat], dtype=np.int32)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(fallback[ends]).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([decode(model, x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            ], ["id", "ids", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    out = arrow_pass(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_batch, f"id {dict(docs.dtypes)[id_col]}, ids array<int>, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def _parts(model: Model, texts: list[str], chars: int = CALL_CHARS) -> list[bytes]:
    """encode() of about so many characters at a time."""
    out: list[bytes] = []
    part: list[str] = []
    size = 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size > chars:
            out += encode(model, part)
            part, size = [], 0
    return out + (encode(model, part) if part else [])
