"""Personal data: patterns over whole texts, and a skip-chain conditional random field that adds what the patterns miss.

Tokens with a digit or an @ are nodes. Neighbours in the text share a potential, and so do tokens of equal or similar
content however far apart; sum-product messages pass over both until they settle, or have had rounds enough to cross every
chain. What the patterns found is given."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 for none, then KINDS.
LABELS = len(KINDS) + 1
#: Probability from which a token that no pattern covers counts, rounds of messages besides those that cross the graph's nodes, and share of the old message kept.
LEAST, ROUNDS, DAMPING = 0.8, 20, 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[0-9@]\S*")
_EDGE = "\"'()[]{}<>,;:.!?*|"


def luhn(digits: str) -> bool:
    total = sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(label, start, end) by kind and start: each kind's leftmost non-overlapping matches that pass its test. Linear in the text."""
    found = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((1, start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    found += [(2, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-9:]) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((3, m.start(), m.end()))
    found += [(4, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans of the words with a digit or an @, without punctuation about them."""
    out = []
    for m in _NODE.finditer(text):
        start, end = m.span()
        while start and not text[start - 1].isspace():
            start -= 1
        while start < end and text[start] in _EDGE and not (text[start] == "(" and ")" in text[start:end]):
            start += 1
        while end > start and text[end - 1] in _EDGE and not (text[end - 1] == ")" and "(" in text[start:end]):
            end -= 1
        if start < end:
            out.append((start, end))
    return out


def contents(word: str) -> list[str]:
    """What makes tokens similar; any of it in common does. The last seven digits of a number of that many; else the letters and digits in
    lower case if there are six; of what has an @, also those before it if there are six, and all up to the first dot behind it."""
    digits = "".join(x for x in word if "0" <= x <= "9")
    if len(digits) >= 7 and len(digits) * 2 > len(word):
        return [digits[-7:]]
    local, at, host = word.partition("@")
    out = [f"{local}@{host.split('.')[0]}".lower()] if local and host else []
    for part in (word, local) if at else (word,):
        plain = "".join(filter(str.isalnum, part)).lower()
        if len(plain) >= 6 and plain not in out:
            out.append(plain)
    return out


_BEFORE = (("mail", "e-mail", "email"), ("ip", "host", "server", "address"), ("card", "visa", "credit"), ("phone", "tel", "call", "fax", "mobile"))
WIDTH = 21


def features(text: str, start: int, end: int) -> list[float]:
    word = text[start:end]
    digits = sum("0" <= x <= "9" for x in word)
    local, at, domain = word.partition("@")
    dots = word.count(".")
    groups = word.split(".")
    real = digits < 20 and luhn("".join(x for x in word if "0" <= x <= "9"))
    before = text[max(0, start - 24) : start].lower().split()
    hint = before[-1].strip(_EDGE) if before else ""
    return [
        1.0, float(bool(at and local and domain)), float(bool(at) and "." in domain.strip(".")), float(bool(at) and not local),
        float(digits == 0), float(0 < digits < 5), float(5 <= digits < 10), float(10 <= digits < 16), float(digits >= 16), float(digits == len(word)),
        float(dots == 3 and len(groups) == 4 and all(g.isdigit() and len(g) < 4 for g in groups)), float(word.count("-") >= 1 and digits >= 7),
        float(digits >= 16 and real), float(digits >= 16 and not real), float(dots == 3 and any(g.isdecimal() and len(g) < 10 and int(g) > 255 for g in groups)),
        float(word[0] in "+("), float(any(map(str.isalpha, word))), *(float(hint in words) for words in _BEFORE),
    ]


def graph(text: str, nodes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges: of neighbours with nothing but space and punctuation between, and of each token with the last before it that has some content
    in common, for each of its contents. All are chains, so there are no more edges than tokens and their contents."""
    near, far, last = [], [], {}
    for i, (start, end) in enumerate(nodes):
        if i and start - nodes[i - 1][1] <= 3 and not any(map(str.isalnum, text[nodes[i - 1][1] : start])):
            near.append((i - 1, i))
        before = set()
        for key in contents(text[start:end]):
            if key in last:
                before.add(last[key])
            last[key] = i
        far += [(j, i) for j in sorted(before)]
    return np.array(near, np.int64).reshape(-1, 2), np.array(far, np.int64).reshape(-1, 2)


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """An invented text and its true spans: data in forms that the patterns know and in forms that they don't, and other numbers."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    name, host = f"{word()}.{digits(2)}", f"{word()}.example.com"
    line = (digits(3), digits(3), digits(4))
    card = digits(15)
    card += next(x for x in "0123456789" if luhn(card + x))
    ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
    forms = {
        1: [f"{name}@{host}", f"{name}@{host}", f"{name}@{host.split('.')[0]}"], 2: [ip, ip, f"{ip}:{digits(4)}"],
        3: [card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", card, f"{card[:4]}.{card[4:8]}.{card[8:12]}.{card[12:]}"], 4: [f"+1 ({line[0]}) {line[1]}-{line[2]}", f"({line[0]}) {line[1]}-{line[2]}", f"{line[0]}-{line[1]}-{line[2]}", ".".join(line)],
    }
    wrong = card[:15] + str((int(card[15]) + rng.randint(1, 9)) % 10)
    other = [lambda: wrong, lambda: str(rng.randint(1900, 2099)), lambda: digits(rng.randint(1, 6)), lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"@{word()}", lambda: digits(rng.randint(7, 14)), lambda: f"{word()}{digits(2)}", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{word()}@{digits(1)}", lambda: ".".join(str(rng.randint(200, 999)) for _ in range(4))]
    hints = {k + 1: _BEFORE[k] for k in range(4)}
    text, spans = "", []
    twice = rng.choice(other)()
    used: list[int] = []
    for _ in range(rng.randint(8, 20)):
        x = rng.random()
        if x < 0.35:
            kind = rng.choice(used) if used and rng.random() < 0.5 else rng.randint(1, 4)  # the same again, maybe in another form
            used.append(kind)
            if rng.random() < 0.3:
                text += rng.choice(hints[kind]) + ": "
            form = rng.choice(forms[kind])
            spans.append((kind, len(text), len(text) + len(form)))
            text += form + rng.choice((" ", ". ", ", "))
            if kind == 3 and rng.random() < 0.3:
                text += wrong + " "
        elif x < 0.7:
            text += (twice if rng.random() < 0.3 else rng.choice(other)()) + " "
        text += " ".join(word() for _ in range(rng.randint(0, 4))) + " "
    return text, spans


def labels_of(nodes: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of the first span, by kind, that each token meets; 0 for none."""
    out = np.zeros(len(nodes), np.int64)
    for label, start, end in sorted(spans, reverse=True):
        lo = np.searchsorted([x[1] for x in nodes], start, side="right") if len(nodes) < 64 else _first(nodes, start)
        while lo < len(nodes) and nodes[lo][0] < end:
            out[lo] = label
            lo += 1
    return out


def _first(nodes: list[tuple[int, int]], start: int) -> int:
    lo, hi = 0, len(nodes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if nodes[mid][1] <= start else (lo, mid)
    return lo


@lru_cache(maxsize=1)
def weights(texts: int = 500, steps: int = 300, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary (WIDTH x LABELS), neighbour and skip potentials (LABELS x LABELS), fitted by pseudo-likelihood to invented texts:
    each token's label given its features and the labels about it. The two pair potentials are symmetric."""
    rng = random.Random(seed)
    xs, near, far, ys = [], [], [], []
    for _ in range(texts):
        text, spans = example(rng)
        nodes = tokens(text)
        y = labels_of(nodes, spans)
        one = np.eye(LABELS)[y]
        around = [np.zeros((len(nodes), LABELS)) for _ in range(2)]
        for store, edges in zip(around, graph(text, nodes), strict=True):
            np.add.at(store, edges[:, 0], one[edges[:, 1]])
            np.add.at(store, edges[:, 1], one[edges[:, 0]])
        xs.append(np.array([features(text, *n) for n in nodes]).reshape(-1, WIDTH))
        near.append(around[0])
        far.append(around[1])
        ys.append(y)
    x, n, f, y = np.concatenate(xs), np.concatenate(near), np.concatenate(far), np.eye(LABELS)[np.concatenate(ys)]
    u, p, q = np.zeros((WIDTH, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    parts = ((u, x), (p, n), (q, f))
    speed = [np.zeros_like(w) for w, _ in parts]
    for _ in range(steps):
        s = x @ u + n @ p + f @ q
        s = np.exp(s - s.max(1, keepdims=True))
        gap = (y - s / s.sum(1, keepdims=True)) / len(y)
        for k, (w, own) in enumerate(parts):
            g = own.T @ gap - 1e-4 * w
            if k:
                g = (g + g.T) / 2
            speed[k] = 0.9 * speed[k] + g
            w += 0.5 * speed[k]
    return u, p, q


def beliefs(unary: np.ndarray, edges: np.ndarray, pair: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Each node's distribution by loopy sum-product. unary: logs; edges: two nodes each; pair: logs, a matrix for each edge;
    given: a node's label, or -1 for an open one. A damped message crosses an edge in 1 / (1 - DAMPING) rounds on average, so there are
    twice as many rounds as nodes, and ROUNDS more, unless no message changes any more."""
    n = len(unary)
    local = np.where((given < 0)[:, None] | (np.arange(LABELS)[None, :] == given[:, None]), unary, -1e9)
    src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    both = np.concatenate((pair, pair.transpose(0, 2, 1)))
    message = np.zeros((len(src), LABELS))
    for _ in range(2 * n + ROUNDS):
        total = local.copy()
        np.add.at(total, dst, message)
        out = total[src] - message[back]
        new = np.logaddexp.reduce(out[:, :, None] + both, axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        change = np.abs(new - message).max(initial=0)
        message = DAMPING * message + (1 - DAMPING) * new
        if change < 1e-4:
            break
    total = local.copy()
    np.add.at(total, dst, message)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def find(text: str, model: tuple[np.ndarray, np.ndarray, np.ndarray], least: float = LEAST) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans: the base ones and, merged where they are neighbours of one label, the open tokens whose label has at least the probability `least`."""
    base = base_spans(text)
    nodes = tokens(text)
    y = labels_of(nodes, base)
    if not nodes or (y > 0).all():
        return base, base
    u, p, q = model
    near, far = graph(text, nodes)
    unary = np.array([features(text, *n) for n in nodes]) @ u
    belief = beliefs(unary, np.concatenate((near, far)), np.concatenate((np.repeat(p[None], len(near), 0), np.repeat(q[None], len(far), 0))), np.where(y > 0, y, -1))
    tied = {tuple(e) for e in near.tolist()}
    more: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero((y == 0) & (belief[:, 1:].max(1) >= least)).tolist():
        label = int(belief[i].argmax())
        if more and last == i - 1 and (i - 1, i) in tied and more[-1][0] == label:
            more[-1] = (label, more[-1][1], nodes[i][1])
        else:
            more.append((label, *nodes[i]))
        last = i
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{s}:{e}" for k, s, e in spans)


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """id, the numbers of base spans by kind, base and spans: kind:start:end (code points, end exclusive) by kind and start,
    joined by commas; n_spans: how many spans there are, added ones included.

    A null text is empty: no spans. Null ids are kept; repeated rows give a row each, an empty table none. Texts of any
    length are read whole. Other columns are left out."""
    model = weights()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find(x or "", model, least) for x in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(1, LABELS)]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([written(b) for b, _ in rows], pa.string()), pa.array([written(a) for _, a in rows], pa.string()), pa.array([len(a) for _, a in rows], pa.int64())], names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_spans"]
    out = arrow_pass(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_batch, f"id {dict(docs.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")
    return out.withColumnRenamed("id", id_col)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans becomes its first span's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind - 1].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", least: float = LEAST) -> DataFrame:
    """docs with every span of their texts redacted, and chars_col (if any) as the new length.

    Null texts stay null, and texts without spans as they are; other columns, null ids and repeated rows stay too; an empty table gives an empty one."""
    model = weights()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x if x is None else redact_text(x, find(x, model, least)[1]) for x in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        if size is not None:
            columns[size] = pa.array([n if x is None else len(x) for x, n in zip(texts, columns[size].to_pylist(), strict=True)], batch.schema.types[size])
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    at = docs.columns.index(text_col)
    size = docs.columns.index(chars_col) if chars_col in docs.columns else None
    return arrow_pass(docs, per_batch, docs.schema)
