"""Quality rules: statistics of whole texts, fixed rules, and gradient-boosted trees over the statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass

#: Labelled rows that the trees are fitted on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 20_000
WINDOW = 5
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_PUNCT = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_DIGITS, _UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Names of the features, with the sign of the verdict's slope in each: -1 where more can only lower the score, 0 where it's free.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_word_share": -1, "distinct_word_share": 0, "upper_share": 0, "punct_share": 0, "exclaim_share": -1, "digit_share": 0, "line_words": 0, "short_word_share": 0}


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n < 200_000:
        grams = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(grams)) == n:
            return 0
        number: dict[tuple, int] = {}
        ids = np.fromiter((number.setdefault(g, len(number)) for g in grams), np.int64, n)
    else:  # ranks of pairs of ranks: the same classes in a few arrays
        known: dict[bytes, int] = {}
        one = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        ids = one[:n]
        for k in range(1, WINDOW):
            ids = np.unique(ids * np.int64(len(known)) + one[k : k + n], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(n + WINDOW, np.int64)
    edge[:n] += twice
    edge[WINDOW : n + WINDOW] -= twice
    return int((np.cumsum(edge)[: len(words)] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and FEATURES' values."""
    raw = text.encode()
    words = raw.split()  # of bytes: at \\x20 and \\x09-\\x0D only
    n, size = len(words), len(raw)
    without = lambda chars: size - len(raw.translate(None, chars))
    chars = len(text) - without(_SPACE)
    symbols = without(_SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.translate(None, _SPACE)]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    per = lambda x: x / max(chars, 1)
    features = [
        np.log1p(n), chars / max(n, 1), per(symbols), dups / max(len(lines), 1), repeats / max(n, 1), len(set(words)) / max(n, 1), per(without(_UPPER)),
        per(without(_PUNCT)), raw.count(b"!") / max(chars, 1), per(without(_DIGITS)), np.log1p(n / max(len(lines), 1)), sum(map(_SHORT.__contains__, map(len, words))) / max(n, 1),
    ]
    return [n, chars, symbols, dups, repeats], features


_SHORT = frozenset((1, 2))


@dataclass
class Trees:
    """Trees in node arrays, one row a tree. Node i's children are 2i+1 (feature <= threshold) and 2i+2; a node that isn't
    split has threshold inf and hands its value to the left. The score is base plus the leaves' values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds for each row of x: all rows go down one tree at a time, a level at a step."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return total


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of log loss over histograms. Where signs isn't 0, a split is taken only if the two values stand in
    that order, and each child's values are bounded by the middle of them: so is every path, and the score is monotonic."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    rate0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(leaves)
        node = np.zeros(n, np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for i in range(inner + leaves):
            at = np.flatnonzero(node == i)
            low, high = bounds[i]
            G, H = g[at].sum(), h[at].sum()
            own = float(np.clip(G / (H + ridge), low, high))
            if i >= inner:
                value[i - inner] = rate * own
                continue
            best, cut, middle = 1e-6, None, 0.0
            for j in range(width):
                m = len(edges[j]) + 1
                if m < 2 or not len(at):
                    continue
                gl = np.cumsum(np.bincount(code[at, j], g[at], m))[:-1]
                hl = np.cumsum(np.bincount(code[at, j], h[at], m))[:-1]
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((G - gl) / (H - hl + ridge), low, high)
                gain = (gl * vl - (hl + ridge) * vl**2 / 2) + ((G - gl) * vr - (H - hl + ridge) * vr**2 / 2) - (G * own - (H + ridge) * own**2 / 2)
                gain[(hl < least) | (H - hl < least)] = -np.inf
                if signs[j]:
                    gain[signs[j] * (vr - vl) < 0] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, cut, middle = float(gain[k]), (j, k), float(vl[k] + vr[k]) / 2
            left, right = 2 * i + 1, 2 * i + 2
            bounds[left] = bounds[right] = (low, high)
            node[at] = left
            if cut:
                j, k = cut
                feature[i], threshold[i] = j, edges[j][k]
                node[at[code[at, j] > k]] = right
                if signs[j]:
                    bounds[left], bounds[right] = ((low, middle), (middle, high)) if signs[j] > 0 else ((middle, high), (low, middle))
        score += value[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, leaves), base)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """Trees for label_col (1: good) over a bounded sample: the rows labels whose ids hash lowest. None where the
    sample has one class only. Null ids, texts and labels aren't fitted on, and of rows that share an id the one of the least text."""
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id", "label").limit(rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # at most `rows` rows of numbers
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))  # one of an id that is repeated

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [statistics(x)[1] for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, pa.list_(pa.float64()))], ["id", "label", "features"])

    known = arrow_pass(texts.select("id", "text", "label"), per_batch, f"id {dict(docs.dtypes)[id_col]}, label int, features array<double>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = known["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    return fit(np.array(known["features"].to_pylist()), y, list(FEATURES.values()))


def verdicts(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text", least_words: int = 10, repeat_percent: int = 20, least_score: float = 0.3) -> DataFrame:
    """Each row's statistics, base_failed, the trees' score (a probability) and kept, over whole texts.

    A null text is as an empty one: no words, base_failed. kept is false where base_failed, else whether the score
    reaches least_score, or true without a model. Null ids and repeated rows give a row each; an empty table none;
    other columns are left out."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, values = zip(*(statistics(x or "") for x in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
        c = np.array(counts, np.int64).reshape(-1, 5)
        score = 1 / (1 + np.exp(-model.score(np.array(values).reshape(-1, len(FEATURES))))) if model else np.ones(len(c))
        failed = (c[:, 0] < least_words) | (100 * c[:, 4] > repeat_percent * c[:, 0])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least_score))], names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    out = arrow_pass(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), per_batch, f"id {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Trees | None, text_col: str = "text", **rules: float) -> DataFrame:
    """docs without the rows that verdicts() rejects, all columns as they were, whatever their names.

    A null text is as an empty one, and goes; null ids are kept; repeated rows stay or go together; an empty table gives an empty one."""
    least_words, repeat_percent, least_score = rules.get("least_words", 10), rules.get("repeat_percent", 20), rules.get("least_score", 0.3)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, values = zip(*(statistics(x or "") for x in batch.column(at).to_pylist()), strict=True) if batch.num_rows else ((), ())
        c = np.array(counts, np.int64).reshape(-1, 5)
        keep = (c[:, 0] >= least_words) & (100 * c[:, 4] <= repeat_percent * c[:, 0])
        if model:
            keep &= 1 / (1 + np.exp(-model.score(np.array(values).reshape(-1, len(FEATURES))))) >= least_score
        return batch.filter(pa.array(keep))

    at = docs.columns.index(text_col)
    return arrow_pass(docs, per_batch, docs.schema)
